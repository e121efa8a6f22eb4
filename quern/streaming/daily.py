"""Daily totals of an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.payloads import scratch


def totals(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Tumbling-day counts and tone totals by event type; rows later than the watermark allows are dropped."""
    tone = (F.col("value") - 50) / 10
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(tone).alias("total"))


def daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, event_type, n, total) of the events table read as a stream of files until all are taken.

    Updates go to a Parquet table, batch by batch; a day's last update is its total.
    """
    path, state = scratch(spark, "daily"), scratch(spark, "daily-state")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet" if _is_folder(spark, f"{sf_dir}/events.parquet") else f"{sf_dir}/events*.parquet")

    def put(batch: DataFrame, k: int) -> None:
        batch.withColumn("batch", F.lit(k)).write.mode("append").parquet(path)

    totals(stream).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(path)
    last = seen.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.select(F.to_date("window.start").alias("day"), "event_type", "s.n", F.round("s.total", 6).alias("total"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads is a folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
