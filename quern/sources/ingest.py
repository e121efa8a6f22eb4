"""Day-partitioned news streams, and filings taken in once across restarts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.payloads import with_texts


def theme_predicate(themes: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a text of themes holds any of the patterns, in any case."""
    return F.coalesce(themes.rlike(f"(?i)({'|'.join(patterns)})"), F.lit(False))


def news_streams(records: DataFrame, topics: dict[str, tuple[str, ...]]) -> DataFrame:
    """(stream, day, key, article_count, tone_mean, tone_std) of records (day, tone, themes, tickers), from one scan and one shuffle.

    A record counts in the market stream once if it meets any topic, in that of each topic it meets and in that of each of its tickers.
    """
    hits = {name: theme_predicate(F.col("themes"), patterns) for name, patterns in topics.items()}
    entry = lambda stream, key: F.struct(F.lit(stream).alias("stream"), key.alias("key"))
    met = [F.when(hit, entry("topics", F.lit(name))) for name, hit in hits.items()]
    anything = F.lit(False)
    for hit in hits.values():
        anything = anything | hit
    tickers = F.transform(F.coalesce("tickers", F.array().cast("array<string>")), lambda t: entry("per_ticker", t))
    keys = F.concat(F.array_compact(F.array(*met, F.when(anything, entry("market", F.lit(""))))), tickers)
    return (
        records.select("day", "tone", F.inline(keys))
        .groupBy("stream", "day", "key")
        .agg(F.count(F.lit(1)).alias("article_count"), F.round(F.avg("tone"), 6).alias("tone_mean"), F.round(F.coalesce(F.stddev_samp("tone"), F.lit(0.0)), 6).alias("tone_std"))
    )


def ingest_news(records: DataFrame, path: str, start: str, end: str, topics: dict[str, tuple[str, ...]]) -> None:
    """Write the streams of the days from ``start`` to before ``end`` to ``path``, a folder for each stream and day.

    The window is a filter on ``day``, so records stored by day are opened for these days alone.  Days written before are replaced, all
    others stay as they are; a stream's day without any record now keeps what it had.
    """
    window = (F.col("day") >= F.lit(start).cast("date")) & (F.col("day") < F.lit(end).cast("date"))
    rows = news_streams(records.where(window), topics)
    rows.repartition("stream", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stream", "day").parquet(path)


def news_table(spark: SparkSession, path: str) -> DataFrame:
    """(stream, day, key, article_count, tone_mean, tone_std) of all days taken in; conditions on stream and day choose folders."""
    schema = "key string, article_count long, tone_mean double, tone_std double, stream string, day date"
    return spark.read.schema(schema).parquet(path).select("stream", "day", "key", "article_count", "tone_mean", "tone_std")


def bundle(files: DataFrame, folder: str) -> None:
    """Pack files (path, content) into bundles under ``folder``: Parquet files of these two columns, as many as tasks write, however many files are packed."""
    files.select("path", "content").write.mode("append").parquet(folder)


class FilingStore:
    """Filings under ``path``, each taken in once, whatever is restarted or listed again.

    A stream of files with a checkpoint sees new files only; the manifest holds the accession of each filing taken in, so one that
    comes again under another name is left out.  A batch writes a folder by its number, so a batch that is run again replaces itself.
    Filings come as files of their own or, where they are many, in bundles: each file costs a store and the driver some calls, a filing in a bundle none.
    """

    FILINGS = "accession string, ticker string, form string, day string, path string, sha256 string, text string, n_lines long, batch long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def filings(self) -> DataFrame:
        """(accession, ticker, form, day, path, sha256, text, n_lines, batch) of all filings taken in."""
        return self.spark.read.schema(self.FILINGS).parquet(f"{self.path}/filings")

    def _batch(self, files: DataFrame, number: int) -> None:
        """Take in files .../TICKER/FORM/DAY/name (path, content); folders may be written NAME=VALUE."""
        parts = F.transform(F.reverse(F.split("path", "/")), lambda x: F.regexp_replace(x, "^[^=]*=", ""))
        rows = files.select("path", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("html"), parts[3].alias("ticker"), parts[2].alias("form"), parts[1].alias("day"))
        rows = rows.withColumn("accession", F.concat_ws("-", "ticker", "form", "day"))
        rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("accession").orderBy("path"))).where("turn = 1").drop("turn")
        known = self.spark.read.schema("accession string, batch long").parquet(f"{self.path}/manifest").where(F.col("batch") != number)
        new = rows.join(known.select("accession").hint("merge"), "accession", "left_anti")  # rows lie by accession already; the manifest grows with the store
        out = with_texts(new.select("accession", "ticker", "form", "day", "path", "sha256", "html"))  # files are read once
        out.write.mode("overwrite").parquet(f"{self.path}/filings/batch={number}")
        stored = self.spark.read.parquet(f"{self.path}/filings/batch={number}")
        stored.select("accession").write.mode("overwrite").parquet(f"{self.path}/manifest/batch={number}")

    def ingest(self, folder: str, names: str = "filing.html", per_batch: int = 10_000) -> None:
        """Take in the files ``names`` anywhere under ``folder`` that no earlier call has taken in, ``per_batch`` at a time."""
        schema = "path string, modificationTime timestamp, length long, content binary"
        files = self.spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", names).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
        self._run(files, "checkpoint", self._batch)

    def ingest_bundles(self, folder: str, per_batch: int = 10_000) -> None:
        """Take in the filings of the bundles under ``folder`` that no earlier call has taken in, ``per_batch`` bundles at a time.

        The stream has a checkpoint and numbers of its own: its batches count down from -2, and so replace none of ``ingest``.
        """
        bundles = self.spark.readStream.format("parquet").schema("path string, content binary").option("maxFilesPerTrigger", per_batch).load(folder)
        self._run(bundles, "checkpoint-bundles", lambda files, number: self._batch(files, -2 - number))

    def _run(self, files: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
        self.spark.createDataFrame([], "accession string").write.mode("overwrite").parquet(f"{self.path}/manifest/batch=-1")
        run = files.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.path}/{checkpoint}").trigger(availableNow=True).start()
        run.awaitTermination()
