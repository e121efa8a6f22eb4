"""A stored graph whose edges are merged by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that edges are dealt to by key; a merge writes those with changed keys anew.
BUCKETS = 16


class EdgeStore:
    """Edges (subject, relation, object, confidence, provenance) under ``path``, one row for each (subject, relation, object).

    A folder is never changed: a merge writes a new version of each folder it touches, and the newest version is the one that counts.
    """

    KEY = ("subject", "relation", "object")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def create(cls, edges: DataFrame, path: str) -> EdgeStore:
        """Store ``edges`` under a new ``path``."""
        store = cls(edges.sparkSession, path)
        store._write(store._merged(edges.withColumn("turn", F.lit(0))), 0)
        return store

    @classmethod
    def _bucket(cls) -> Column:
        return F.pmod(F.xxhash64(*cls.KEY), F.lit(BUCKETS)).cast("int")

    @classmethod
    def _merged(cls, rows: DataFrame) -> DataFrame:
        """One row for each key of ``rows`` (..., turn): the last turn's confidence, the highest of it; ids of all turns, each once, in the order of turns."""
        last = F.max(F.struct("turn", "confidence")).alias("last")
        ids = F.array_sort(F.collect_set(F.struct("turn", "provenance"))).alias("lists")
        united = F.array_distinct(F.flatten(F.transform("lists", lambda x: x["provenance"])))
        return rows.groupBy(*cls.KEY).agg(last, ids).select(*cls.KEY, F.col("last.confidence").alias("confidence"), united.alias("provenance"))

    def _write(self, edges: DataFrame, version: int) -> None:
        rows = edges.withColumns({"bucket": self._bucket(), "version": F.lit(version)}).repartition(BUCKETS, "bucket")
        rows.write.mode("append").partitionBy("bucket", "version").parquet(f"{self.path}/edges")

    def _versions(self) -> dict[int, int]:
        """The newest version of each folder."""
        rows = self._all().groupBy("bucket").agg(F.max("version").alias("version"))
        return {r.bucket: r.version for r in rows.collect()}

    def _all(self) -> DataFrame:
        schema = "subject string, relation string, object string, confidence double, provenance array<string>, bucket int, version int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/edges")

    def _of(self, versions: dict[int, int]) -> DataFrame:
        newest = F.lit(False)
        for bucket, version in versions.items():
            newest = newest | ((F.col("bucket") == bucket) & (F.col("version") == version))
        return self._all().where(newest)

    def edges(self) -> DataFrame:
        """The edges that count; only their folders are opened."""
        return self._of(self._versions()).drop("bucket", "version")

    def merge(self, new: DataFrame) -> None:
        """Upsert ``new`` edges: known keys take their confidence and unite their provenance, other keys are added.

        Only folders with keys of ``new`` are read and written.  Repeated keys of ``new`` are one; the highest confidence among them counts.
        """
        new = new.select(*self.KEY, "confidence", "provenance").withColumn("bucket", self._bucket())
        touched = {r.bucket for r in new.select("bucket").distinct().collect()}
        versions = self._versions()
        old = self._of({k: v for k, v in versions.items() if k in touched}).drop("version")
        both = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1))).drop("bucket")
        self._write(self._merged(both), max(versions.values(), default=-1) + 1)
