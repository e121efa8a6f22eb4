"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, as in the pattern ``[^\x20\x09-\x0D]+`` of a word.
SPACE = "\\x20\\x09-\\x0D"
#: Rows of an Arrow batch that are worked on at once; Spark bounds a batch in bytes, not what is made of it.
BATCH_ROWS = 2000
#: Keys at most that a counted join tells to all tasks.
HUBS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    On one machine, where it is unset, a temporary folder is taken and removed at the end; a cluster without one is an
    error, since each executor would write to its own disk.
    """
    conf = spark.sparkContext.getConf()
    if not (path := conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)):
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: lineage ends, a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """What a task has freed goes back to the system, as Python workers live on and the next stage's memory comes on top."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of glibc alone
        ctypes.CDLL(None).malloc_trim(0)


def sliced(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` on slices of BATCH_ROWS rows of each batch."""

    def rows(batches: Batches) -> Batches:
        try:
            yield from work(batch.slice(lo, BATCH_ROWS) for batch in batches for lo in range(0, batch.num_rows, BATCH_ROWS))
        finally:
            give_back()

    return rows


def join_counted(rows: DataFrame, side: DataFrame, keys: list[str], n: str, total: int | None = None) -> DataFrame:
    """``rows`` joined on ``keys`` with ``side`` (unique keys; a stored table, unless ``total`` is given), whose column ``n`` counts the rows of each key.

    Keys with more than one in HUBS of all rows (``total``, or more), fewer than HUBS of them, are broadcast; the rest is
    joined as Spark sees fit, and no key of it is more than a small share of a task.
    """
    if total is None:
        total = side.agg(F.sum(n)).first()[0] or 0
    hot, cold = side.where(F.col(n) * HUBS > total), side.where(F.col(n) * HUBS <= total)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return rows.join(F.broadcast(hot), keys).unionByName(others)


def unused(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
