"""Window expressions over one symbol's bars, NULL until their window is full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def symbol():
    """A symbol's bars in order of date.  A call, since a window needs a session."""
    return Window.partitionBy("sym").orderBy("d")


def last_rows(n: int, skip: int = 0):
    """The n rows that end ``skip`` rows before this one."""
    return symbol().rowsBetween(-(n - 1) - skip, -skip)


def gated(agg, x: Column, n: int, least: int | None = None, skip: int = 0) -> Column:
    """``agg(x)`` over n rows where at least ``least`` (default n) of them are not NULL."""
    frame = last_rows(n, skip)
    return F.when(F.count(x).over(frame) >= (least or n), agg(x).over(frame))


def lagged(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(symbol())


def change(x: Column, n: int = 1) -> Column:
    """x over its value n rows before, less 1."""
    return F.try_divide(x, lagged(x, n)) - 1


def with_returns(bars: DataFrame) -> DataFrame:
    """Bars with ret and lr, the simple and the log return; both NULL on the first bar."""
    ratio = F.try_divide(F.col("c"), lagged(F.col("c")))
    return bars.withColumn("ret", ratio - 1).withColumn("lr", F.ln(ratio))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` at or before ``at``, for each key ``by``.

    A union of both sides and one running ``last`` over their common order: linear, and one
    shuffle on ``by`` whatever the sizes.  Rows of ``right`` with NULL values count as rows:
    their NULLs are taken.  Ties of ``at`` on the right must not occur.
    """
    tagged = left.withColumn("__side", F.lit(1)).unionByName(right.select(*by, at, F.struct(*values).alias("__value")).withColumn("__side", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(F.col(at).asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = tagged.withColumn("__value", F.last("__value", ignorenulls=True).over(order)).where("__side = 1")
    return seen.select(*left.columns, *(F.col("__value")[v].alias(v) for v in values))
