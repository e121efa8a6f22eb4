"""Domain inputs as views of the driver's tables, and the same views as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; filters and columns reach its scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (sym, d, o, h, l, c, v) of part brands.

    The part side is two columns; Spark broadcasts it when it is small enough.
    """
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("sym"))
    px = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    trades = table(spark, sf_dir, "lineitem").join(part, "l_partkey").select("sym", F.to_date("l_shipdate").alias("d"), px.alias("px"), order.alias("k"), "l_quantity")
    return trades.groupBy("sym", "d").agg(
        F.min_by("px", "k").alias("o"), F.max("px").alias("h"), F.min("px").alias("l"), F.max_by("px", "k").alias("c"), F.sum("l_quantity").cast("long").alias("v")
    )


BARS = """bars AS (
  SELECT sym, d, arg_min(px, k) AS o, max(px) AS h, min(px) AS l, arg_max(px, k) AS c, CAST(sum(l_quantity) AS BIGINT) AS v
  FROM (SELECT p_brand AS sym, CAST(l_shipdate AS DATE) AS d, l_extendedprice / l_quantity AS px, l_quantity,
               row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS k
        FROM lineitem JOIN part ON l_partkey = p_partkey)
  GROUP BY sym, d)"""


def index_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market index on its own, sparser calendar: root of the mean order value on days with an order of high priority."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority in ('1-URGENT', '2-HIGH')")
    return o.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sqrt(F.avg("o_totalprice")).alias("x"))


INDEX = """idx AS (
  SELECT CAST(o_orderdate AS DATE) AS d, sqrt(avg(o_totalprice)) AS x FROM orders
  WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News records (event_id, dt, day, tone, tickers, political, epu, presidential) of events."""
    kind = F.col("event_type")
    ticker = lambda c: F.concat(F.lit("T"), c.cast("string"))
    tickers = F.array_compact(F.array(F.when(kind != "error", ticker(F.col("user_id"))), F.when(F.col("event_id") % 5 == 0, ticker((F.col("user_id") + 1) % 50))))
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").alias("dt"), F.to_date("ts").alias("day"), ((F.col("value") - 50) / 10).alias("tone"), tickers.alias("tickers"),
        kind.isin("view", "signup").alias("political"), (kind == "purchase").alias("epu"), ((kind == "signup") & (F.col("event_id") % 3 == 0)).alias("presidential"),
    )


RECORDS = """records AS (
  SELECT event_id, ts AS dt, CAST(ts AS DATE) AS day, (value - 50) / 10 AS tone,
    list_filter([CASE WHEN event_type <> 'error' THEN 'T' || user_id END, CASE WHEN event_id % 5 = 0 THEN 'T' || ((user_id + 1) % 50) END], lambda t: t IS NOT NULL) AS tickers,
    event_type IN ('view', 'signup') AS political, event_type = 'purchase' AS epu, event_type = 'signup' AND event_id % 3 = 0 AS presidential
  FROM events)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insider-like transactions of line items; sym is the part's brand."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("sym"))
    li = table(spark, sf_dir, "lineitem").join(part, "l_partkey")
    return li.select(
        "sym", F.to_date("l_shipdate").alias("filing_date"), F.when(F.col("l_returnflag") == "N", "P").otherwise("S").alias("code"),
        F.when(F.col("l_returnflag") == "N", "A").otherwise("D").alias("ad"), F.col("l_quantity").alias("shares"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_suppkey").cast("double") + F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0)).alias("owned_after"),
        F.when(F.col("l_suppkey") % 4 == 0, "Chief Executive Officer").when(F.col("l_suppkey") % 4 == 1, "EVP and CFO").when(F.col("l_suppkey") % 4 == 2, "Director").alias("title"),
        (F.col("l_tax") >= 0.07).alias("planned"),
    )


TRADES = """trades AS (
  SELECT p_brand AS sym, CAST(l_shipdate AS DATE) AS filing_date, CASE WHEN l_returnflag = 'N' THEN 'P' ELSE 'S' END AS code,
    CASE WHEN l_returnflag = 'N' THEN 'A' ELSE 'D' END AS ad, l_quantity AS shares, l_extendedprice / l_quantity AS price,
    CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_suppkey AS DOUBLE) + CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END END AS owned_after,
    CASE l_suppkey % 4 WHEN 0 THEN 'Chief Executive Officer' WHEN 1 THEN 'EVP and CFO' WHEN 2 THEN 'Director' END AS title, l_tax >= 0.07 AS planned
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def earnings_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sym, e): each symbol's first bar of a quarter."""
    return earnings_of(bars(spark, sf_dir))


def earnings_of(bars: DataFrame) -> DataFrame:
    """The same from ``bars`` that are there."""
    return bars.groupBy("sym", F.trunc("d", "quarter").alias("q")).agg(F.min("d").alias("e")).select("sym", "e")


EARNINGS = "earnings AS (SELECT sym, min(d) AS e FROM bars GROUP BY sym, date_trunc('quarter', d))"
