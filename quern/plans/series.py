"""Queries over bar series: windows, as-of joins, features, forecasts and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.windows import symbol, YEAR, as_of, change, gated, lagged, last_rows, with_returns
from quern.operators import forecast as fc
from quern.operators import indicators
from quern.plans.base import query, stored
from quern.sources import views
from quern.sources.views import BARS, EARNINGS, INDEX, TRADES


def r6(x: Column) -> Column:
    return F.round(x, 6)


def rounded(df: DataFrame, keys: list[str], **cols: Column) -> DataFrame:
    return df.select(*keys, *(r6(x).alias(n) for n, x in cols.items()))


#: Bars with the last close, and simple and log returns.
RETURNS = f"""{BARS}, rets AS (
  SELECT *, c / pc - 1 AS ret, ln(c / pc) AS lr FROM (SELECT *, lag(c) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d)))"""


def win(n: int, skip: int = 0) -> str:
    return f"(PARTITION BY sym ORDER BY d ROWS BETWEEN {n - 1 + skip} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"


def sql_gated(agg: str, x: str, n: int, least: int | None = None, skip: int = 0) -> str:
    return f"CASE WHEN count({x}) OVER {win(n, skip)} >= {least or n} THEN {agg}({x}) OVER {win(n, skip)} END"


# sources and checks ----------------------------------------------------------------------


@query(f"WITH {BARS} SELECT sym, d, round(o, 8) AS o, round(h, 8) AS h, round(l, 8) AS l, round(c, 8) AS c, v FROM bars")
def bars_view(spark, sf_dir):
    """OHLCV bars out of trades."""
    return views.bars(spark, sf_dir).select("sym", "d", *(F.round(x, 8).alias(x) for x in "ohlc"), "v")


def _vendor(bars: DataFrame) -> DataFrame:
    """Bars as a vendor may send them: some opens NaN, highs and lows off, volumes missing."""
    day = F.dayofmonth("d")
    return bars.select(
        "sym", "d", F.when(day == 13, F.lit(float("nan"))).otherwise(F.col("o")).alias("o"), F.when(day == 5, F.col("h") * 0.9).otherwise(F.col("h")).alias("h"),
        F.when(day == 7, F.col("l") * 1.1).otherwise(F.col("l")).alias("l"), "c", F.when(day == 9, None).otherwise(F.col("v")).alias("v"),
    )


_VENDOR = """vendor AS (SELECT sym, d, CASE WHEN day(d) = 13 THEN CAST('nan' AS DOUBLE) ELSE o END AS o, CASE WHEN day(d) = 5 THEN h * 0.9 ELSE h END AS h,
  CASE WHEN day(d) = 7 THEN l * 1.1 ELSE l END AS l, c, CASE WHEN day(d) = 9 THEN NULL ELSE v END AS v FROM bars)"""


@query(
    f"WITH {BARS}, {_VENDOR} SELECT sym, d, round(o, 8) AS o, round(greatest(o, c, h, l), 8) AS h, round(least(o, c, h, l), 8) AS l, round(c, 8) AS c, coalesce(v, 0) AS v FROM vendor WHERE NOT isnan(o) AND NOT isnan(c)"
)
def bars_repair_ohlc(spark, sf_dir):
    """Drop bars without open or close, widen high and low over all prices, zero missing volumes."""
    b = _vendor(views.bars(spark, sf_dir)).where("o is not null and c is not null and not isnan(o) and not isnan(c)")
    return b.select("sym", "d", F.round("o", 8).alias("o"), F.round(F.greatest("o", "c", "h", "l"), 8).alias("h"), F.round(F.least("o", "c", "h", "l"), 8).alias("l"), F.round("c", 8).alias("c"), F.coalesce("v", F.lit(0)).alias("v"))


@query(f"WITH {BARS} SELECT sym, d, round(coalesce(CASE WHEN v % 5 = 0 THEN NULL ELSE c * 0.5 END, c), 9) AS adjusted FROM bars")
def bars_adjusted_close(spark, sf_dir):
    """The adjusted close where there is one, else the close."""
    adjusted = F.when(F.col("v") % 5 != 0, F.col("c") * 0.5)
    return views.bars(spark, sf_dir).select("sym", "d", F.round(F.coalesce(adjusted, "c"), 9).alias("adjusted"))


@query(
    f"""WITH {BARS}, gaps AS (SELECT sym, d, date_diff('day', lag(d) OVER (PARTITION BY sym ORDER BY d), d) AS gap FROM bars),
    per AS (SELECT sym, count(*) AS n, max(d) AS last FROM bars GROUP BY sym)
    SELECT sym, 'date_gap' AS issue, d, CAST(gap AS BIGINT) AS detail FROM gaps WHERE gap > 5
    UNION ALL SELECT sym, 'short_history', NULL, n FROM per WHERE n < 200
    UNION ALL SELECT sym, 'future_date', last, NULL FROM per WHERE last > DATE '2001-12-01'
    UNION ALL SELECT sym, 'stale_data', last, date_diff('day', last, DATE '2001-12-01') FROM per WHERE last < DATE '2001-12-01' - 5"""
)
def bars_validate_issues(spark, sf_dir):
    """Issue rows of a series: gaps over 5 days, short history, bars past today, stale data; today is 2001-12-01."""
    b, today = views.bars(spark, sf_dir).select("sym", "d"), F.lit("2001-12-01").cast("date")
    gap = F.datediff("d", lagged(F.col("d")))
    gaps = b.withColumn("gap", gap).where("gap > 5").select("sym", F.lit("date_gap").alias("issue"), "d", F.col("gap").cast("long").alias("detail"))
    per = b.groupBy("sym").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("last"))
    short = per.where("n < 200").select("sym", F.lit("short_history"), F.lit(None).cast("date"), "n")
    future = per.where(F.col("last") > today).select("sym", F.lit("future_date"), "last", F.lit(None).cast("long"))
    stale = per.where(F.col("last") < F.date_sub(today, 5)).select("sym", F.lit("stale_data"), "last", F.datediff(today, "last").cast("long"))
    return gaps.union(short).union(future).union(stale)


@query(
    f"""WITH {BARS}, {_VENDOR} SELECT sym, d, CASE WHEN h < l OR o > h OR o < l OR c > h OR c < l THEN 'ohlc' ELSE 'order' END AS broken
    FROM (SELECT *, lag(d) OVER (PARTITION BY sym ORDER BY d) AS pd FROM vendor WHERE NOT isnan(o)) WHERE h < l OR o > h OR o < l OR c > h OR c < l OR d <= pd"""
)
def bars_constraint_violations(spark, sf_dir):
    """Rows against low <= open, close <= high, or out of strict date order."""
    b = _vendor(views.bars(spark, sf_dir)).where("not isnan(o)").withColumn("pd", lagged(F.col("d")))
    bad = F.expr("h < l or o > h or o < l or c > h or c < l")
    return b.where(bad | (F.col("d") <= F.col("pd"))).select("sym", "d", F.when(bad, "ohlc").otherwise("order").alias("broken"))


# windows ---------------------------------------------------------------------------------


@query(
    f"WITH {RETURNS} SELECT sym, d, round(ret, 6) AS ret, round(lr, 6) AS log_ret, round(CASE WHEN row_number() OVER w > 1 THEN c / first_value(c) OVER w - 1 END, 6) AS cum_ret FROM rets WINDOW w AS (PARTITION BY sym ORDER BY d)"
)
def returns_block(spark, sf_dir):
    """Simple, log and cumulative returns."""
    b = with_returns(views.bars(spark, sf_dir))
    total = F.when(F.row_number().over(symbol()) > 1, F.col("c") / F.first("c").over(symbol()) - 1)
    return rounded(b, ["sym", "d"], ret=F.col("ret"), log_ret=F.col("lr"), cum_ret=total)


@query(f"WITH {RETURNS} SELECT sym, d, round(o / pc - 1, 6) AS overnight, round(c / o - 1, 6) AS intraday FROM rets")
def session_returns(spark, sf_dir):
    """Close to open, and open to close."""
    return rounded(views.bars(spark, sf_dir), ["sym", "d"], overnight=F.col("o") / lagged(F.col("c")) - 1, intraday=F.col("c") / F.col("o") - 1)


@query(f"WITH {BARS} SELECT sym, d, " + ", ".join(f"round({sql_gated('avg', 'c', n)}, 6) AS ma{n}" for n in (20, 50, 200)) + " FROM bars")
def sma_block(spark, sf_dir):
    """Moving averages over 20, 50 and 200 bars."""
    return rounded(views.bars(spark, sf_dir), ["sym", "d"], **{f"ma{n}": gated(F.avg, F.col("c"), n) for n in (20, 50, 200)})


@query(f"WITH {BARS} SELECT sym, d, round(c / {sql_gated('max', 'c', 252, 20).replace('CASE', '(CASE').replace('END', 'END)')} - 1, 6) AS from_high FROM bars")
def pct_from_high(spark, sf_dir):
    """Close below the highest of 252 bars, from 20 bars on."""
    return rounded(views.bars(spark, sf_dir), ["sym", "d"], from_high=F.col("c") / gated(F.max, F.col("c"), 252, 20) - 1)


@query(f"WITH {RETURNS} SELECT sym, d, round({sql_gated('stddev_samp', 'lr', 20)} * sqrt(252), 6) AS vol20, round({sql_gated('stddev_samp', 'lr', 60)} * sqrt(252), 6) AS vol60 FROM rets")
def hist_vol(spark, sf_dir):
    """Yearly volatility of log returns over 20 and 60 bars."""
    b = with_returns(views.bars(spark, sf_dir))
    return rounded(b, ["sym", "d"], **{f"vol{n}": gated(F.stddev_samp, F.col("lr"), n) * YEAR**0.5 for n in (20, 60)})


_B = f"(c - ({sql_gated('avg', 'c', 20)} - 2 * {sql_gated('stddev_samp', 'c', 20)})) / nullif(4 * {sql_gated('stddev_samp', 'c', 20)}, 0)"


def percent_b(c: Column, n: int = 20) -> Column:
    mid, sd = gated(F.avg, c, n), gated(F.stddev_samp, c, n)
    return F.try_divide(c - (mid - 2 * sd), 4 * sd)


@query(f"WITH {BARS} SELECT sym, d, round({_B}, 6) AS percent_b FROM bars")
def bollinger_b(spark, sf_dir):
    """Place of the close within its 20-bar bands."""
    return rounded(views.bars(spark, sf_dir), ["sym", "d"], percent_b=percent_b(F.col("c")))


@query(f"WITH {BARS}, dd AS (SELECT sym, d, c / max(c) OVER (PARTITION BY sym ORDER BY d) - 1 AS x FROM bars) SELECT sym, d, round(x, 6) AS drawdown, round(min(x) OVER (PARTITION BY sym ORDER BY d), 6) AS max_drawdown FROM dd")
def drawdown(spark, sf_dir):
    """Close below its running peak, and the worst so far."""
    so_far = symbol().rowsBetween(Window.unboundedPreceding, 0)
    b = views.bars(spark, sf_dir).withColumn("x", F.col("c") / F.max("c").over(so_far) - 1)
    return rounded(b, ["sym", "d"], drawdown=F.col("x"), max_drawdown=F.min("x").over(so_far))


def sample_skew(x: Column, n: int) -> Column:
    """Bias-corrected skewness over n rows."""
    return gated(F.skewness, x, n) * F.lit((n * (n - 1)) ** 0.5 / (n - 2))


@query(f"WITH {RETURNS} SELECT sym, d, round({sql_gated('skewness', 'lr', 60)}, 6) AS skew60 FROM rets")
def realized_skew(spark, sf_dir):
    """Bias-corrected skewness of 60 log returns."""
    return rounded(with_returns(views.bars(spark, sf_dir)), ["sym", "d"], skew60=sample_skew(F.col("lr"), 60))


_SEMI = f"sqrt({sql_gated('avg', 'dn', 60)}) / nullif(sqrt({sql_gated('avg', 'up', 60)}), 0)"


def semivol(lr: Column, n: int = 60) -> Column:
    side = lambda f: F.when(lr.isNotNull(), F.pow(f(lr, F.lit(0.0)), 2))
    return F.try_divide(F.sqrt(gated(F.avg, side(F.least), n)), F.sqrt(gated(F.avg, side(F.greatest), n)))


@query(f"WITH {RETURNS} SELECT sym, d, round({_SEMI}, 6) AS ratio FROM (SELECT *, CASE WHEN lr IS NOT NULL THEN pow(least(lr, 0), 2) END AS dn, CASE WHEN lr IS NOT NULL THEN pow(greatest(lr, 0), 2) END AS up FROM rets)")
def semivol_ratio(spark, sf_dir):
    """Downside over upside semideviation of 60 log returns."""
    return rounded(with_returns(views.bars(spark, sf_dir)), ["sym", "d"], ratio=semivol(F.col("lr")))


def rel_volume_of(v: Column, n: int = 20) -> Column:
    return F.try_divide(v, gated(F.avg, v, n, skip=1))


@query(f"WITH {BARS} SELECT sym, d, round(v / nullif({sql_gated('avg', 'v', 20, skip=1)}, 0), 6) AS rvol FROM bars")
def rel_volume(spark, sf_dir):
    """Volume over the mean of the 20 bars before."""
    return rounded(views.bars(spark, sf_dir), ["sym", "d"], rvol=rel_volume_of(F.col("v").cast("double")))


def dollar_z(cv: Column, n: int = 20) -> Column:
    return F.try_divide(cv - gated(F.avg, cv, n, skip=1), gated(F.stddev_samp, cv, n, skip=1))


@query(f"WITH {BARS} SELECT sym, d, round((cv - {sql_gated('avg', 'cv', 20, skip=1)}) / nullif({sql_gated('stddev_samp', 'cv', 20, skip=1)}, 0), 6) AS z FROM (SELECT *, c * v AS cv FROM bars)")
def dollar_volume_z(spark, sf_dir):
    """Traded value against the 20 bars before, in deviations."""
    b = views.bars(spark, sf_dir).withColumn("cv", F.col("c") * F.col("v"))
    return rounded(b, ["sym", "d"], z=dollar_z(F.col("cv")))


def ema_sql(x: str, span: int) -> str:
    """EMA over the rows so far; x is never NULL."""
    a = f"(2.0 / {span + 1})"
    return f"list_reduce(list({x}) OVER s, lambda p, x: CAST({a} AS DOUBLE) * x + (1 - CAST({a} AS DOUBLE)) * p)"


def wilder_sql(values: str, n: int = 14) -> str:
    """Wilder's mean of a list of values that are all there."""
    return f"CASE WHEN len({values}) >= {n} THEN list_reduce(list_concat([list_avg({values}[1:{n}])], {values}[{n + 1}:]), lambda p, x: (p * {n - 1} + x) / {n}) END"


_SOFAR = "WINDOW s AS (PARTITION BY sym ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
RECURSIVE = f"""{RETURNS}, lines AS (SELECT sym, d, {ema_sql('c', 12)} - {ema_sql('c', 26)} AS line FROM bars {_SOFAR}),
  macds AS (SELECT sym, d, line, {ema_sql('line', 9)} AS sig FROM lines {_SOFAR}),
  moves AS (SELECT sym, d, list(greatest(c - pc, 0)) FILTER (pc IS NOT NULL) OVER s AS gains, list(greatest(pc - c, 0)) FILTER (pc IS NOT NULL) OVER s AS losses,
            list(greatest(h - l, coalesce(abs(h - pc), 0), coalesce(abs(l - pc), 0))) OVER s AS ranges FROM rets {_SOFAR}),
  wilders AS (SELECT sym, d, {wilder_sql('gains')} AS gain, {wilder_sql('losses')} AS loss, {wilder_sql('ranges')} AS atr14 FROM moves),
  recursive_ AS (SELECT sym, d, line AS macd, sig AS macd_signal, line - sig AS macd_hist, atr14,
    CASE WHEN gain IS NULL THEN NULL WHEN loss = 0 AND gain = 0 THEN 50 WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi14 FROM macds JOIN wilders USING (sym, d))"""


@query(f"WITH {RECURSIVE} SELECT sym, d, round(rsi14, 6) AS rsi14 FROM recursive_")
def rsi_wilder(spark, sf_dir):
    """Relative strength over 14 bars."""
    return rounded(indicators.recursive_indicators(views.bars(spark, sf_dir), ("rsi14",)), ["sym", "d"], rsi14=F.col("rsi14"))


@query(f"WITH {RECURSIVE} SELECT sym, d, round(macd, 6) AS macd, round(macd_signal, 6) AS macd_signal, round(macd_hist, 6) AS macd_hist FROM recursive_")
def macd_ema(spark, sf_dir):
    """MACD line, signal and histogram (12, 26, 9)."""
    return rounded(indicators.recursive_indicators(views.bars(spark, sf_dir), ("macd",)), ["sym", "d"], **{c: F.col(c) for c in ("macd", "macd_signal", "macd_hist")})


@query(f"WITH {RECURSIVE} SELECT sym, d, round(atr14, 6) AS atr14 FROM recursive_")
def atr_wilder(spark, sf_dir):
    """Average true range over 14 bars."""
    return rounded(indicators.recursive_indicators(views.bars(spark, sf_dir), ("atr14",)), ["sym", "d"], atr14=F.col("atr14"))


def trend(c: Column, ma50: Column, ma200: Column) -> Column:
    up, down = (c > ma50) & (ma200.isNull() | (ma50 > ma200)), (c < ma50) & (ma200.isNull() | (ma50 < ma200))
    return F.when(ma50.isNull(), "insufficient_data").when(up, "uptrend").when(down, "downtrend").otherwise("sideways")


_TREND = "CASE WHEN ma50 IS NULL THEN 'insufficient_data' WHEN c > ma50 AND (ma200 IS NULL OR ma50 > ma200) THEN 'uptrend' WHEN c < ma50 AND (ma200 IS NULL OR ma50 < ma200) THEN 'downtrend' ELSE 'sideways' END"


@query(f"WITH {BARS}, mas AS (SELECT sym, d, c, {sql_gated('avg', 'c', 50)} AS ma50, {sql_gated('avg', 'c', 200)} AS ma200 FROM bars) SELECT sym, d, {_TREND} AS trend FROM mas")
def trend_label(spark, sf_dir):
    """Uptrend, downtrend or sideways by the close and its averages."""
    b = views.bars(spark, sf_dir)
    return b.select("sym", "d", trend(F.col("c"), gated(F.avg, F.col("c"), 50), gated(F.avg, F.col("c"), 200)).alias("trend"))


_SNAP = ["last_return", "ma20", "ma50", "ma200", "vol20", "worst", "rsi14", "macd", "macd_signal", "macd_hist", "atr14"]


def snapshot(bars: DataFrame) -> DataFrame:
    """The last bar of each symbol with its indicators and trend."""
    b = with_returns(indicators.recursive_indicators(bars))
    peak = symbol().rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("dd", F.col("c") / F.max("c").over(peak) - 1).select(
        "*", F.col("ret").alias("last_return"), *(gated(F.avg, F.col("c"), n).alias(f"ma{n}") for n in (20, 50, 200)), (gated(F.stddev_samp, F.col("lr"), 20) * YEAR**0.5).alias("vol20")
    )
    last = b.groupBy("sym").agg(F.max_by(F.struct("d", "c", *[x for x in _SNAP if x != "worst"]), "d").alias("s"), F.min("dd").alias("worst"))
    return last.select("sym", "s.*", "worst").withColumn("trend", trend(F.col("c"), F.col("ma50"), F.col("ma200")))


SNAPSHOT = f"""{RECURSIVE}, enriched AS (SELECT sym, d, c, ret AS last_return, {', '.join(f"{sql_gated('avg', 'c', n)} AS ma{n}" for n in (20, 50, 200))},
  {sql_gated('stddev_samp', 'lr', 20)} * sqrt(252) AS vol20, c / max(c) OVER (PARTITION BY sym ORDER BY d) - 1 AS dd FROM rets),
  snap AS (SELECT *, (SELECT min(dd) FROM enriched x WHERE x.sym = e.sym) AS worst, {_TREND} AS trend FROM enriched e JOIN recursive_ USING (sym, d)
           WHERE d = (SELECT max(d) FROM bars b WHERE b.sym = e.sym))"""


@query(f"WITH {SNAPSHOT} SELECT sym, d, trend, round(c, 8) AS last_close, {', '.join(f'round({x}, 6) AS {x}' for x in _SNAP)} FROM snap")
def indicator_snapshot(spark, sf_dir):
    """All indicators at each symbol's last bar."""
    return snapshot(views.bars(spark, sf_dir)).select("sym", "d", "trend", F.round("c", 8).alias("last_close"), *(r6(F.col(x)).alias(x) for x in _SNAP))


@query(
    f"""WITH {SNAPSHOT}, flags AS (SELECT sym, list_filter([CASE WHEN ma50 > ma200 AND c > ma50 THEN 'uptrend' WHEN ma50 <= ma200 AND c <= ma50 THEN 'downtrend' END,
    CASE WHEN rsi14 >= 70 THEN 'overbought' WHEN rsi14 <= 30 THEN 'oversold' END, CASE WHEN vol20 > 0.5 THEN 'high_volatility' END, CASE WHEN worst < -0.30 THEN 'deep_drawdown' END], lambda x: x IS NOT NULL) AS f FROM snap)
    SELECT sym, array_to_string(f, ',') AS flags, CAST(len(f) AS BIGINT) AS n FROM flags"""
)
def rule_flags(spark, sf_dir):
    """Names of the rules that a symbol's last bar meets: trend by both averages, RSI of 70 and 30, volatility above a half, drawdown below 30 %."""
    s, c = snapshot(views.bars(spark, sf_dir)), F.col
    trend_ = F.when((c("ma50") > c("ma200")) & (c("c") > c("ma50")), "uptrend").when((c("ma50") <= c("ma200")) & (c("c") <= c("ma50")), "downtrend")
    rsi = F.when(c("rsi14") >= 70, "overbought").when(c("rsi14") <= 30, "oversold")
    flags = F.array_compact(F.array(trend_, rsi, F.when(c("vol20") > 0.5, "high_volatility"), F.when(c("worst") < -0.30, "deep_drawdown")))
    return s.select("sym", F.array_join(flags, ",").alias("flags"), F.size(flags).cast("long").alias("n"))


@query(
    f"""WITH {BARS}, ends AS (SELECT sym, max(d) AS e FROM bars GROUP BY sym), near AS (SELECT b.*, e FROM bars b JOIN ends USING (sym) WHERE d >= e - 30),
    two AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY d DESC) AS k FROM (SELECT b.*, e FROM bars b JOIN ends USING (sym))),
    used AS (SELECT t.* FROM two t WHERE d >= e - 30 OR (k <= 2 AND (SELECT count(*) FROM near n WHERE n.sym = t.sym) < 2))
    SELECT sym, count(*) AS n_bars, min(d) AS first_d, round(arg_min(c, d), 8) AS first_c, round(arg_max(c, d), 8) AS last_c, round(arg_max(c, d) / arg_min(c, d) - 1, 6) AS pct, round(max(c), 8) AS high, round(min(c), 8) AS low FROM used GROUP BY sym"""
)
def price_snapshot_30d(spark, sf_dir):
    """Close summary of a symbol's last 30 calendar days, or its last two bars where these hold fewer."""
    b = views.bars(spark, sf_dir).select("sym", "d", "c")
    whole, back = Window.partitionBy("sym"), Window.partitionBy("sym").orderBy(F.desc("d"))
    b = b.withColumn("near", F.col("d") >= F.date_sub(F.max("d").over(whole), 30)).withColumn("k", F.row_number().over(back))
    used = b.where(F.col("near") | (F.col("k") <= 2)).withColumn("n_near", F.count_if("near").over(whole)).where(F.col("near") | (F.col("n_near") < 2))
    first, last = F.min_by("c", "d"), F.max_by("c", "d")
    return used.groupBy("sym").agg(F.count(F.lit(1)).alias("n_bars"), F.min("d").alias("first_d"), F.round(first, 8).alias("first_c"), F.round(last, 8).alias("last_c"), r6(last / first - 1).alias("pct"), F.round(F.max("c"), 8).alias("high"), F.round(F.min("c"), 8).alias("low"))


@query(f"WITH {BARS} SELECT sym, count(*) AS n, round(arg_min(c, d), 8) AS first_c, round(arg_max(c, d), 8) AS last_c, round(arg_max(c, d) / arg_min(c, d) - 1, 6) AS pct, round(max(c), 8) AS high, round(min(c), 8) AS low FROM bars WHERE d >= DATE '1999-01-01' GROUP BY sym")
def price_summary(spark, sf_dir):
    """First and last close, change, extremes and number of bars of a window."""
    b = views.bars(spark, sf_dir).where("d >= date '1999-01-01'")
    first, last = F.min_by("c", "d"), F.max_by("c", "d")
    return b.groupBy("sym").agg(F.count(F.lit(1)).alias("n"), F.round(first, 8).alias("first_c"), F.round(last, 8).alias("last_c"), r6(last / first - 1).alias("pct"), F.round(F.max("c"), 8).alias("high"), F.round(F.min("c"), 8).alias("low"))


# joins -----------------------------------------------------------------------------------


def index_features(index: DataFrame) -> DataFrame:
    """(d, vix_level, vix_rel) on the index's own calendar: one row a day, so one window over it is small."""
    w = Window.orderBy("d").rowsBetween(-19, 0)
    rel = F.when(F.count("x").over(w) >= 20, F.col("x") / F.avg("x").over(w))
    return index.select("d", (F.col("x") / 100).alias("vix_level"), rel.alias("vix_rel"), (F.col("x") / F.lag("x", 20).over(Window.orderBy("d")) - 1).alias("m20"))


INDEX_FEATURES = """idxf AS (SELECT d, x / 100 AS vix_level, CASE WHEN count(x) OVER w >= 20 THEN x / avg(x) OVER w END AS vix_rel, x / lag(x, 20) OVER (ORDER BY d) - 1 AS m20, x / lag(x, 60) OVER (ORDER BY d) - 1 AS m60
  FROM idx WINDOW w AS (ORDER BY d ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def with_index(bars: DataFrame, index: DataFrame, plain: DataFrame | None = None) -> DataFrame:
    """Bars with the index's features as of their day.

    The index has one row a day; it is joined to the distinct days first, so the symbols' bars are never sorted by it.
    ``plain`` are bars of the same days whose plan is shorter.
    """
    days = (bars if plain is None else plain).select("d").distinct().withColumn("one", F.lit(1))
    known = as_of(days, index_features(index).withColumn("one", F.lit(1)), ["one"], "d", ["vix_level", "vix_rel", "m20"])
    return bars.join(known.drop("one"), "d", "left")


@query(f"WITH {BARS}, {INDEX}, {INDEX_FEATURES} SELECT b.sym, b.d, round(i.vix_level, 6) AS vix_level, round(i.vix_rel, 6) AS vix_rel FROM bars b ASOF LEFT JOIN idxf i ON b.d >= i.d")
def asof_market_context(spark, sf_dir):
    """The index's level and its ratio to 20 days, as of each bar."""
    b = with_index(views.bars(spark, sf_dir), views.index_closes(spark, sf_dir))
    return rounded(b, ["sym", "d"], vix_level=F.col("vix_level"), vix_rel=F.col("vix_rel"))


@query(
    f"""WITH {RETURNS}, {INDEX}, {INDEX_FEATURES} SELECT b.sym, b.d, round(b.r20 - i.m20, 6) AS rel_strength
    FROM (SELECT sym, d, c / lag(c, 20) OVER (PARTITION BY sym ORDER BY d) - 1 AS r20 FROM bars) b ASOF LEFT JOIN idxf i ON b.d >= i.d"""
)
def relative_strength(spark, sf_dir):
    """A symbol's 20-bar return less the index's, as of each bar."""
    b = with_index(views.bars(spark, sf_dir), views.index_closes(spark, sf_dir))
    return rounded(b, ["sym", "d"], rel_strength=change(F.col("c"), 20) - F.col("m20"))


def insider_activity_of(trades: DataFrame) -> DataFrame:
    """(sym, filing_date, buy_conviction, senior_buy_n, sell_pressure): discretionary buys and sells, never netted."""
    c = F.col
    prior = c("owned_after") - F.when(c("ad") == "A", c("shares")).otherwise(-c("shares"))
    frac = F.when(prior > 0, c("shares") / prior)
    weight = F.coalesce(F.least(F.abs(frac), F.lit(1.0)), F.lit(1.0))
    senior = F.coalesce(F.lower("title").rlike("chief executive|ceo|chief financial|cfo"), F.lit(False))
    buy, sell = (c("code") == "P") & (c("ad") == "A"), (c("code") == "S") & (c("ad") == "D")
    zero = F.lit(0.0)
    t = trades.where(~c("planned") & (buy | sell))
    return t.groupBy("sym", "filing_date").agg(
        F.sum(F.when(buy, weight).otherwise(zero)).alias("buy_conviction"), F.sum(F.when(buy & senior, F.lit(1.0)).otherwise(zero)).alias("senior_buy_n"), F.sum(F.when(sell, weight).otherwise(zero)).alias("sell_pressure")
    )


ACTIVITY = f"""{TRADES}, weighed AS (SELECT *, coalesce(least(abs(CASE WHEN owned_after - CASE WHEN ad = 'A' THEN shares ELSE -shares END > 0
    THEN shares / (owned_after - CASE WHEN ad = 'A' THEN shares ELSE -shares END) END), 1), 1) AS w,
    coalesce(regexp_matches(lower(title), 'chief executive|ceo|chief financial|cfo'), false) AS senior FROM trades WHERE NOT planned),
  activity AS (SELECT sym, filing_date, sum(CASE WHEN code = 'P' THEN w ELSE 0 END) AS buy_conviction, sum(CASE WHEN code = 'P' AND senior THEN 1.0::DOUBLE ELSE 0 END) AS senior_buy_n,
    sum(CASE WHEN code = 'S' THEN w ELSE 0 END) AS sell_pressure FROM weighed WHERE (code = 'P' AND ad = 'A') OR (code = 'S' AND ad = 'D') GROUP BY sym, filing_date)"""
_ACT = ("buy_conviction", "senior_buy_n", "sell_pressure")


@query(f"WITH {ACTIVITY} SELECT sym, filing_date, {', '.join(f'round({x}, 6) AS {x}' for x in _ACT)} FROM activity")
def insider_activity(spark, sf_dir):
    """Conviction of discretionary insider buys and sells by filing date."""
    return rounded(insider_activity_of(views.trades(spark, sf_dir)), ["sym", "filing_date"], **{x: F.col(x) for x in _ACT})


def insider_rolled(bars: DataFrame, activity: DataFrame) -> DataFrame:
    """Bars with 63-bar sums of the activity on their own dates, from 21 bars on; other filing dates are lost."""
    b = bars.join(activity.withColumnRenamed("filing_date", "d"), ["sym", "d"], "left").fillna(0.0, list(_ACT))
    return b.select(*bars.columns, *(gated(F.sum, F.col(x), 63, 21).alias(f"{x}_63") for x in _ACT))


@query(
    f"""WITH {BARS}, {ACTIVITY}, filled AS (SELECT b.sym, b.d, {', '.join(f'coalesce({x}, 0) AS {x}' for x in _ACT)} FROM bars b LEFT JOIN activity a ON a.sym = b.sym AND a.filing_date = b.d)
    SELECT sym, d, {', '.join(f"round({sql_gated('sum', x, 63, 21)}, 6) AS {x}_63" for x in _ACT)} FROM filled"""
)
def left_zero_fill_activity(spark, sf_dir):
    """Insider activity joined to bars with zeros for none, summed over 63 bars."""
    quarter = views.trades(spark, sf_dir)
    return rounded(insider_rolled(views.bars(spark, sf_dir), insider_activity_of(quarter)), ["sym", "d"], **{f"{x}_63": F.col(f"{x}_63") for x in _ACT})


def cadence(earnings: DataFrame) -> DataFrame:
    """(sym, cadence): median days between dates, over gaps of 30 to 200 days if there are any; 91 with fewer than two dates."""
    gap = F.datediff("e", F.lag("e").over(Window.partitionBy("sym").orderBy("e")))
    g = earnings.withColumn("gap", gap)
    good = F.percentile(F.when(F.col("gap").between(30, 200), F.col("gap")), 0.5)
    return g.groupBy("sym").agg(F.coalesce(good, F.percentile("gap", 0.5), F.lit(91.0)).alias("cadence"))


CADENCE = f"""{BARS}, {EARNINGS}, egaps AS (SELECT sym, e, date_diff('day', lag(e) OVER (PARTITION BY sym ORDER BY e), e) AS gap FROM earnings),
  cadence AS (SELECT sym, CAST(coalesce(quantile_cont(CASE WHEN gap BETWEEN 30 AND 200 THEN gap END, 0.5), quantile_cont(gap, 0.5), 91) AS DOUBLE) AS cadence FROM egaps GROUP BY sym)"""


@query(f"WITH {CADENCE} SELECT sym, round(cadence, 6) AS cadence FROM cadence")
def cadence_median(spark, sf_dir):
    """Median days between a symbol's earnings dates."""
    return rounded(cadence(views.earnings_dates(spark, sf_dir)), ["sym"], cadence=F.col("cadence"))


def days_to_next(bars: DataFrame, earnings: DataFrame) -> DataFrame:
    """Bars with days_to_next: cadence less days since the last date, within 0 and the cadence; NULL before the first."""
    known = as_of(bars, earnings.withColumn("d", F.col("e")), ["sym"], "d", ["e"]).join(cadence(earnings), "sym", "left")
    return known.withColumn("days_to_next", F.greatest(F.lit(0.0), F.least("cadence", F.col("cadence") - F.datediff("d", "e")))).withColumn("days_to_next", F.when(F.col("e").isNotNull(), F.col("days_to_next"))).drop("e", "cadence")


@query(f"WITH {CADENCE} SELECT b.sym, b.d, round(CASE WHEN e.e IS NOT NULL THEN greatest(0, least(cadence, cadence - date_diff('day', e.e, b.d))) END, 6) AS days_to_next FROM bars b ASOF LEFT JOIN earnings e ON b.sym = e.sym AND b.d >= e.e JOIN cadence c ON c.sym = b.sym")
def earnings_cadence_estimate(spark, sf_dir):
    """Days to the next earnings date, estimated from dates before each bar."""
    b = views.bars(spark, sf_dir)
    return rounded(days_to_next(b.select("sym", "d"), views.earnings_dates(spark, sf_dir)), ["sym", "d"], days_to_next=F.col("days_to_next"))


@query(
    f"""WITH {BARS}, {EARNINGS}, ctx AS (SELECT sym, min(e) FILTER (e > DATE '1998-05-15') AS nxt, max(e) FILTER (e <= DATE '1998-05-15') AS prv FROM earnings GROUP BY sym)
    SELECT sym, nxt AS next_date, prv AS last_date, date_diff('day', DATE '1998-05-15', nxt) AS days_to_next, date_diff('day', prv, DATE '1998-05-15') AS days_since, date_diff('day', DATE '1998-05-15', nxt) <= 60 AS in_horizon FROM ctx"""
)
def earnings_context_range(spark, sf_dir):
    """Last and next earnings date around a day, and whether the next lies within 60 days."""
    e, day = views.earnings_dates(spark, sf_dir), F.lit("1998-05-15").cast("date")
    ctx = e.groupBy("sym").agg(F.min(F.when(F.col("e") > day, F.col("e"))).alias("next_date"), F.max(F.when(F.col("e") <= day, F.col("e"))).alias("last_date"))
    ahead = F.datediff("next_date", day).cast("long")
    return ctx.select("sym", "next_date", "last_date", ahead.alias("days_to_next"), F.datediff(day, "last_date").cast("long").alias("days_since"), (ahead <= 60).alias("in_horizon"))


@query(f"WITH {BARS}, {EARNINGS}, led AS (SELECT sym, d, c, lead(c) OVER (PARTITION BY sym ORDER BY d) AS nc FROM bars) SELECT e.sym, e.e, round(ln(nc / c), 6) AS move FROM earnings e ASOF JOIN led b ON e.sym = b.sym AND e.e >= b.d WHERE nc IS NOT NULL")
def earnings_moves(spark, sf_dir):
    """Log move from the bar at or before each earnings date to the next bar."""
    led = views.bars(spark, sf_dir).select("sym", F.col("d").alias("e"), "c", F.lead("c").over(symbol()).alias("nc"))
    e = as_of(views.earnings_dates(spark, sf_dir), led, ["sym"], "e", ["c", "nc"])
    return e.where("nc is not null").select("sym", "e", r6(F.ln(F.col("nc") / F.col("c"))).alias("move"))


_DIST = ("mean", "median", "std", "p05", "p25", "p75", "p95", "p_up")


def distribution(x: Column) -> dict[str, Column]:
    """Count, mean, median, deviation, quantiles and share above 0 of the values that are there."""
    q = lambda p: F.percentile(x, p)
    std = F.when(F.count(x) > 0, F.coalesce(F.stddev_samp(x), F.lit(0.0)))
    return {"n": F.count(x), "mean": F.avg(x), "median": q(0.5), "std": std, "p05": q(0.05), "p25": q(0.25), "p75": q(0.75), "p95": q(0.95), "p_up": F.avg(F.when(x.isNotNull(), (x > 0).cast("double")))}


def sql_distribution(x: str, pre: str) -> str:
    q = lambda p: f"quantile_cont({x}, {p})"
    parts = [f"avg({x})", q(0.5), f"CASE WHEN count({x}) > 0 THEN coalesce(stddev_samp({x}), 0) END", q(0.05), q(0.25), q(0.75), q(0.95), f"avg(CASE WHEN {x} IS NOT NULL THEN CASE WHEN {x} > 0 THEN 1.0::DOUBLE ELSE 0 END END)"]
    return ", ".join([f"count({x}) AS {pre}n", *(f"round({e}, 6) AS {pre}{n}" for n, e in zip(_DIST, parts))])


@query(
    f"""WITH {BARS}, pairs AS (SELECT t.d, t.c AS t, x.c AS x FROM (SELECT * FROM bars WHERE sym = 'Brand#11') t JOIN (SELECT * FROM bars WHERE sym = 'Brand#12') x USING (d)),
    moves AS (SELECT d, x / lag(x, 5) OVER w - 1 AS moved, lead(t, 10) OVER w / t - 1 AS ahead FROM pairs WINDOW w AS (ORDER BY d)),
    used AS (SELECT *, CASE WHEN abs(moved) >= 0.3 THEN ahead END AS hit FROM moves WHERE moved IS NOT NULL AND ahead IS NOT NULL)
    SELECT {sql_distribution('hit', 'event_')}, {sql_distribution('ahead', 'base_')}, round(avg(hit) - avg(ahead), 6) AS lift_mean,
      round(avg(CASE WHEN hit IS NOT NULL THEN CASE WHEN hit > 0 THEN 1.0::DOUBLE ELSE 0 END END) - avg(CASE WHEN ahead > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS lift_up,
      count(hit) // 10 AS effective, count(hit) // 10 < 5 AS low_confidence FROM used"""
)
def event_study_pairs(spark, sf_dir):
    """What a target does over 10 bars after its driver moved by 30 % in 5: the same against all days."""
    b = views.bars(spark, sf_dir).select("sym", "d", "c")
    t = b.where("sym = 'Brand#11'").select("d", F.col("c").alias("t")).join(b.where("sym = 'Brand#12'").select("d", F.col("c").alias("x")), "d")
    w = Window.orderBy("d")  # the shared calendar of two symbols
    m = t.select((F.col("x") / F.lag("x", 5).over(w) - 1).alias("moved"), (F.lead("t", 10).over(w) / F.col("t") - 1).alias("ahead")).where("moved is not null and ahead is not null")
    m = m.withColumn("hit", F.when(F.abs("moved") >= 0.3, F.col("ahead")))
    cols = []
    for pre, x in (("event_", F.col("hit")), ("base_", F.col("ahead"))):
        cols += [(e if n == "n" else r6(e)).alias(pre + n) for n, e in distribution(x).items()]
    up = lambda x: F.avg(F.when(x.isNotNull(), (x > 0).cast("double")))
    effective = F.floor(F.count("hit") / 10).cast("long")
    return m.agg(*cols, r6(F.avg("hit") - F.avg("ahead")).alias("lift_mean"), r6(up(F.col("hit")) - up(F.col("ahead"))).alias("lift_up"), effective.alias("effective"), (effective < 5).alias("low_confidence"))


# features and targets --------------------------------------------------------------------

FEATURES = (
    "ret_1d", "ret_5d", "ret_20d", "ret_60d", "rsi14", "macd_hist", "price_to_ma20", "price_to_ma50", "ma50_to_ma200", "hist_vol_20", "hist_vol_60", "vol_ratio", "atr_pct", "drawdown",
    "B_perc", "vix_level", "vix_rel", "days_to_next_earnings", "rvol_20", "dollar_vol_z_20", "overnight_ret_20d", "intraday_ret_20d", "realized_skew_60", "semivol_ratio_60",
)


def feature_matrix(bars: DataFrame, index: DataFrame, earnings: DataFrame) -> DataFrame:
    """(sym, d, c) and the 24 features of each bar, from data up to that bar."""
    b = with_returns(days_to_next(with_index(indicators.recursive_indicators(bars), index, bars), earnings))
    c, n = F.col, F.col("c")
    ma = {k: gated(F.avg, n, k) for k in (20, 50, 200)}
    vol = {k: gated(F.stddev_samp, c("lr"), k) * YEAR**0.5 for k in (20, 60)}
    b = b.withColumns({"cv": n * c("v"), "on": c("o") / lagged(n) - 1, "intra": n / c("o") - 1, "vd": c("v").cast("double")})
    cols = {
        "ret_1d": c("ret"), "ret_5d": change(n, 5), "ret_20d": change(n, 20), "ret_60d": change(n, 60), "rsi14": c("rsi14"), "macd_hist": c("macd_hist"),
        "price_to_ma20": n / ma[20] - 1, "price_to_ma50": n / ma[50] - 1, "ma50_to_ma200": ma[50] / ma[200] - 1, "hist_vol_20": vol[20], "hist_vol_60": vol[60], "vol_ratio": F.try_divide(vol[20], vol[60]),
        "atr_pct": c("atr14") / n, "drawdown": n / F.max("c").over(symbol().rowsBetween(Window.unboundedPreceding, 0)) - 1, "B_perc": percent_b(n), "vix_level": c("vix_level"), "vix_rel": c("vix_rel"),
        "days_to_next_earnings": c("days_to_next"), "rvol_20": rel_volume_of(c("vd")), "dollar_vol_z_20": dollar_z(c("cv")), "overnight_ret_20d": gated(F.avg, c("on"), 20), "intraday_ret_20d": gated(F.avg, c("intra"), 20),
        "realized_skew_60": sample_skew(c("lr"), 60), "semivol_ratio_60": semivol(c("lr")),
    }
    return b.select("sym", "d", "c", *(cols[k].alias(k) for k in FEATURES))


_EARN = f"{EARNINGS}, {CADENCE.split(EARNINGS + ', ')[1]}"
MATRIX = f"""{RECURSIVE}, {INDEX}, {INDEX_FEATURES}, {_EARN},
 known AS (SELECT b.sym, b.d, i.vix_level, i.vix_rel FROM bars b ASOF LEFT JOIN idxf i ON b.d >= i.d),
 ahead AS (SELECT b.sym, b.d, CASE WHEN e.e IS NOT NULL THEN greatest(0, least(cadence, cadence - date_diff('day', e.e, b.d))) END AS days_to_next_earnings FROM bars b ASOF LEFT JOIN earnings e ON b.sym = e.sym AND b.d >= e.e JOIN cadence c ON c.sym = b.sym),
 prep AS (SELECT *, c * v AS cv, o / pc - 1 AS onr, c / o - 1 AS intra, CASE WHEN lr IS NOT NULL THEN pow(least(lr, 0), 2) END AS dn, CASE WHEN lr IS NOT NULL THEN pow(greatest(lr, 0), 2) END AS up FROM rets JOIN recursive_ USING (sym, d) JOIN known USING (sym, d) JOIN ahead USING (sym, d)),
 base AS (SELECT *, {', '.join(f"{sql_gated('avg', 'c', k)} AS ma{k}" for k in (20, 50, 200))}, {', '.join(f"{sql_gated('stddev_samp', 'lr', k)} * sqrt(252) AS hist_vol_{k}" for k in (20, 60))} FROM prep),
 matrix AS (SELECT sym, d, c, ret AS ret_1d, {', '.join(f'c / lag(c, {k}) OVER w - 1 AS ret_{k}d' for k in (5, 20, 60))}, rsi14, macd_hist, c / ma20 - 1 AS price_to_ma20, c / ma50 - 1 AS price_to_ma50, ma50 / ma200 - 1 AS ma50_to_ma200,
  hist_vol_20, hist_vol_60, hist_vol_20 / nullif(hist_vol_60, 0) AS vol_ratio, atr14 / c AS atr_pct, c / max(c) OVER w - 1 AS drawdown, {_B} AS B_perc, vix_level, vix_rel, days_to_next_earnings,
  v / nullif({sql_gated('avg', 'v', 20, skip=1)}, 0) AS rvol_20, (cv - {sql_gated('avg', 'cv', 20, skip=1)}) / nullif({sql_gated('stddev_samp', 'cv', 20, skip=1)}, 0) AS dollar_vol_z_20,
  {sql_gated('avg', 'onr', 20)} AS overnight_ret_20d, {sql_gated('avg', 'intra', 20)} AS intraday_ret_20d, {sql_gated('skewness', 'lr', 60)} AS realized_skew_60, {_SEMI} AS semivol_ratio_60
  FROM base WINDOW w AS (PARTITION BY sym ORDER BY d))"""
_ROUNDED = ", ".join(f"round({x}, 6) AS {x}" for x in FEATURES)


def matrix(spark, sf_dir) -> DataFrame:
    b = bars_once(spark, sf_dir)
    return feature_matrix(b, views.index_closes(spark, sf_dir), views.earnings_of(b))


def bars_once(spark, sf_dir) -> DataFrame:
    """The bars as a stored table, for queries that read them several times."""

    def build(path: str) -> DataFrame:
        views.bars(spark, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return stored(spark, sf_dir, "bars", build, spark.read.parquet)


@query(f"WITH {MATRIX} SELECT sym, d, {_ROUNDED} FROM matrix")
def price_feature_matrix(spark, sf_dir):
    """The 24 features of every bar."""
    return rounded(matrix(spark, sf_dir), ["sym", "d"], **{x: F.col(x) for x in FEATURES})


_TARGETS = (-0.10, -0.05, 0.0, 0.05, 0.10)


def target_name(t: float) -> str:
    return f"gt_{abs(round(t * 100)):02d}{'m' if t < 0 else 'p'}"


def with_targets(features: DataFrame, horizon: int = 20) -> DataFrame:
    """Rows with a forward return and any feature, and whether the return lies strictly above each threshold."""
    f = features.withColumn("fwd", F.lead("c", horizon).over(symbol()) / F.col("c") - 1)
    f = f.where(F.col("fwd").isNotNull() & F.coalesce(*FEATURES).isNotNull())
    return f.withColumns({target_name(t): (F.col("fwd") > t).cast("int") for t in _TARGETS})


_GT = ", ".join(f"CASE WHEN fwd > {t} THEN 1 ELSE 0 END AS {target_name(t)}" for t in _TARGETS)


@query(f"WITH {MATRIX}, fwds AS (SELECT *, lead(c, 20) OVER (PARTITION BY sym ORDER BY d) / c - 1 AS fwd FROM matrix) SELECT sym, d, {_ROUNDED}, round(fwd, 6) AS fwd, {_GT} FROM fwds WHERE fwd IS NOT NULL AND coalesce({', '.join(FEATURES)}) IS NOT NULL")
def training_matrix(spark, sf_dir):
    """Features with the targets of the 20-bar forward return."""
    t = with_targets(matrix(spark, sf_dir))
    return t.select("sym", "d", *(r6(F.col(x)).alias(x) for x in FEATURES), r6(F.col("fwd")).alias("fwd"), *(target_name(x) for x in _TARGETS))


@query(f"WITH {MATRIX} SELECT sym, d, {_ROUNDED} FROM matrix QUALIFY row_number() OVER (PARTITION BY sym ORDER BY d DESC) = 1")
def current_features(spark, sf_dir):
    """The last bar's features of each symbol."""
    m = matrix(spark, sf_dir).groupBy("sym").agg(F.max_by(F.struct("d", *FEATURES), "d").alias("s"))
    return rounded(m.select("sym", "s.*"), ["sym", "d"], **{x: F.col(x) for x in FEATURES})


@query(
    f"""WITH {RETURNS}, seqs AS (SELECT sym, d, row_number() OVER w AS i, list(lr) OVER (PARTITION BY sym ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS x, lead(c, 20) OVER w / c - 1 AS fwd FROM rets WINDOW w AS (PARTITION BY sym ORDER BY d))
    SELECT sym, d, CAST(len(x) AS BIGINT) AS n, round(x[1], 6) AS oldest, round(x[60], 6) AS newest, round(list_sum(x), 6) AS total, CASE WHEN fwd < -0.1 THEN 0 WHEN fwd < -0.05 THEN 1 WHEN fwd < 0 THEN 2 WHEN fwd < 0.05 THEN 3 WHEN fwd < 0.1 THEN 4 ELSE 5 END AS label
    FROM seqs WHERE i > 60 AND fwd IS NOT NULL AND (i - 61) % 5 = 0"""
)
def sequence_windows(spark, sf_dir):
    """Every fifth run of 60 log returns, with the bucket of the 20-bar return after it."""
    b = with_returns(views.bars(spark, sf_dir))
    b = b.select("sym", "d", F.row_number().over(symbol()).alias("i"), F.collect_list("lr").over(last_rows(60)).alias("x"), (F.lead("c", 20).over(symbol()) / F.col("c") - 1).alias("fwd"))
    b = b.where("i > 60 and fwd is not null and (i - 61) % 5 = 0")
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return b.select("sym", "d", F.size("x").cast("long").alias("n"), r6(F.col("x")[0]).alias("oldest"), r6(F.element_at("x", -1)).alias("newest"), r6(total).alias("total"), fc.bucket_index(F.col("fwd")).alias("label"))


# forecasts -------------------------------------------------------------------------------


@query(
    f"""WITH {BARS}, fwd AS (SELECT sym, lead(c, 20) OVER (PARTITION BY sym ORDER BY d) / c - 1 AS r FROM bars)
    SELECT sym, count(*) AS n, {fc.sql_masses('r')}, round(avg(r), 6) AS expected, round(avg(CASE WHEN r > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_up, round(avg(CASE WHEN r < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_down,
      round(quantile_cont(r, 0.05), 6) AS q05, round(quantile_cont(r, 0.01), 6) AS q01, round(quantile_cont(r, 0.95), 6) AS q95 FROM fwd WHERE r IS NOT NULL GROUP BY sym HAVING count(*) >= 30"""
)
def historical_forecast(spark, sf_dir):
    """Distribution of each symbol's 20-bar forward returns over six buckets."""
    f = fc.forward_returns(views.bars(spark, sf_dir), 20)
    out = fc.sample_forecast(f, ["sym"]).where("n >= 30")
    return out.select("sym", "n", *(r6(F.col(x)).alias(x) for x in out.columns[2:]))


@query(f"WITH {BARS}, fwd AS (SELECT sym, lead(c, 20) OVER (PARTITION BY sym ORDER BY d) / c - 1 AS r FROM bars) SELECT sym, {sql_distribution('r', '')} FROM fwd WHERE r IS NOT NULL GROUP BY sym")
def sample_distribution(spark, sf_dir):
    """Moments and quantiles of forward returns."""
    f = fc.forward_returns(views.bars(spark, sf_dir), 20)
    d = distribution(F.col("r"))
    return f.groupBy("sym").agg(d.pop("n").alias("n"), *(r6(x).alias(n) for n, x in d.items()))


@query(f"WITH {BARS}, fwd AS (SELECT sym, d, lead(c, 20) OVER (PARTITION BY sym ORDER BY d) / c - 1 AS r FROM bars) SELECT sym, d, CASE WHEN r < -0.1 THEN 0 WHEN r < -0.05 THEN 1 WHEN r < 0 THEN 2 WHEN r < 0.05 THEN 3 WHEN r < 0.1 THEN 4 ELSE 5 END AS bucket FROM fwd WHERE r IS NOT NULL")
def bucket_assign(spark, sf_dir):
    """The half-open bucket of each forward return."""
    return fc.forward_returns(views.bars(spark, sf_dir), 20).select("sym", "d", fc.bucket_index(F.col("r")).alias("bucket"))


_MASS = f"""{BARS}, fwd AS (SELECT sym, lead(c, 20) OVER (PARTITION BY sym ORDER BY d) / c - 1 AS r FROM bars), masses AS (SELECT sym, {fc.sql_masses('r', 12)} FROM fwd WHERE r IS NOT NULL GROUP BY sym)"""


@query(
    f"""WITH {_MASS} SELECT sym, round(b5, 6) AS up, round(b0, 6) AS down, round(b0 + b5, 6) AS total, CASE WHEN b5 >= 1.25 * b0 AND b5 > 0 THEN 'up' WHEN b0 >= 1.25 * b5 AND b0 > 0 THEN 'down' ELSE 'balanced' END AS lean FROM masses"""
)
def large_move_breakdown(spark, sf_dir):
    """Mass of moves of at least 10 % either way, and which side leans."""
    m = fc.sample_forecast(fc.forward_returns(views.bars(spark, sf_dir), 20), ["sym"])
    m = m.select("sym", *(F.round(f"b{k}", 12).alias(f"b{k}") for k in range(6)))
    lean = F.when((F.col("b5") >= 1.25 * F.col("b0")) & (F.col("b5") > 0), "up").when((F.col("b0") >= 1.25 * F.col("b5")) & (F.col("b0") > 0), "down").otherwise("balanced")
    return m.select("sym", r6(F.col("b5")).alias("up"), r6(F.col("b0")).alias("down"), r6(F.col("b0") + F.col("b5")).alias("total"), lean.alias("lean"))


@query(
    f"""WITH {_MASS}, long AS (SELECT sym, unnest([-0.1, -0.05, 0.0, 0.05, 0.1]::DOUBLE[]) AS threshold, unnest([b1 + b2 + b3 + b4 + b5, b2 + b3 + b4 + b5, b3 + b4 + b5, b4 + b5, b5]) AS p FROM masses) SELECT sym, threshold, round(p, 6) AS p FROM long"""
)
def exceedance_long(spark, sf_dir):
    """Mass of the buckets from each threshold up."""
    m = fc.sample_forecast(fc.forward_returns(views.bars(spark, sf_dir), 20), ["sym"])
    pair = lambda k: F.struct(F.lit(fc.EDGES[k - 1]).alias("threshold"), r6(sum((F.col(f"b{j}") for j in range(k + 1, 6)), F.col(f"b{k}"))).alias("p"))
    return m.select("sym", F.inline(F.array(*(pair(k) for k in range(1, 6)))))


@query(
    f"""WITH {_MASS}, gt AS (SELECT sym, [b1 + b2 + b3 + b4 + b5 - 0.05, b2 + b3 + b4 + b5 + 0.02, b3 + b4 + b5, b4 + b5 + 0.03, b5] AS p FROM masses),
    mono AS (SELECT sym, list_transform(range(1, 6), lambda k: list_min(p[1:k])) AS m FROM gt),
    raw AS (SELECT sym, [greatest(1 - m[1], 0), greatest(m[1] - m[2], 0), greatest(m[2] - m[3], 0), greatest(m[3] - m[4], 0), greatest(m[4] - m[5], 0), greatest(m[5], 0)] AS x FROM mono)
    SELECT sym, {', '.join(f'round(x[{k + 1}] / list_sum(x), 9) AS b{k}' for k in range(6))} FROM raw"""
)
def exceedance_to_buckets(spark, sf_dir):
    """Bucket masses of noisy exceedance probabilities: running minimum, differences, clip, rescale."""
    m = fc.sample_forecast(fc.forward_returns(views.bars(spark, sf_dir), 20), ["sym"])
    noise = (-0.05, 0.02, 0.0, 0.03, 0.0)
    gt = [sum((F.col(f"b{j}") for j in range(k + 1, 6)), F.col(f"b{k}")) + F.lit(e) for k, e in zip(range(1, 6), noise)]
    x = fc.buckets_from_exceedance(F.array(*gt))
    return m.select("sym", x.alias("x")).select("sym", *(F.round(F.col("x")[k], 9).alias(f"b{k}") for k in range(6)))


def pool_members(spark, sf_dir) -> DataFrame:
    """Forecasts (sym, member, n, b0 to b5, ..., w) over three horizons from one pass over the bars, where the sample is large enough."""
    b = views.bars(spark, sf_dir)
    ahead = lambda h: F.lead("c", h).over(symbol()) / F.col("c") - 1
    each = F.array(*(F.struct(F.lit(h).alias("member"), F.lit(w).alias("w"), ahead(h).alias("r")) for h, w in ((10, 1.0), (20, 2.0), (60, 1.0))))
    return fc.sample_forecast(b.select("sym", each.alias("each")).select("sym", F.inline("each")).where("r is not null"), ["sym", "member", "w"]).where("n >= 30")


@query(
    f"""WITH {BARS}, hs(hz) AS (VALUES (10), (20), (60)), fwd AS (SELECT sym, hz, CASE hz WHEN 10 THEN lead(c, 10) OVER w WHEN 20 THEN lead(c, 20) OVER w ELSE lead(c, 60) OVER w END / c - 1 AS r FROM bars, hs WINDOW w AS (PARTITION BY sym, hz ORDER BY d)),
    members AS (SELECT sym, hz, {fc.sql_masses('r', 12)}, avg(r) AS expected, count(*) AS n FROM fwd WHERE r IS NOT NULL GROUP BY sym, hz HAVING count(*) >= 30), w(hz, wt) AS (VALUES (10, 1.0), (20, 2.0), (60, 1.0))
    SELECT sym, {', '.join(f'round(sum(wt * b{k}) / sum(wt), 6) AS b{k}' for k in range(6))}, round(sum(wt * expected) / sum(wt), 6) AS expected, count(*) AS n_members FROM members JOIN w USING (hz) GROUP BY sym"""
)
def ensemble_pool(spark, sf_dir):
    """Weighted pool of the forecasts of three models (horizons stand in for models); members without enough sample drop out."""
    members = pool_members(spark, sf_dir)
    pool = lambda c: r6(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c)
    return members.groupBy("sym").agg(*(pool(f"b{k}") for k in range(6)), pool("expected"), F.count(F.lit(1)).alias("n_members"))


MIXED = f"""{BARS}, hs(member) AS (VALUES (10), (20), (60)), fwd AS (SELECT sym, member, CASE member WHEN 10 THEN lead(c, 10) OVER w WHEN 20 THEN lead(c, 20) OVER w ELSE lead(c, 60) OVER w END / c - 1 AS r FROM bars, hs WINDOW w AS (PARTITION BY sym, member ORDER BY d)),
    members AS (SELECT sym, member, CASE member WHEN 20 THEN 2.0 ELSE 1.0 END AS w, {fc.sql_masses('r', 15)}, quantile_cont(r, 0.01) AS q01, quantile_cont(r, 0.05) AS q05, quantile_cont(r, 0.95) AS q95 FROM fwd WHERE r IS NOT NULL GROUP BY sym, member HAVING count(*) >= 30),
    pts AS (SELECT sym, member, w, unnest([-0.1, -0.05, 0.0, 0.05, 0.1, q01, q05, q95, least(-0.1, q01, q05, q95) - 0.1, greatest(0.1, q01, q05, q95) + 0.1]::DOUBLE[]) AS x, unnest([b0, b0 + b1, b0 + b1 + b2, b0 + b1 + b2 + b3, b0 + b1 + b2 + b3 + b4, 0.01, 0.05, 0.95, 0, 1]::DOUBLE[]) AS f FROM members),
    own AS (SELECT sym, member, w, x, max(f) AS f FROM (SELECT sym, member, w, x, max(f) OVER (PARTITION BY sym, member ORDER BY x RANGE UNBOUNDED PRECEDING) AS f FROM pts) GROUP BY 1, 2, 3, 4),
    grid AS (SELECT * FROM (SELECT DISTINCT sym, x FROM own) JOIN (SELECT sym, member, w FROM members) USING (sym)),
    near AS (SELECT g.*, (SELECT max_by({{'x': o.x, 'f': o.f}}, o.x) FROM own o WHERE o.sym = g.sym AND o.member = g.member AND o.x <= g.x) AS p, (SELECT min_by({{'x': o.x, 'f': o.f}}, o.x) FROM own o WHERE o.sym = g.sym AND o.member = g.member AND o.x >= g.x) AS q FROM grid g),
    mix AS (SELECT sym, x, sum(w * CASE WHEN p IS NULL THEN 0 WHEN q IS NULL THEN 1 WHEN p.x = q.x THEN p.f ELSE p.f + (q.f - p.f) * (x - p.x) / (q.x - p.x) END) / sum(w) AS m FROM near GROUP BY sym, x),
    steps AS (SELECT sym, x, m, lead(x) OVER v AS nx, lead(m) OVER v AS nm FROM mix WINDOW v AS (PARTITION BY sym ORDER BY x))"""


def _level(v: float) -> str:
    return f"round(max(CASE WHEN m <= {v} AND nm > {v} THEN x + ({v} - m) / (nm - m) * (nx - x) END), 6)"


@query(f"WITH {MIXED} SELECT sym, {_level(0.05)} AS q05, {_level(0.01)} AS q01, {_level(0.95)} AS q95 FROM steps GROUP BY sym")
def mixture_quantiles(spark, sf_dir):
    """5, 1 and 95 % quantiles of a weighted mix of bucket forecasts, by inverting the mixed distribution."""
    return fc.mixture_quantiles(pool_members(spark, sf_dir))


@query(
    f"""WITH {BARS}, n AS (SELECT sym, count(*) AS n FROM bars GROUP BY sym), k AS (SELECT sym, n, unnest(range(0, 500)) AS fold FROM n),
    starts AS (SELECT sym, n, fold, 60 + 5 + fold * 6 * 5 AS s FROM k)
    SELECT sym, CAST(fold AS BIGINT) AS fold, CAST(0 AS BIGINT) AS train_start, CAST(s - 5 - 1 AS BIGINT) AS train_end, CAST(s AS BIGINT) AS test_start, CAST(s + 5 * (least(6, (n - 5 - 1 - s) // 5 + 1) - 1) AS BIGINT) AS test_end, CAST(least(6, (n - 5 - 1 - s) // 5 + 1) AS BIGINT) AS n_tests
    FROM starts WHERE s <= n - 5 - 1"""
)
def walk_forward_folds(spark, sf_dir):
    """Folds of each symbol's bars: training ends an embargo before the first of up to six test bars a stride apart."""
    n = views.bars(spark, sf_dir).groupBy("sym").agg(F.count(F.lit(1)).alias("n"))
    return fc.walk_forward(n, horizon=5, min_train=60, test_size=6)


@query(
    f"""WITH {BARS}, num AS (SELECT sym, d, c, row_number() OVER (PARTITION BY sym ORDER BY d) - 1 AS i FROM bars), fwd AS (SELECT sym, i, d, lead(c, 20) OVER (PARTITION BY sym ORDER BY d) / c - 1 AS r FROM num),
    forecasts AS (SELECT sym, i AS t, r AS y FROM fwd WHERE r IS NOT NULL AND i >= 80 AND (i - 80) % 20 = 0),
    m AS (SELECT a.sym, a.t, a.y, count(*) AS n, {', '.join(f'avg(CASE WHEN f.r >= {e} THEN 1.0::DOUBLE ELSE 0 END) AS p{k}' for k, e in enumerate(fc.EDGES))} FROM forecasts a JOIN fwd f ON f.sym = a.sym AND f.i + 20 <= a.t AND f.r IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 30),
    long AS (SELECT sym, unnest([{', '.join(map(str, fc.EDGES))}]::DOUBLE[]) AS threshold, unnest([p0, p1, p2, p3, p4]) AS p, unnest([CASE WHEN y > -0.1 THEN 1 ELSE 0 END, CASE WHEN y > -0.05 THEN 1 ELSE 0 END, CASE WHEN y > 0 THEN 1 ELSE 0 END, CASE WHEN y > 0.05 THEN 1 ELSE 0 END, CASE WHEN y > 0.1 THEN 1 ELSE 0 END]) AS y FROM m)
    SELECT threshold, count(*) AS n, round(avg(y), 6) AS base_rate, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(least(greatest(p, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)))), 6) AS log_loss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM long GROUP BY threshold"""
)
def historical_backtest(spark, sf_dir):
    """Scores of historical forecasts made every 20 bars from bar 80 on (60 bars and a horizon), from what had ended by then."""
    scored = fc.backtest(views.bars(spark, sf_dir), horizon=20, first=80, stride=20)
    p = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    y = F.col("y").cast("double")
    return scored.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(y)).alias("base_rate"), r6(F.avg((F.col("p") - y) * (F.col("p") - y))).alias("brier"), r6(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))).alias("log_loss"), r6(F.avg(((F.col("p") >= 0.5) == (y == 1)).cast("double"))).alias("accuracy")
    )


@query()
def mc_gbm(spark, sf_dir):
    """Geometric Brownian motion of each symbol's last 60 log returns: seeded draws, tested against numpy."""
    return fc.monte_carlo(views.bars(spark, sf_dir), "gbm")


@query()
def mc_bootstrap(spark, sf_dir):
    """Block bootstrap of each symbol's log returns: seeded draws, tested against numpy."""
    return fc.monte_carlo(views.bars(spark, sf_dir), "bootstrap")


@query()
def mc_jump(spark, sf_dir):
    """Brownian motion as of one day, with a bootstrapped earnings move where the next date is due within the horizon."""
    day = F.lit("1998-06-15").cast("date")
    due = fc.moves_due(earnings_moves(spark, sf_dir), views.earnings_dates(spark, sf_dir), day, 20)
    return fc.monte_carlo(views.bars(spark, sf_dir).where(F.col("d") <= day), "jump", due)


@query()
def mc_garch(spark, sf_dir):
    """GJR-GARCH(1,1) with Student-t shocks, fitted by grid and pattern search; fewer than 250 returns fall back to the bootstrap."""
    return fc.monte_carlo(views.bars(spark, sf_dir), "garch")


@query()
def regime_forecast(spark, sf_dir):
    """Forward returns of bars in the current regime of a three-state Gaussian hidden Markov model fitted by EM."""
    return fc.regime_forecast(views.bars(spark, sf_dir))
