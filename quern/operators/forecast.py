"""Scenario forecasts: bucketed return distributions, folds, backtests and simulations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.windows import symbol
from quern.operators.kernels import EDGES, SUMMARY, bootstrap_paths, garch_paths, gbm_paths, hmm_states, jump_paths, summary

#: Inner edges of the six half-open buckets, by horizon in days (fixed values).
BANDS = {20: EDGES, 30: (-0.20, -0.10, 0.0, 0.10, 0.20), 60: (-0.30, -0.15, 0.0, 0.15, 0.30)}


def edges_for(horizon: int) -> tuple[float, ...]:
    """Edges of the configured horizon nearest to this one; ties go to the shorter."""
    return BANDS[min(BANDS, key=lambda h: (abs(h - horizon), h))]


def bucket_index(r: Column, edges: tuple[float, ...] = EDGES) -> Column:
    """0 to 5: a value equal to an edge belongs above it."""
    out = F.when(r < edges[0], 0)
    for k, e in enumerate(edges[1:], 1):
        out = out.when(r < e, k)
    return out.otherwise(len(edges))


def forward_returns(bars: DataFrame, horizon: int) -> DataFrame:
    """(sym, d, r): each bar's return over the next ``horizon`` bars, where they are there."""
    return bars.select("sym", "d", (F.lead("c", horizon).over(symbol()) / F.col("c") - 1).alias("r")).where("r is not null")


def _share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def sample_forecast(returns: DataFrame, keys: list[str], edges: tuple[float, ...] = EDGES) -> DataFrame:
    """Forecast of a return sample (r) for each key: bucket masses, mean, shares above and below 0, and three quantiles.

    The quantiles are exact, so a group's distinct returns meet in one task; a group is one symbol's history.
    """
    r = F.col("r")
    masses = [_share(bucket_index(r, edges) == k).alias(f"b{k}") for k in range(len(edges) + 1)]
    q = F.percentile("r", F.array(F.lit(0.05), F.lit(0.01), F.lit(0.95)))
    out = returns.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *masses, F.avg(r).alias("expected"), _share(r > 0).alias("p_up"), _share(r < 0).alias("p_down"), q.alias("q"))
    return out.select(*keys, "n", *(f"b{k}" for k in range(len(edges) + 1)), "expected", "p_up", "p_down", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q01"), F.col("q")[2].alias("q95"))


def sql_masses(x: str, digits: int = 6, edges: tuple[float, ...] = EDGES) -> str:
    """The bucket masses in DuckDB SQL."""
    lows, highs = [None, *edges], [*edges, None]
    cond = [" AND ".join(filter(None, [lo is not None and f"{x} >= {lo}", hi is not None and f"{x} < {hi}"])) for lo, hi in zip(lows, highs)]
    return ", ".join(f"round(avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END), {digits}) AS b{k}" for k, c in enumerate(cond))


def buckets_from_exceedance(p: Column) -> Column:
    """Bucket masses of an array of exceedance probabilities by ascending threshold.

    A higher threshold may not be exceeded more often, so each takes the least so far; then differences, at least 0, rescaled to sum 1.
    """
    least = F.transform(p, lambda _, k: F.array_min(F.slice(p, F.lit(1), k + 1)))
    n = len(EDGES)
    edges = [F.lit(1.0), *(least[k] for k in range(n)), F.lit(0.0)]
    raw = F.array(*(F.greatest(a - b, F.lit(0.0)) for a, b in zip(edges, edges[1:])))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raw, lambda x: F.try_divide(x, total))


def mixture_quantiles(members: DataFrame, levels: tuple[float, ...] = (0.05, 0.01, 0.95), edges: tuple[float, ...] = EDGES) -> DataFrame:
    """(sym, q05, q01, q95) of weighted forecasts (sym, member, b0 to b5, q05, q01, q95, w), by inverting the mix of their distribution functions.

    A member's function has a point at each bucket edge and quantile and ends a band beyond its outermost ones; it rises by a running maximum and
    is linear between points.  Each is read at the points of all, and the mix is read backwards at ``levels``.
    """
    band = max(abs(e) for e in edges)
    mass = [sum((F.col(f"b{j}") for j in range(1, k + 1)), F.col("b0")) for k in range(len(edges))]
    inner = [*((F.lit(e), m) for e, m in zip(edges, mass)), (F.col("q01"), F.lit(0.01)), (F.col("q05"), F.lit(0.05)), (F.col("q95"), F.lit(0.95))]
    xs = [x for x, _ in inner]
    ends = [(F.least(*xs) - band, F.lit(0.0)), (F.greatest(*xs) + band, F.lit(1.0))]
    points = members.select("sym", "member", "w", F.inline(F.array(*(F.struct(x.alias("x"), f.alias("f")) for x, f in [*inner, *ends]))))
    so_far = Window.partitionBy("sym", "member").orderBy("x")
    own = points.withColumn("f", F.max("f").over(so_far.rangeBetween(Window.unboundedPreceding, 0))).groupBy("sym", "member", "w", "x").agg(F.max("f").alias("f"))
    grid = own.select("sym", "x").distinct().join(members.select("sym", "member", "w").distinct(), "sym")
    at = grid.join(own.select("sym", "member", "x", "f"), ["sym", "member", "x"], "left")
    known = F.when(F.col("f").isNotNull(), F.struct("x", "f"))
    before, after = F.last(known, True).over(so_far.rowsBetween(Window.unboundedPreceding, 0)), F.first(known, True).over(so_far.rowsBetween(0, Window.unboundedFollowing))
    at = at.withColumns({"p": before, "q": after})
    between = F.col("p.f") + (F.col("q.f") - F.col("p.f")) * F.try_divide(F.col("x") - F.col("p.x"), F.col("q.x") - F.col("p.x"))
    read = F.when(F.col("p").isNull(), 0.0).when(F.col("q").isNull(), 1.0).otherwise(F.coalesce(between, F.col("p.f")))
    mix = at.groupBy("sym", "x").agg((F.sum(F.col("w") * read) / F.sum("w")).alias("m"))
    ahead = Window.partitionBy("sym").orderBy("x")
    mix = mix.withColumns({"nx": F.lead("x").over(ahead), "nm": F.lead("m").over(ahead)}).where("nm > m")
    level = lambda v: F.max(F.when((F.col("m") <= v) & (F.col("nm") > v), F.col("x") + (F.lit(v) - F.col("m")) / (F.col("nm") - F.col("m")) * (F.col("nx") - F.col("x"))))
    return mix.groupBy("sym").agg(*(F.round(level(v), 6).alias(f"q{round(v * 100):02d}") for v in levels))


def walk_forward(counts: DataFrame, horizon: int, min_train: int, test_size: int, stride: int | None = None, embargo: int | None = None) -> DataFrame:
    """Expanding folds (sym, fold, train_start, train_end, test_start, test_end, n_tests) of (sym, n) bars.

    The closed form of the fold walk: tests start at min_train + embargo, take up to test_size bars a
    stride apart whose horizon still ends within the bars, and the next fold follows a stride behind.
    """
    stride, embargo = stride or horizon, horizon if embargo is None else embargo
    last = F.col("n") - horizon - 1
    first = min_train + embargo
    span = test_size * stride
    folds = counts.where(last >= first).withColumn("fold", F.explode(F.sequence(F.lit(0), F.floor((last - first) / span).cast("int"))))
    start = F.lit(first) + F.col("fold") * span
    tests = F.least(F.lit(test_size), F.floor((last - start) / stride) + 1)
    long = lambda x: x.cast("long")
    return folds.select(
        "sym", long(F.col("fold")).alias("fold"), long(F.lit(0)).alias("train_start"), long(start - embargo - 1).alias("train_end"), long(start).alias("test_start"), long(start + stride * (tests - 1)).alias("test_end"), long(tests).alias("n_tests")
    )


def backtest(bars: DataFrame, horizon: int, first: int, stride: int, least: int = 30, edges: tuple[float, ...] = EDGES) -> DataFrame:
    """(sym, t, threshold, p, y): exceedance forecasts at every ``stride``-th bar from ``first``, and what came.

    A forecast at bar t uses the returns that had ended by t, so a running average that stops
    ``horizon`` rows before t holds them all: no join of as-of bars with their histories.
    """
    ended = symbol().rowsBetween(Window.unboundedPreceding, -horizon)
    b = bars.select("sym", "d", (F.row_number().over(symbol()) - 1).alias("t"), (F.lead("c", horizon).over(symbol()) / F.col("c") - 1).alias("r"))
    above = [F.avg(F.when(F.col("r").isNotNull(), (F.col("r") >= e).cast("double"))).over(ended).alias(f"p{k}") for k, e in enumerate(edges)]
    b = b.select("sym", "t", "r", F.count("r").over(ended).alias("n"), *above)
    b = b.where((F.col("t") >= first) & ((F.col("t") - first) % stride == 0) & F.col("r").isNotNull() & (F.col("n") >= least))
    pairs = F.array(*(F.struct(F.lit(e).alias("threshold"), F.col(f"p{k}").alias("p"), (F.col("r") > e).cast("int").alias("y")) for k, e in enumerate(edges)))
    return b.select("sym", "t", "r", F.inline(pairs))


# simulations: one symbol's log returns in a task, draws from numpy's seeded generator ------


def monte_carlo(bars: DataFrame, kind: str, moves: DataFrame | None = None, horizon: int = 20, paths: int = 10_000) -> DataFrame:
    """Simulated forecast of each symbol, after its last bar; symbols with fewer than 60 returns have none.  A group is one symbol's closes.

    ``moves`` (sym, moves) are past earnings moves of the symbols that have a date due within the horizon (``moves_due``).
    """
    src = bars.select("sym", "d", "c")
    src = src.join(moves, "sym", "left") if moves is not None else src.withColumn("moves", F.lit(None).cast("array<double>"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        lr = np.diff(np.log(pdf["c"].to_numpy(float)))
        sym, own = pdf["sym"].iloc[0], pdf["moves"].iloc[0]
        if len(lr) < 60:
            return summary(sym, np.zeros(1)).iloc[:0]
        if kind == "gbm":
            r = gbm_paths(lr, horizon, paths)
        elif kind == "jump":
            r = jump_paths(lr, np.array([] if own is None else own, float), horizon, paths)
        elif kind == "garch":
            r = garch_paths(lr, horizon, paths)
        else:
            r = bootstrap_paths(lr, horizon, paths)
        return summary(sym, r)

    return src.groupBy("sym").applyInPandas(run, SUMMARY)


def moves_due(moves: DataFrame, dates: DataFrame, as_of: Column, horizon: int) -> DataFrame:
    """(sym, moves): the earnings moves (sym, e, move) before ``as_of`` of symbols whose next date of ``dates`` (sym, e) lies within ``horizon`` trading days after it."""
    ahead = dates.where(F.col("e") > as_of).groupBy("sym").agg(F.min("e").alias("next"))
    due = ahead.where(F.datediff("next", as_of) <= horizon * 365.0 / 252.0).select("sym")
    past = moves.where(F.col("e") < as_of).groupBy("sym").agg(F.transform(F.sort_array(F.collect_list(F.struct("e", "move"))), lambda m: m["move"]).alias("moves"))
    return past.join(due, "sym", "left_semi")


def regime_forecast(bars: DataFrame, horizon: int = 20, least: int = 30) -> DataFrame:
    """Forecast from forward returns of bars in the last bar's state; too few of these: from all bars."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf.sort_values("d")["c"].to_numpy(float)
        sym = pdf["sym"].iloc[0]
        if len(c) < 2 * horizon + least:
            return summary(sym, np.zeros(1)).iloc[:0]
        state = hmm_states(np.diff(np.log(c)))
        fwd = c[1 + horizon :] / c[1:-horizon] - 1
        own = fwd[state[: len(fwd)] == state[-1]]
        return summary(sym, own if len(own) >= least else fwd)

    return bars.select("sym", "d", "c").groupBy("sym").applyInPandas(run, SUMMARY)
