"""Hand-computed values of the series operators."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions.windows import as_of, gated
from quern.operators import forecast as fc
from quern.operators import indicators as ind
from quern.operators import kernels as kn
from quern.plans import series


def bars(spark, closes, sym="A", **more):
    day = datetime.date(2020, 1, 1)
    rows = [(sym, day + datetime.timedelta(days=k), c, c * 1.005, c * 0.995, c, 1000 + k) for k, c in enumerate(map(float, closes))]
    return spark.createDataFrame(rows, "sym string, d date, o double, h double, l double, c double, v long")


def test_wilder_and_ema():
    assert np.allclose(ind.wilder(np.array([np.nan, 1, 2, 3, np.nan, 6]), 2), [np.nan, np.nan, 1.5, 2.25, 2.25, 4.125], equal_nan=True)
    assert np.isnan(ind.wilder(np.array([1.0]), 2)).all()
    assert ind.ema(np.array([1.0, 2, 3]), 3).tolist() == [1, 1.5, 2.25]


def test_rsi_edges():
    assert np.isnan(ind.rsi(np.arange(1.0, 10))[:2]).all()
    assert ind.rsi(np.arange(1.0, 10), 3)[-1] == 100 and ind.rsi(np.full(10, 5.0), 3)[-1] == 50
    assert ind.rsi(np.array([1.0, 2, 1, 2]), 2)[2:].tolist() == [50, 75]


def test_macd_of_a_flat_series_is_zero():
    line, sig, hist = ind.macd(np.full(60, 7.0))
    assert np.abs(line).max() < 1e-12 and np.abs(sig).max() < 1e-12 and np.abs(hist).max() < 1e-12


def test_atr():
    assert ind.atr(np.array([2.0, 3, 3]), np.array([1.0, 1.5, 2]), np.array([1.5, 2.5, 2.5]), 2)[1:].tolist() == [1.25, 1.125]


def test_gated_window_waits_for_values(spark):
    got = bars(spark, [1, 2, 3, 4]).withColumn("x", F.when(F.col("c") != 2, F.col("c"))).select("d", gated(F.avg, F.col("x"), 2).alias("m")).orderBy("d").collect()
    assert [r.m for r in got] == [None, None, None, 3.5]


def test_returns(spark):
    got = series.with_returns(bars(spark, [10, 11, 12])).orderBy("d").collect()
    assert got[0].ret is None and got[1].ret == pytest.approx(0.1) and got[2].ret == pytest.approx(1 / 11)


def test_as_of_takes_the_last_row_before(spark):
    left = spark.createDataFrame([("A", 1), ("A", 5), ("A", 9), ("B", 5)], "k string, t int")
    right = spark.createDataFrame([("A", 2, "x"), ("A", 5, "y"), ("A", 7, None)], "k string, t int, v string")
    got = {(r.k, r.t): r.v for r in as_of(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {("A", 1): None, ("A", 5): "y", ("A", 9): None, ("B", 5): None}


def test_no_look_ahead(spark):
    """Dropping the last bar leaves every feature of the bars before it as it was."""
    r = np.random.default_rng(3)
    closes = np.exp(np.cumsum(r.normal(0, 0.02, 120))) * 100
    index = spark.createDataFrame([(datetime.date(2020, 1, 1) + datetime.timedelta(days=2 * k), float(20 + k % 5)) for k in range(60)], "d date, x double")
    earnings = spark.createDataFrame([("A", datetime.date(2020, 1, 20)), ("A", datetime.date(2020, 4, 15))], "sym string, e date")
    full = {x.d: x for x in series.feature_matrix(bars(spark, closes), index, earnings).collect()}
    less = series.feature_matrix(bars(spark, closes[:-1]), index, earnings).collect()
    assert len(less) == 119 and len(series.FEATURES) == 24
    for x in less:
        for f in series.FEATURES:
            assert x[f] == pytest.approx(full[x.d][f], abs=1e-12) if x[f] is not None else full[x.d][f] is None


def test_folds(spark):
    n = spark.createDataFrame([("A", 52), ("short", 25)], "sym string, n long")
    got = fc.walk_forward(n, horizon=5, min_train=20, test_size=3).orderBy("fold").collect()
    assert [(r.sym, r.train_end, r.test_start, r.test_end, r.n_tests) for r in got] == [("A", 19, 25, 35, 3), ("A", 34, 40, 45, 2)]


def test_buckets_are_half_open(spark):
    got = spark.createDataFrame([(-0.2,), (-0.1,), (0.0,), (0.05,), (0.1,)], "r double").select(fc.bucket_index(F.col("r")).alias("b")).collect()
    assert [r.b for r in got] == [0, 1, 3, 4, 5]
    assert fc.edges_for(25) == fc.BANDS[20] and fc.edges_for(44) == fc.BANDS[30] and fc.edges_for(200) == fc.BANDS[60]


def test_exceedance_becomes_monotone(spark):
    p = F.array(*(F.lit(x) for x in (0.9, 0.95, 0.5, 0.6, 0.1)))
    got = spark.range(1).select(fc.buckets_from_exceedance(p).alias("x")).first().x
    assert got == pytest.approx([0.1, 0, 0.4, 0, 0.4, 0.1])


def test_backtest_uses_ended_returns_alone(spark):
    r = np.random.default_rng(1)
    closes = np.exp(np.cumsum(r.normal(0, 0.05, 140))) * 10
    got = {(x.t, x.threshold): x.p for x in fc.backtest(bars(spark, closes), 5, 50, 5).collect()}
    fwd = closes[5:] / closes[:-5] - 1
    assert {t for t, _ in got} == set(range(50, 135, 5))
    for (t, e), p in got.items():
        assert p == pytest.approx((fwd[: t - 5 + 1] >= e).mean())


def test_backtest_scores_histories_of_less_than_a_year(spark, tmp_path):
    """From bar 252 on, 200 bars gave no forecast."""
    day = datetime.date(2000, 1, 3)
    lines = [(k, 1, 7, 1, float(100 + k % 9), 1.0, day + datetime.timedelta(k)) for k in range(200)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_shipdate date").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(7, "Brand#1")], "p_partkey long, p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = {x.threshold: (x.n, x.base_rate) for x in series.historical_backtest(spark, str(tmp_path)).collect()}
    ends = [(100 + (t + 20) % 9) / (100 + t % 9) - 1 for t in range(80, 180, 20)]
    assert got == {e: (5, pytest.approx(sum(r > e for r in ends) / 5)) for e in (-0.1, -0.05, 0.0, 0.05, 0.1)}


def test_simulations_match_numpy():
    lr = np.random.default_rng(5).normal(0.001, 0.02, 300)
    g = kn.gbm_paths(lr, 20, 4000)
    mean, sd = lr[-60:].mean(), lr[-60:].std(ddof=1)
    z = np.random.default_rng(kn.SEED).standard_normal((4000, 20))
    assert g == pytest.approx(np.expm1((mean - 0.5 * sd**2 + sd * z).sum(axis=1)), abs=1e-12)
    b = kn.bootstrap_paths(lr, 20, 4000)
    assert abs(np.log1p(b).mean() - 20 * lr.mean()) < 0.02 and len(b) == 4000
    assert kn.jump_paths(lr, np.array([0.1] * 3), 20, 100).tolist() == kn.gbm_paths(lr, 20, 100).tolist()
    assert np.log1p(kn.jump_paths(lr, np.array([0.5] * 9), 20, 4000)).mean() > 0.4
    assert kn.garch_paths(lr[:100], 20, 50).tolist() == kn.bootstrap_paths(lr[:100], 20, 50).tolist()
    p = kn.fit_garch(lr)
    assert (p >= 0).all() and p[1] + p[2] / 2 + p[3] < 1 and p[4] > 20
    heavy = kn.fit_garch(np.random.default_rng(6).standard_t(3, 1500) * 0.01)
    assert heavy[4] < 6
    moves = np.linspace(-0.1, 0.1, 9)
    draws = np.random.default_rng(kn.SEED + 1).choice(moves, 500)
    z = np.random.default_rng(kn.SEED).standard_normal((500, 19))
    assert kn.jump_paths(lr, moves, 20, 500) == pytest.approx(np.expm1((mean - 0.5 * sd**2 + sd * z).sum(axis=1) + draws), abs=1e-12)


def test_moves_count_where_a_date_is_due(spark):
    """20 trading days are some 29 calendar days."""
    day = lambda x: datetime.date.fromisoformat(x)
    moves = spark.createDataFrame([(s, day(d), m) for s in "abc" for d, m in (("2024-01-02", 0.2), ("2023-10-02", 0.1), ("2024-06-30", 0.9))], "sym string, e date, move double")
    dates = spark.createDataFrame([("a", day("2024-03-29")), ("b", day("2024-03-31")), ("a", day("2024-01-02"))], "sym string, e date")
    got = {r.sym: r.moves for r in fc.moves_due(moves, dates, F.lit("2024-03-01").cast("date"), 20).collect()}
    assert got == {"a": [0.1, 0.2]}


def test_hidden_states_follow_the_mean():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(-1, 0.1, 80), r.normal(0, 0.1, 80), r.normal(1, 0.1, 80)])
    s = kn.hmm_states(x)
    assert (s[:80] == 0).mean() > 0.95 and (s[80:160] == 1).mean() > 0.95 and (s[160:] == 2).mean() > 0.95


def test_mixture_quantiles_invert_the_mixed_function(spark):
    """Against numpy: points of each member, a running maximum, interpolation over the union of points."""
    r = np.random.default_rng(9)
    rows = []
    for sym in "ab":
        for k, w in enumerate((1.0, 2.0, 0.5)):
            m = r.dirichlet(np.ones(6))
            rows.append((sym, k, w, *map(float, m), -0.12 - 0.05 * k, -0.08 + 0.01 * k, 0.11 + 0.02 * k))
    kind = "sym string, member int, w double, b0 double, b1 double, b2 double, b3 double, b4 double, b5 double, q01 double, q05 double, q95 double"
    got = {x.sym: (x.q05, x.q01, x.q95) for x in fc.mixture_quantiles(spark.createDataFrame(rows, kind)).collect()}
    for sym in "ab":
        own = [x for x in rows if x[0] == sym]
        parts = []
        for x in own:
            pts = sorted([*zip(fc.EDGES, np.cumsum(x[3:8])), (x[9], 0.01), (x[10], 0.05), (x[11], 0.95), (min(-0.1, x[9]) - 0.1, 0.0), (max(0.1, x[11]) + 0.1, 1.0)])
            parts.append((np.array([p[0] for p in pts]), np.maximum.accumulate([p[1] for p in pts])))
        grid = np.unique(np.concatenate([p[0] for p in parts]))
        mix = sum(x[2] * np.interp(grid, *p) for x, p in zip(own, parts)) / sum(x[2] for x in own)
        assert got[sym] == pytest.approx(np.interp([0.05, 0.01, 0.95], mix, grid), abs=1e-6)
