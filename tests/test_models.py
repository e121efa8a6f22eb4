"""Stored models, refits along folds and stacked weights."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import forecast as fc
from quern.operators import models as md


def walk(seed, n):
    return np.exp(np.cumsum(np.random.default_rng(seed).normal(0, 0.04, n))) * 10


def bars(spark, **closes):
    day = datetime.date(2020, 1, 1)
    return spark.createDataFrame([(s, day + datetime.timedelta(k), float(c)) for s, x in closes.items() for k, c in enumerate(x)], "sym string, d date, c double")


def test_stored_models_score_as_before_and_fall_with_the_threshold(spark, tmp_path):
    b = bars(spark, a=walk(1, 220), b=walk(2, 200))
    w = "over (partition by sym order by d)"
    f = b.selectExpr("*", f"c / lag(c, 5) {w} - 1 as x1", f"case when day(d) > 3 then c / lag(c, 20) {w} - 1 end as x2")
    rows = md.horizon_targets(f, ["x1", "x2"], (5, 20))
    got = {(r.sym, r.d, r.horizon): (r.fwd, r.until) for r in rows.collect()}
    x, day = walk(1, 220), datetime.date(2020, 1, 1)
    fwd, until = got["a", day + datetime.timedelta(30), 20]
    assert fwd == pytest.approx(x[50] / x[30] - 1) and until == day + datetime.timedelta(50)
    assert not [k for k in got if k[1] < day + datetime.timedelta(5)] and ("a", day + datetime.timedelta(205), 20) not in got
    cut = day + datetime.timedelta(150)
    train = rows.where(F.col("until") < F.lit(cut))
    store = md.ModelStore.fit(train, ["x1", "x2"], str(tmp_path / "m"), thresholds=(-9.0, -0.05, 0.0, 0.05))
    late = rows.where((F.col("d") >= F.lit(cut)) & (F.col("horizon") == 20)).select("sym", "d", "x1", "x2")
    before = {(r.sym, r.d): r.p for r in store.exceedance(late, 20).collect()}
    again = md.ModelStore(spark, str(tmp_path / "m"))
    assert {(r.sym, r.d): r.p for r in again.exceedance(late, 20).collect()} == before and len(before) == late.count()
    assert all(p[0] == 1.0 and all(x >= y for x, y in zip(p, p[1:])) and 0 <= p[-1] for p in before.values())
    facts = {(r.horizon, r.threshold): r for r in again.manifest.collect()}
    assert len(facts) == 8 and facts[20, -9.0].constant and not facts[20, 0.0].constant and all(r.until < cut for r in facts.values())
    assert facts[5, 0.0].base_rate == pytest.approx(train.where("horizon = 5").agg(F.avg((F.col("fwd") > 0).cast("double"))).first()[0])
    with pytest.raises(ValueError, match="no models"):
        again.exceedance(late, 7)


def test_refits_see_no_bar_behind_their_fold(spark):
    x = walk(3, 200)
    b = bars(spark, a=x)
    folds = fc.walk_forward(spark.createDataFrame([("a", 200)], "sym string, n long"), horizon=5, min_train=80, test_size=4)
    got = {(r.model, r.t, r.threshold): (r.p, r.y, r.fold) for r in md.refit(b, folds, 5, 5).collect()}
    plan = {r.fold: r for r in folds.collect()}
    assert {m for m, *_ in got} == set(md.MODELS) and len(got) == 3 * 5 * sum(f.n_tests for f in plan.values())
    fwd = x[5:] / x[:-5] - 1
    for (model, t, e), (p, y, fold) in got.items():
        end = plan[fold].train_end
        assert end + 5 < t <= plan[fold].test_end and y == int(fwd[t] > e)
        if model == "historical":
            assert p == pytest.approx((fwd[: end - 4] > e).mean())
    # bars behind the last training bar change no forecast made at the first test, but for that test's own features
    last = max(plan)
    end, first = plan[last].train_end, plan[last].test_start
    changed = x.copy()
    changed[end + 1 :] *= np.linspace(1, 3, len(x) - end - 1)
    other = {(r.model, r.t, r.threshold): r.p for r in md.refit(bars(spark, a=changed), folds.where(F.col("fold") == last), 5, 5, ("historical", "normal")).collect()}
    assert all(p == pytest.approx(got[k][0]) for k, p in other.items()) and len(other) == 2 * 5 * plan[last].n_tests
    p = [got["logistic", first, e][0] for e in fc.EDGES]
    assert all(u >= v for u, v in zip(p, p[1:])) and 0 < p[-1] and p[0] < 1


def test_stacked_weights_are_those_of_a_grid(spark):
    r = np.random.default_rng(5)
    q = r.random(400)
    y = (r.random(400) < q).astype(int)
    members = {"good": np.clip(q + r.normal(0, 0.1, 400), 0, 1), "shifted": np.clip(q * 0.5 + 0.3, 0, 1), "noise": r.random(400)}
    rows = [(k, m, float(p[k]), int(y[k])) for m, p in members.items() for k in range(400)] + [(999, "good", 0.5, 1)]
    table, w = md.stacked(spark.createDataFrame(rows, "k int, model string, p double, y int"), ["k"], list(members))
    x = np.column_stack(list(members.values()))
    cost = lambda v: np.mean((x @ v - y) ** 2) + md.RIDGE * np.mean((v - 1 / 3) ** 2)
    best = min((cost(np.array([a, b, 100 - a - b]) / 100), a, b) for a in range(101) for b in range(101 - a))
    own = np.array([w[m] for m in members])
    assert own.sum() == pytest.approx(1) and (own >= 0).all() and cost(own) <= best[0] + 1e-12 and abs(own[0] - best[1] / 100) < 0.02
    got = {t.k: t.p for t in table.collect()}
    assert len(got) == 400 and got[7] == pytest.approx(x[7] @ own)
    assert md.simplex(np.array([0.2, 0.3, 0.5])) == pytest.approx([0.2, 0.3, 0.5]) and md.simplex(np.array([2.0, 0.0])) == pytest.approx([1, 0])
