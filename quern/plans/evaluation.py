"""Queries that score forecasts: metrics, calibration, conformal intervals, models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.windows import symbol
from quern.operators import evaluation as ev
from quern.operators import forecast as fc
from quern.operators import models as md
from quern.plans import series
from quern.plans.base import query, stored
from quern.sources import views
from quern.sources.payloads import scratch
from quern.sources.views import BARS


def r6(x: Column) -> Column:
    return F.round(x, 6)


def scored(spark, sf_dir) -> DataFrame:
    """(sym, t, threshold, p, y) of the historical backtest; p to 9 digits, so that equal shares are equal numbers."""
    s = fc.backtest(views.bars(spark, sf_dir), horizon=20, first=80, stride=20)
    return s.select("sym", "t", "threshold", F.round("p", 9).alias("p"), "y")


SCORED = f"""{BARS}, num AS (SELECT sym, d, c, row_number() OVER (PARTITION BY sym ORDER BY d) - 1 AS t, lead(c, 20) OVER (PARTITION BY sym ORDER BY d) / c - 1 AS r FROM bars),
  ended AS (SELECT sym, t, r, count(r) OVER w AS n, {', '.join(f'avg(CASE WHEN r IS NOT NULL THEN CASE WHEN r >= {e} THEN 1.0::DOUBLE ELSE 0 END END) OVER w AS p{k}' for k, e in enumerate(fc.EDGES))} FROM num WINDOW w AS (PARTITION BY sym ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 20 PRECEDING)),
  picked AS (SELECT * FROM ended WHERE t >= 80 AND (t - 80) % 20 = 0 AND r IS NOT NULL AND n >= 30),
  scored AS (SELECT sym, t, unnest([{', '.join(map(str, fc.EDGES))}]::DOUBLE[]) AS threshold, unnest([{', '.join(f'round(p{k}, 9)' for k in range(5))}]) AS p, unnest([{', '.join(f'CASE WHEN r > {e} THEN 1 ELSE 0 END' for e in fc.EDGES)}]) AS y FROM picked)"""
_CLIP = "least(greatest(p, 1e-15), 1 - 1e-15)"


@query(
    f"""WITH {SCORED} SELECT threshold, count(*) AS n, round(avg(y), 6) AS base_rate, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln({_CLIP}) + (1 - y) * ln(1 - {_CLIP}))), 6) AS log_loss, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy,
    round(count_if(p >= 0.5 AND y = 1) / nullif(count_if(p >= 0.5), 0), 6) AS precision, round(count_if(p >= 0.5 AND y = 1) / nullif(count_if(y = 1), 0), 6) AS recall FROM scored GROUP BY threshold"""
)
def threshold_metrics(spark, sf_dir):
    """All scores of each threshold."""
    s = scored(spark, sf_dir).groupBy("threshold").agg(*ev.binary_scores())
    return s.select("threshold", "n", *(r6(F.col(x)).alias(x) for x in s.columns[2:]))


@query(
    f"""WITH {SCORED}, ranked AS (SELECT threshold, y, rank() OVER (PARTITION BY threshold ORDER BY p) + (count(*) OVER (PARTITION BY threshold, p) - 1) / 2 AS r FROM scored)
    SELECT threshold, round((sum(r) FILTER (y = 1) - CAST(count_if(y = 1) AS DOUBLE) * (count_if(y = 1) + 1) / 2) / nullif(CAST(count_if(y = 1) AS DOUBLE) * count_if(y = 0), 0), 6) AS auc FROM ranked GROUP BY threshold"""
)
def roc_auc_ranked(spark, sf_dir):
    """Area under the ROC curve of each threshold, ties by half."""
    return ev.roc_auc(scored(spark, sf_dir), ["threshold"]).select("threshold", r6(F.col("auc")).alias("auc"))


_BIN = "CASE " + " ".join(f"WHEN p < {k / 10} THEN {k - 1}" for k in range(1, 10)) + " ELSE 9 END"
BINS = f"{SCORED}, bins AS (SELECT threshold, {_BIN} AS bin, count(*) AS n, avg(p) AS mean_p, avg(y) AS frequency FROM scored GROUP BY threshold, {_BIN})"


@query(f"WITH {BINS} SELECT threshold, bin, n, round(mean_p, 6) AS mean_p, round(frequency, 6) AS frequency FROM bins")
def reliability_bins(spark, sf_dir):
    """Forecast and frequency by bin."""
    b = ev.reliability(scored(spark, sf_dir), ["threshold"])
    return b.select("threshold", "bin", "n", r6(F.col("mean_p")).alias("mean_p"), r6(F.col("frequency")).alias("frequency"))


@query(
    f"""WITH {BINS}, e AS (SELECT threshold, sum(n * abs(mean_p - frequency)) / sum(n) AS ece, max(abs(mean_p - frequency)) AS mce FROM bins GROUP BY threshold)
    SELECT threshold, round(ece, 6) AS ece, round(mce, 6) AS mce, CASE WHEN ece < 0.05 THEN 'well-calibrated' WHEN ece < 0.10 THEN 'moderately calibrated' ELSE 'poorly calibrated' END AS label FROM e"""
)
def ece_mce(spark, sf_dir):
    """Expected and largest calibration error."""
    e = ev.calibration_error(scored(spark, sf_dir), ["threshold"])
    return e.select("threshold", r6(F.col("ece")).alias("ece"), r6(F.col("mce")).alias("mce"), "label")


@query(
    f"""WITH {SCORED}, halves AS (SELECT *, CASE WHEN t < (SELECT quantile_disc(t, 0.5) FROM scored) THEN 'first' ELSE 'second' END AS half FROM scored), b AS (SELECT half, {_BIN} AS bin, count(*) AS n, avg(p) AS m, avg(y) AS f FROM halves GROUP BY half, {_BIN})
    SELECT half, sum(n)::BIGINT AS n, round(sum(n * abs(m - f)) / sum(n), 6) AS ece FROM b GROUP BY half"""
)
def calibration_halves(spark, sf_dir):
    """Calibration error before and after the middle as-of bar, which parts fitting from checking."""
    s = scored(spark, sf_dir)
    middle = s.agg(F.expr("percentile_disc(0.5) within group (order by t)").alias("m"))
    h = s.crossJoin(F.broadcast(middle)).withColumn("half", F.when(F.col("t") < F.col("m"), "first").otherwise("second"))
    n = h.groupBy("half").agg(F.count(F.lit(1)).alias("n"))
    return ev.calibration_error(h, ["half"]).join(n, "half").select("half", "n", r6(F.col("ece")).alias("ece"))


def intervals(spark, sf_dir) -> DataFrame:
    """(sym, t, lo, hi, y): normal 90 % intervals from the log returns that had ended by t, and the log return that came."""
    b = views.bars(spark, sf_dir).select("sym", "d", (F.row_number().over(symbol()) - 1).alias("t"), F.ln(F.lead("c", 20).over(symbol()) / F.col("c")).alias("r"))
    w = symbol().rowsBetween(Window.unboundedPreceding, -20)
    b = b.select("sym", "t", "r", F.count("r").over(w).alias("n"), F.avg("r").over(w).alias("m"), F.stddev_samp("r").over(w).alias("s"))
    b = b.where("t >= 80 and (t - 80) % 20 = 0 and r is not null and n >= 30")
    return b.select("sym", "t", F.round(F.col("m") - 1.645 * F.col("s"), 9).alias("lo"), F.round(F.col("m") + 1.645 * F.col("s"), 9).alias("hi"), F.round("r", 9).alias("y"))


INTERVALS = f"""{BARS}, num AS (SELECT sym, d, row_number() OVER w - 1 AS t, ln(lead(c, 20) OVER w / c) AS r FROM bars WINDOW w AS (PARTITION BY sym ORDER BY d)),
  ended AS (SELECT sym, t, r, count(r) OVER w AS n, avg(r) OVER w AS m, stddev_samp(r) OVER w AS s FROM num WINDOW w AS (PARTITION BY sym ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 20 PRECEDING)),
  intervals AS (SELECT sym, t, round(m - 1.645::DOUBLE * s, 9) AS lo, round(m + 1.645::DOUBLE * s, 9) AS hi, round(r, 9) AS y FROM ended WHERE t >= 80 AND (t - 80) % 20 = 0 AND r IS NOT NULL AND n >= 30)"""
Q = f"{INTERVALS}, ranks AS (SELECT sym, greatest(lo - y, y - hi) AS s, count(*) OVER (PARTITION BY sym) AS n, row_number() OVER (PARTITION BY sym ORDER BY greatest(lo - y, y - hi)) AS k FROM intervals), qs AS (SELECT sym, any_value(n) AS n, max(s) FILTER (k = ceil(round((n + 1) * 0.9::DOUBLE, 9))) AS q FROM ranks GROUP BY sym)"


@query(f"WITH {Q} SELECT sym, n, round(q, 6) AS q FROM qs")
def conformal_q(spark, sf_dir):
    """Correction of each symbol's 90 % intervals: an order statistic, not a quantile."""
    q = ev.conformal_q(intervals(spark, sf_dir).withColumn("s", ev.nonconformity()), ["sym"], 0.1)
    return q.select("sym", "n", r6(F.col("q")).alias("q"))


@query(f"WITH {INTERVALS} SELECT sym, count(*) AS n, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(hi - lo), 6) AS width FROM intervals GROUP BY sym")
def coverage_width(spark, sf_dir):
    """Share of outcomes inside their intervals, and the mean width."""
    i = intervals(spark, sf_dir)
    return i.groupBy("sym").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double"))).alias("coverage"), r6(F.avg(F.col("hi") - F.col("lo"))).alias("width"))


@query(
    f"""WITH {INTERVALS}, cut AS (SELECT *, row_number() OVER (PARTITION BY sym ORDER BY t) AS i, count(*) OVER (PARTITION BY sym) AS n FROM intervals), half AS (SELECT *, CAST(round_even(n * 0.5, 0) AS BIGINT) AS c FROM cut),
    fit AS (SELECT sym, greatest(lo - y, y - hi) AS s, c, row_number() OVER (PARTITION BY sym ORDER BY greatest(lo - y, y - hi)) AS k FROM half WHERE i <= c), q AS (SELECT sym, max(s) FILTER (k = ceil(round((c + 1) * 0.9::DOUBLE, 9))) AS q FROM fit GROUP BY sym)
    SELECT h.sym, count(*) AS n_eval, round(any_value(q.q), 6) AS correction, round(avg(CASE WHEN y BETWEEN lo AND hi THEN 1.0::DOUBLE ELSE 0 END), 6) AS coverage, round(avg(hi - lo), 6) AS width,
      round(avg(CASE WHEN q.q IS NOT NULL THEN CASE WHEN y BETWEEN least(lo - q.q, hi + q.q) AND greatest(lo - q.q, hi + q.q) THEN 1.0::DOUBLE ELSE 0 END END), 6) AS coverage_after, round(avg(abs(hi - lo + 2 * q.q)), 6) AS width_after
    FROM half h LEFT JOIN q ON q.sym = h.sym WHERE i > c AND c >= 15 AND n - c >= 15 GROUP BY h.sym"""
)
def conformal_metrics_split(spark, sf_dir):
    """Corrections fitted on the earlier half of each symbol's intervals, checked on the later one; at least 15 in each."""
    w = Window.partitionBy("sym")
    h = intervals(spark, sf_dir).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("i", F.row_number().over(w.orderBy("t"))).withColumn("cut", F.bround(F.col("n") * 0.5).cast("long"))
    q = ev.conformal_q(h.where("i <= cut").withColumn("s", ev.nonconformity()).select("sym", "s"), ["sym"], 0.1).select("sym", "q")
    late = h.where("i > cut and cut >= 15 and n - cut >= 15").join(q, "sym", "left")
    lo, hi, inside = F.col("lo") - F.col("q"), F.col("hi") + F.col("q"), F.col("y").between(F.col("lo"), F.col("hi"))
    after = F.when(F.col("q").isNotNull(), F.col("y").between(F.least(lo, hi), F.greatest(lo, hi)).cast("double"))
    return late.groupBy("sym").agg(F.count(F.lit(1)).alias("n_eval"), r6(F.first("q")).alias("correction"), r6(F.avg(inside.cast("double"))).alias("coverage"), r6(F.avg(F.col("hi") - F.col("lo"))).alias("width"), r6(F.avg(after)).alias("coverage_after"), r6(F.avg(F.abs(hi - lo))).alias("width_after"))


@query(f"WITH {Q} SELECT i.sym, i.t, round(CASE WHEN lo - coalesce(q, 0) > hi + coalesce(q, 0) THEN (lo + hi) / 2 ELSE lo - coalesce(q, 0) END, 6) AS lo, round(CASE WHEN lo - coalesce(q, 0) > hi + coalesce(q, 0) THEN (lo + hi) / 2 ELSE hi + coalesce(q, 0) END, 6) AS hi FROM intervals i LEFT JOIN (SELECT * FROM qs WHERE sym <> 'Brand#11') q ON q.sym = i.sym")
def conformal_lookup_left(spark, sf_dir):
    """Intervals shifted by their symbol's correction; none for a symbol without one."""
    i = intervals(spark, sf_dir)
    q = ev.conformal_q(i.withColumn("s", ev.nonconformity()), ["sym"], 0.1).where("sym <> 'Brand#11'").select("sym", "q")
    lo, hi = ev.shifted(F.coalesce("q", F.lit(0.0)))
    return i.join(q, "sym", "left").select("sym", "t", r6(lo).alias("lo"), r6(hi).alias("hi"))


@query(
    f"""WITH {SCORED}, labelled AS (SELECT *, label, CASE label WHEN 'baseline' THEN p WHEN 'shrunk' THEN round(0.5 * p + 0.25, 9) ELSE round(p * p, 9) END AS q FROM scored, (VALUES ('baseline'), ('shrunk'), ('squared')) v(label)),
    b AS (SELECT label, {_BIN.replace('p <', 'q <')} AS bin, count(*) AS n, avg(q) AS m, avg(y) AS f FROM labelled GROUP BY label, {_BIN.replace('p <', 'q <')}), e AS (SELECT label, sum(n * abs(m - f)) / sum(n) AS ece FROM b GROUP BY label),
    s AS (SELECT label, avg((q - y) * (q - y)) AS brier FROM labelled GROUP BY label), t AS (SELECT label, brier, ece FROM s JOIN e USING (label))
    SELECT t.label, round(t.brier, 6) AS brier, round(t.ece, 6) AS ece, round(b.brier - t.brier, 6) AS brier_gain, round(b.ece - t.ece, 6) AS ece_gain, b.brier - t.brier >= 1e-4 AND b.ece - t.ece >= 0 AS promote FROM t, (SELECT * FROM t WHERE label = 'baseline') b"""
)
def ablation_table(spark, sf_dir):
    """Variants against a baseline, and which of them would replace it."""
    s, p = scored(spark, sf_dir), F.col("p")
    variants = F.array(F.struct(F.lit("baseline").alias("variant"), p.alias("q")), F.struct(F.lit("shrunk").alias("variant"), F.round(0.5 * p + 0.25, 9).alias("q")), F.struct(F.lit("squared").alias("variant"), F.round(p * p, 9).alias("q")))
    v = s.select("y", F.inline(variants)).select("y", "variant", F.col("q").alias("p"))
    t = v.groupBy("variant").agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier")).join(ev.calibration_error(v, ["variant"]).select("variant", "ece"), "variant")
    base = t.where("variant = 'baseline'").select(F.col("brier").alias("b0"), F.col("ece").alias("e0"))
    gain, ece_gain = F.col("b0") - F.col("brier"), F.col("e0") - F.col("ece")
    return t.crossJoin(F.broadcast(base)).select(F.col("variant").alias("label"), r6(F.col("brier")).alias("brier"), r6(F.col("ece")).alias("ece"), r6(gain).alias("brier_gain"), r6(ece_gain).alias("ece_gain"), ((gain >= 1e-4) & (ece_gain >= 0)).alias("promote"))


@query(
    f"""WITH {SCORED}, grid AS (SELECT 0.5 + 0.1 * unnest(range(26)) AS temperature), l AS (SELECT y, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS z FROM scored)
    SELECT round(temperature::DOUBLE, 1) AS temperature, round(avg(-(y * ln(1 / (1 + exp(-z / temperature::DOUBLE))) + (1 - y) * ln(1 - 1 / (1 + exp(-z / temperature::DOUBLE))))), 6) AS nll FROM l, grid GROUP BY temperature"""
)
def temperature_grid(spark, sf_dir):
    """Log-loss of scores whose log-odds are divided by each of 26 temperatures."""
    s = scored(spark, sf_dir)
    q = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    s = s.select("y", F.ln(q / (1 - q)).alias("z"), F.explode(F.array(*(F.lit(round(0.5 + 0.1 * k, 1)) for k in range(26)))).alias("temperature"))
    p = 1 / (1 + F.exp(-F.col("z") / F.col("temperature")))
    return s.groupBy("temperature").agg(r6(F.avg(-(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p)))).alias("nll"))


@query()
def isotonic_calibration(spark, sf_dir):
    """Scores mapped by isotonic regression: an iterative fit, tested for monotony and calibration."""
    c = ev.isotonic(scored(spark, sf_dir))
    return c.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.first("calibrated").alias("calibrated"), F.avg("y").alias("frequency"))


@query()
def platt_calibration(spark, sf_dir):
    """Scores mapped by logistic regression on their log-odds: an iterative fit."""
    c = ev.platt(scored(spark, sf_dir))
    return c.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.first("calibrated").alias("calibrated"))


_CUT = "2000-01-01"


def _stored_matrix(spark, sf_dir) -> DataFrame:
    """The feature matrix of all bars, stored once: fits read it many times."""

    def build(path: str) -> DataFrame:
        series.matrix(spark, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return stored(spark, sf_dir, "matrix", build, spark.read.parquet)


def _pooled(spark, sf_dir, kind: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    rows = series.with_targets(_stored_matrix(spark, sf_dir))
    cut = F.lit(_CUT).cast("date")
    model = ev.pooled_model(rows.where(F.date_add("d", 40) < cut), list(series.FEATURES), "gt_00p", kind)
    late = model.transform(rows.where(F.col("d") >= cut).withColumn("label", F.col("gt_00p").cast("double")))
    got = late.select("sym", "d", F.col("gt_00p").alias("y"), vector_to_array("probability")[1].alias("p"))
    return got.groupBy("sym").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("mean_p"), r6(F.avg("y")).alias("base_rate"), r6(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).alias("brier"))


@query()
def pooled_logistic(spark, sf_dir):
    """One logistic model over all symbols, fitted before an embargo, scored after it: an iterative fit."""
    return _pooled(spark, sf_dir, "logistic")


@query()
def pooled_boosted(spark, sf_dir):
    """The same with boosted trees."""
    return _pooled(spark, sf_dir, "boosted")


@query()
def pooled_exceedance(spark, sf_dir):
    """A logistic model for each of two horizons and five thresholds: fitted on returns known before a day, stored, loaded, and scored after it; iterative fits."""
    cut, columns = F.lit(_CUT).cast("date"), list(series.FEATURES)
    rows = md.horizon_targets(_stored_matrix(spark, sf_dir), columns, (20, 60))
    store = md.ModelStore(spark, md.ModelStore.fit(rows.where(F.col("until") < cut), columns, scratch(spark, "models")).path)
    out = None
    for h in (20, 60):
        p = store.exceedance(rows.where((F.col("d") >= cut) & (F.col("horizon") == h)), h)
        pairs = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col("p")[k].alias("p"), (F.col("fwd") > t).cast("double").alias("y")) for k, t in enumerate(store.thresholds(h))))
        one = p.select("horizon", F.inline(pairs).alias("threshold", "q", "y"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("horizon", "threshold").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("q")).alias("mean_p"), r6(F.avg("y")).alias("base_rate"), r6(F.avg((F.col("q") - F.col("y")) * (F.col("q") - F.col("y")))).alias("brier"))


def _refits(spark, sf_dir) -> DataFrame:
    """Forecasts of three models that are fitted anew on each fold, stored once."""

    def build(path: str) -> DataFrame:
        b = views.bars(spark, sf_dir).select("sym", "d", "c")
        folds = fc.walk_forward(b.groupBy("sym").agg(F.count(F.lit(1)).alias("n")), horizon=20, min_train=252, test_size=6)
        md.refit(b, folds, 20, 20).write.parquet(path)
        return spark.read.parquet(path)

    return stored(spark, sf_dir, "refits", build, spark.read.parquet)


@query()
def walk_forward_models(spark, sf_dir):
    """Scores of a list of models that are fitted anew on each fold, an embargo before its tests: fits in numpy, tested against brute force."""
    s = _refits(spark, sf_dir)
    p, y = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15)), F.col("y").cast("double")
    return s.groupBy("model", "threshold").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg(y)).alias("base_rate"), r6(F.avg((F.col("p") - y) * (F.col("p") - y))).alias("brier"), r6(F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p)))).alias("log_loss")
    )


@query()
def stacked_ensemble(spark, sf_dir):
    """Brier scores of each refitted model and of their stack, whose weights on the simplex come from the first half of the folds: a small programme, tested against a grid."""
    s = _refits(spark, sf_dir)
    half = F.col("fold") < F.max("fold").over(Window.partitionBy("sym")) / 2
    s = s.withColumn("early", half)
    by, members = ["sym", "t", "threshold"], list(md.MODELS)
    _, weights = md.stacked(s.where("early"), by, members)
    late = s.where(~F.col("early"))
    wide = late.groupBy(*by, "y").pivot("model", members).agg(F.first("p"))
    stack = wide.select(*by, "y", F.lit("stack").alias("model"), sum((F.col(m) * w for m, w in weights.items()), F.lit(0.0)).alias("p"))
    named = spark.createDataFrame([*weights.items(), ("stack", 1.0)], "model string, weight double")
    scored = late.select("model", "y", "p").unionByName(stack.select("model", "y", "p"))
    brier = scored.groupBy("model").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).alias("brier"))
    return brier.join(F.broadcast(named), "model").select("model", r6(F.col("weight")).alias("weight"), "n", "brier")
