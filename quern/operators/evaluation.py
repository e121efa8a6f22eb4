"""Scores of probability forecasts, calibration and conformal corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _mean(x: Column) -> Column:
    return F.avg(x.cast("double"))


def binary_scores() -> list[Column]:
    """Base rate, Brier score, log-loss, accuracy, precision and recall of (p, y); NULL where nothing is predicted or there."""
    y, p = F.col("y").cast("double"), F.col("p")
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    said, true = p >= 0.5, F.col("y") == 1
    hits = F.count_if(said & true)
    return [
        F.count(F.lit(1)).alias("n"), _mean(y).alias("base_rate"), _mean((p - y) * (p - y)).alias("brier"), _mean(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"),
        _mean(said == true).alias("accuracy"), F.try_divide(hits, F.count_if(said)).alias("precision"), F.try_divide(hits, F.count_if(true)).alias("recall"),
    ]


def roc_auc(scored: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auc) of (keys, p, y): the share of pairs in right order, ties by half; NULL with one class alone.

    Ranks come from counts of distinct scores, so the window sees each score once, however many rows share it.
    """
    per = scored.groupBy(*keys, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    below = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    won = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2))
    return per.groupBy(*keys).agg(F.try_divide(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("auc"))


def bin_of(p: Column, n: int = 10) -> Column:
    """Equal-width bin of a probability; a value on an edge belongs above it, 1 to the last."""
    edges = [k / n for k in range(1, n)]
    out = F.when(p < edges[0], 0)
    for k, e in enumerate(edges[1:], 1):
        out = out.when(p < e, k)
    return out.otherwise(n - 1)


def reliability(scored: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """Count, mean forecast and frequency of each bin that is not empty."""
    b = scored.withColumn("bin", bin_of(F.col("p"), n))
    return b.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), _mean(F.col("y")).alias("frequency"))


def calibration_error(scored: DataFrame, keys: list[str], n: int = 10) -> DataFrame:
    """(keys, ece, mce, label): expected and largest gap between forecast and frequency."""
    gap = F.abs(F.col("mean_p") - F.col("frequency"))
    per = reliability(scored, keys, n).groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"))
    return per.withColumn("label", F.when(F.col("ece") < 0.05, "well-calibrated").when(F.col("ece") < 0.10, "moderately calibrated").otherwise("poorly calibrated"))


def conformal_q(scores: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    """(keys, n, q) of nonconformity scores (s): the ceil((n + 1)(1 - alpha))-th smallest, NULL (no finite one) beyond n."""
    w = Window.partitionBy(*keys)
    wanted = F.ceil(F.round((F.col("__n") + 1) * (1 - alpha), 9))
    ranked = scores.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__k", F.row_number().over(w.orderBy("s")))
    return ranked.groupBy(*keys).agg(F.first("__n").alias("n"), F.max(F.when(F.col("__k") == wanted, F.col("s"))).alias("q"))


def pooled_conformal_q(scores: DataFrame, keys: list[str], alpha: float, pieces: int = 128) -> DataFrame:
    """The same as ``conformal_q`` for a few keys with any number of scores each.

    Equal scores are counted first.  Approximate quantiles cut each key's scores into ranges;
    a running sum over at most ``pieces`` ranges places them, and only within a range are scores
    put in order, so no task orders a key's scores and the result is exact.
    """
    tallied = scores.groupBy(*keys, "s").agg(F.count(F.lit(1)).alias("__c"))
    cuts = tallied.groupBy(*keys).agg(F.sum("__c").alias("n"), F.percentile_approx("s", [k / pieces for k in range(1, pieces)]).alias("__cuts"))
    placed = tallied.join(cuts, keys).withColumn("__b", F.size(F.filter("__cuts", lambda x: x < F.col("s"))))
    running = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy(*keys, "__b").agg(F.sum("__c").alias("__m"))
    ranges = ranges.select(*keys, "__b", F.coalesce(F.sum("__m").over(running), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(*keys, "__b").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("__before") + F.sum("__c").over(inside)
    wanted = F.ceil(F.round((F.col("n") + 1) * (1 - alpha), 9))
    ranked = placed.join(ranges, [*keys, "__b"]).withColumn("__upto", upto)
    return ranked.groupBy(*keys).agg(F.first("n").alias("n"), F.min(F.when(F.col("__upto") >= wanted, F.col("s"))).alias("q"))


def nonconformity() -> Column:
    return F.greatest(F.col("lo") - F.col("y"), F.col("y") - F.col("hi"))


def shifted(q: Column) -> tuple[Column, Column]:
    """An interval widened by q; an inverted one falls to its middle."""
    lo, hi = F.col("lo") - q, F.col("hi") + q
    middle = (F.col("lo") + F.col("hi")) / 2
    return F.when(lo > hi, middle).otherwise(lo), F.when(lo > hi, middle).otherwise(hi)


def isotonic(scored: DataFrame) -> DataFrame:
    """(p, y, calibrated): scores mapped by isotonic regression of y on p."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rows = VectorAssembler(inputCols=["p"], outputCol="features").transform(scored.withColumn("label", F.col("y").cast("double")))
    return IsotonicRegression().fit(rows).transform(rows).select("p", "y", F.col("prediction").alias("calibrated"))


def platt(scored: DataFrame) -> DataFrame:
    """(p, y, calibrated): scores mapped by a logistic regression of y on their log-odds."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    q = F.least(F.greatest("p", F.lit(1e-6)), F.lit(1 - 1e-6))
    rows = scored.withColumn("label", F.col("y").cast("double")).withColumn("logit", F.ln(q / (1 - q)))
    rows = VectorAssembler(inputCols=["logit"], outputCol="features").transform(rows)
    fitted = LogisticRegression(maxIter=50).fit(rows).transform(rows)
    return fitted.select("p", "y", vector_to_array("probability")[1].alias("calibrated"))


def _prepared(columns: list[str]) -> list:
    """Stages of the columns' median imputation, assembly and scaling into ``features``."""
    from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler

    filled = [f"{f}__filled" for f in columns]
    return [Imputer(strategy="median", inputCols=columns, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="raw"), StandardScaler(withMean=True, inputCol="raw", outputCol="features")]


def _classifier(kind: str):
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    return GBTClassifier(maxIter=10, seed=42) if kind == "boosted" else LogisticRegression(maxIter=50, regParam=0.01)


def pooled_model(rows: DataFrame, features: list[str], target: str, kind: str = "logistic"):
    """A pipeline fitted on (features, target): median imputation, scaling, then a logistic or a boosted-tree classifier.

    All of it is fitted on the rows given, so training rows alone must be given.
    """
    return pooled_models(rows, features, {target: F.col(target)}, kind)[target]


def pooled_models(rows: DataFrame, features: list[str], targets: dict[str, Column], kind: str = "logistic") -> dict:
    """The same for several targets, which share what prepares their features: that is fitted and worked out once."""
    from pyspark.ml import Pipeline, PipelineModel

    prepare = Pipeline(stages=_prepared(features)).fit(rows)
    ready = prepare.transform(rows).select("features", *(t.cast("double").alias(name) for name, t in targets.items())).persist()
    try:  # fits are eager, so the rows are needed no longer than this
        return {name: PipelineModel([*prepare.stages, _classifier(kind).fit(ready.select("features", F.col(name).alias("label")))]) for name in targets}
    finally:
        ready.unpersist()
