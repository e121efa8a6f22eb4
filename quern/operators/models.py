"""A store of pooled models, refits along folds, and stacked weights of forecasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.windows import symbol
from quern.operators.evaluation import pooled_models
from quern.operators.kernels import EDGES

#: Weight of the pull of stacked weights towards equal ones.
RIDGE = 1e-3


def horizon_targets(features: DataFrame, columns: list[str], horizons: tuple[int, ...]) -> DataFrame:
    """Rows (sym, d, c, columns) once for each horizon that ends within the bars, with ``horizon``, ``fwd`` and ``until``, the day the return is known.

    All horizons come from one pass of windows; rows without any feature are left out.
    """
    each = F.array(*(F.struct(F.lit(h).alias("horizon"), (F.lead("c", h).over(symbol()) / F.col("c") - 1).alias("fwd"), F.lead("d", h).over(symbol()).alias("until")) for h in horizons))
    long = features.where(F.coalesce(*columns).isNotNull()) if columns else features
    return features.withColumn("each", each).join(long.select("sym", "d"), ["sym", "d"], "left_semi").select("sym", "d", *columns, F.inline("each")).where("fwd IS NOT NULL")


class ModelStore:
    """Models under ``path``, one for each horizon and threshold, and a manifest of what each was fitted on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = spark.read.parquet(f"{self.path}/manifest").orderBy("horizon", "threshold")

    @classmethod
    def fit(cls, rows: DataFrame, columns: list[str], path: str, thresholds: tuple[float, ...] = EDGES, kind: str = "logistic") -> ModelStore:
        """Fit a model for each horizon of ``rows`` (horizon, fwd, until, columns) and each threshold, and store them under a new ``path``.

        Only rows given are seen, so give training rows alone.  A target that never or always happens has a constant for a model.
        The rows are stored by horizon; a horizon's models share the preparation of their features.  The grid is a configuration of a few models.
        """
        spark, path = rows.sparkSession, path.rstrip("/")
        rows.write.partitionBy("horizon").parquet(f"{path}/rows")
        rows = spark.read.parquet(f"{path}/rows")
        counts = [F.sum((F.col("fwd") > t).cast("long")).alias(f"up{k}") for k, t in enumerate(thresholds)]
        facts = rows.groupBy("horizon").agg(F.count(F.lit(1)).alias("n"), F.max("until").alias("until"), *counts).orderBy("horizon").collect()
        entries = []
        for f in facts:
            own = rows.where(F.col("horizon") == f.horizon)
            names = {t: f"model-{f.horizon}-{k}" for k, t in enumerate(thresholds) if 0 < f[f"up{k}"] < f.n}
            for name, model in pooled_models(own, columns, {n: F.col("fwd") > t for t, n in names.items()}, kind).items():
                model.save(f"{path}/{name}")
            entries += [(f.horizon, t, kind, f.n, f[f"up{k}"] / f.n, f.until, names.get(t), list(columns), t not in names) for k, t in enumerate(thresholds)]
        schema = "horizon int, threshold double, kind string, rows long, base_rate double, until date, name string, columns array<string>, constant boolean"
        spark.createDataFrame(entries, schema).coalesce(1).write.parquet(f"{path}/manifest")
        return cls(spark, path)

    def exceedance(self, rows: DataFrame, horizon: int) -> DataFrame:
        """``rows`` (columns, ...) with p, an array of the probabilities to exceed each threshold, ascending, of a horizon's stored models.

        A higher threshold is never exceeded more often: each takes the least probability so far.
        """
        entries = self.manifest.where(F.col("horizon") == horizon).collect()
        if not entries:
            raise ValueError(f"no models for a horizon of {horizon}")
        kept = rows.columns
        for k, e in enumerate(entries):
            if e.constant:
                rows = rows.withColumn(f"p{k}", F.lit(e.base_rate))
                continue
            scored = PipelineModel.load(f"{self.path}/{e.name}").transform(rows)
            rows = scored.select(*kept, *(f"p{j}" for j in range(k)), vector_to_array("probability")[1].alias(f"p{k}"))
        p = F.array(*(F.col(f"p{k}") for k in range(len(entries))))
        return rows.select(*kept, F.transform(p, lambda _, k: F.array_min(F.slice(p, F.lit(1), k + 1))).alias("p"))

    def thresholds(self, horizon: int) -> list[float]:
        return [r.threshold for r in self.manifest.where(F.col("horizon") == horizon).collect()]


# refits along folds: a task is a fold and a model ------------------------------------------


def _historical(closes: np.ndarray, train: int, tests: np.ndarray, horizon: int) -> np.ndarray:
    """Shares of the returns that had ended by the last training bar."""
    r = closes[horizon : train + 1] / closes[: train + 1 - horizon] - 1
    return np.tile([(r > e).mean() for e in EDGES], (len(tests), 1))


def _normal(closes: np.ndarray, train: int, tests: np.ndarray, horizon: int) -> np.ndarray:
    """Lognormal returns with the drift and volatility of the last 60 training log returns."""
    from math import erf, sqrt

    lr = np.diff(np.log(closes[: train + 1]))[-60:]
    mean, sd = lr.mean() * horizon, lr.std(ddof=1) * sqrt(horizon)
    above = [0.5 - 0.5 * erf((np.log1p(e) - mean) / (sd * sqrt(2))) if sd > 0 else float(mean > np.log1p(e)) for e in EDGES]
    return np.tile(above, (len(tests), 1))


def _features(closes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log return over 20 bars and volatility of 20 log returns up to each bar."""
    log = np.log(closes)
    lr = np.diff(log, prepend=log[0])
    window = lr[at[:, None] - np.arange(20)]
    return np.column_stack([log[at] - log[at - 20], window.std(axis=1)])


def _logistic(closes: np.ndarray, train: int, tests: np.ndarray, horizon: int) -> np.ndarray:
    """A logistic regression for each threshold on training bars whose return had ended by the last one."""
    at = np.arange(20, train + 1 - horizon)
    x, ahead = _features(closes, at), _features(closes, tests)
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-12
    x, ahead = (np.column_stack([np.ones(len(v)), (v - mean) / sd]) for v in (x, ahead))
    r = closes[at + horizon] / closes[at] - 1
    out = np.empty((len(tests), len(EDGES)))
    for k, e in enumerate(EDGES):
        y, w = (r > e).astype(float), np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-x @ w))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), x.T @ (y - p) - w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        out[:, k] = 1 / (1 + np.exp(-ahead @ w))
    return np.minimum.accumulate(out, axis=1)


#: Models by name: closes, last training bar, test bars, horizon -> probability to exceed each threshold at each test bar.
MODELS = {"historical": _historical, "normal": _normal, "logistic": _logistic}


def refit(bars: DataFrame, folds: DataFrame, horizon: int, stride: int, models: tuple[str, ...] = tuple(MODELS)) -> DataFrame:
    """(sym, fold, model, t, threshold, p, y): each model fitted anew on each fold's training bars, and its forecasts of the fold's tests.

    ``folds`` is that of ``forecast.walk_forward``.  A task's unit is a fold and a model of a symbol, with the closes up to its last test and the horizon
    after it, so units are dealt over all tasks, however few symbols there are; a model sees no bar behind the last training bar.
    """
    closes = bars.groupBy("sym").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "c"))), lambda b: b["c"]).alias("closes"))
    units = folds.select("sym", "fold", "train_end", "test_start", "test_end").withColumn("model", F.explode(F.array(*map(F.lit, models))))
    units = units.join(closes, "sym").withColumn("closes", F.slice("closes", 1, (F.col("test_end") + horizon + 1).cast("int"))).repartition("sym", "fold", "model")

    def work(batches):
        for pdf in batches:
            for u in pdf.itertuples():
                c, tests = np.asarray(u.closes, float), np.arange(u.test_start, u.test_end + 1, stride)
                p = MODELS[u.model](c[: u.test_end + 1], int(u.train_end), tests, horizon)
                r = c[tests + horizon] / c[tests] - 1
                n, m = len(tests), len(EDGES)
                yield pd.DataFrame({"sym": u.sym, "fold": u.fold, "model": u.model, "t": np.repeat(tests, m), "threshold": np.tile(EDGES, n), "p": p.ravel(), "y": (r[:, None] > np.array(EDGES)).astype(int).ravel()})

    return units.mapInPandas(work, "sym string, fold long, model string, t long, threshold double, p double, y int")


def simplex(w: np.ndarray) -> np.ndarray:
    """The nearest point whose weights are at least 0 and sum to 1."""
    u = np.sort(w)[::-1]
    level = (np.cumsum(u) - 1) / np.arange(1, len(u) + 1)
    return np.maximum(w - level[np.nonzero(u > level)[0][-1]], 0)


def stack_weights(gram: np.ndarray, cross: np.ndarray, ridge: float = RIDGE, rounds: int = 20_000) -> np.ndarray:
    """Weights on the simplex of the least mean squared error w'Gw - 2 b'w plus the pull towards equal ones, by projected gradient steps."""
    m = len(cross)
    g, b = gram + ridge / m * np.eye(m), cross + ridge / m / m
    w, step = np.full(m, 1 / m), 1 / (2 * np.linalg.eigvalsh(g)[-1])
    for _ in range(rounds):
        new = simplex(w - step * 2 * (g @ w - b))
        if np.abs(new - w).max() < 1e-14:
            break
        w = new
    return w


def stacked(forecasts: DataFrame, by: list[str], members: list[str]) -> tuple[DataFrame, dict[str, float]]:
    """(by, y, p) of the weighted ``forecasts`` (by, model, p, y), and each member's weight.

    Means of products of members are one aggregation; only their matrix, whose size is that of the list of members, reaches the driver.
    Rows that lack a member are left out of the weights, and of the result.
    """
    wide = forecasts.groupBy(*by, "y").pivot("model", members).agg(F.first("p")).where(" AND ".join(f"`{m}` IS NOT NULL" for m in members))
    means: list[Column] = [F.avg(F.col(a) * F.col(b)) for a in members for b in members] + [F.avg(F.col(a) * F.col("y")) for a in members]
    row = wide.agg(*(c.alias(f"x{k}") for k, c in enumerate(means))).first()
    if row is None or row[0] is None:
        return wide.select(*by, "y", F.lit(None).cast("double").alias("p")), {}
    m = len(members)
    x = np.array(list(row), float)
    w = stack_weights(x[: m * m].reshape(m, m), x[m * m :])
    return wide.select(*by, "y", sum((F.col(c) * float(v) for c, v in zip(members, w)), F.lit(0.0)).alias("p")), dict(zip(members, map(float, w)))
