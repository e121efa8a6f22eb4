"""Off-policy evaluation, bandits and returns of logged decisions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weights(log: DataFrame) -> DataFrame:
    """``log`` (action, propensity, target array<double>) with w, the target's probability over the logged one."""
    return log.withColumn("w", F.try_divide(F.get("target", F.col("action")), F.col("propensity")))


def estimates() -> list[Column]:
    """IPS, self-normalised IPS and effective sample size of (w, reward)."""
    w, r = F.col("w"), F.col("reward")
    return [F.avg(w * r).alias("ips"), F.coalesce(F.try_divide(F.sum(w * r), F.sum(w)), F.lit(0.0)).alias("snips"), F.coalesce(F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w)), F.lit(0.0)).alias("ess")]


def doubly_robust() -> Column:
    """Mean of the model's value under the target and the weighed rest, of (w, reward, action, target, q array<double>)."""
    direct = F.aggregate(F.zip_with("target", "q", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    return F.avg(direct + F.col("w") * (F.col("reward") - F.get("q", F.col("action"))))


def normal_equations(log: DataFrame, dim: int) -> DataFrame:
    """(action, gram array<double>, xr array<double>) sums of (action, x array<double>, reward): dim x dim numbers for each arm, summed map-side."""
    gram = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"g{i}_{j}") for i in range(dim) for j in range(i, dim)]
    xr = [F.sum(F.col("x")[i] * F.col("reward")).alias(f"b{i}") for i in range(dim)]
    s = log.groupBy("action").agg(*gram, *xr)
    return s.select("action", F.array(*(f"g{min(i, j)}_{max(i, j)}" for i in range(dim) for j in range(dim))).alias("gram"), F.array(*(f"b{i}" for i in range(dim))).alias("xr"))


def ridge(equations: DataFrame, dim: int, penalty: float = 1.0) -> DataFrame:
    """(action, theta, inverse): each arm's ridge weights and inverted matrix."""

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                a = np.array(r.gram, float).reshape(dim, dim) + penalty * np.eye(dim)
                rows.append((r.action, np.linalg.solve(a, np.array(r.xr, float)).tolist(), np.linalg.inv(a).ravel().tolist()))
            yield pd.DataFrame(rows, columns=["action", "theta", "inverse"])

    return equations.mapInPandas(solve, "action int, theta array<double>, inverse array<double>")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)


def predictions(rows: DataFrame, arms: DataFrame) -> DataFrame:
    """``rows`` (x) with q, each arm's prediction in arm order.  One row for each arm is broadcast."""
    table = arms.agg(F.array_sort(F.collect_list(F.struct("action", "theta"))).alias("arms"))
    return rows.crossJoin(F.broadcast(table)).withColumn("q", F.transform("arms", lambda a: _dot(a["theta"], F.col("x")))).drop("arms")


def linucb(rows: DataFrame, arms: DataFrame, dim: int, alpha: float = 1.0) -> DataFrame:
    """``rows`` (x) with scores, each arm's prediction and its width, and the best arm."""
    table = arms.agg(F.array_sort(F.collect_list(F.struct("action", "theta", "inverse"))).alias("arms"))
    x = F.col("x")

    def score(a: Column) -> Column:
        rows_ = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: _dot(F.slice(a["inverse"], i * dim + 1, F.lit(dim)), x))
        return _dot(a["theta"], x) + alpha * F.sqrt(_dot(rows_, x))

    out = rows.crossJoin(F.broadcast(table)).withColumn("scores", F.transform("arms", score))
    return out.withColumn("arm", (F.array_position("scores", F.array_max("scores")) - 1).cast("int")).drop("arms")


def returns_to_go(rewards: Column, gamma: float) -> Column:
    """Discounted sums from each step on, of an array of rewards."""
    back = F.aggregate(F.reverse(rewards), F.array().cast("array<double>"), lambda acc, r: F.concat(acc, F.array(r + gamma * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))
    return F.reverse(back)


def advantages(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages of arrays of rewards and values; the value after the end is 0."""
    later = F.concat(F.slice(values, F.lit(2), F.size(values)), F.array(F.lit(0.0)))
    delta = F.zip_with(F.zip_with(rewards, later, lambda r, v: r + gamma * v), values, lambda a, v: a - v)
    return returns_to_go(delta, gamma * lam)


def bootstrap_interval(log: DataFrame, key: str, n_boot: int = 500, seed: int = 42, alpha: float = 0.05, per_task: int = 50) -> DataFrame:
    """(key, estimate, low, high) of IPS over groups (grp) drawn with replacement.

    A group's sum and count are all that a draw needs.  Draws are made ``per_task`` at a time, each lot by a generator of its own number, so a key's draws
    are many tasks' work; the interval's ends are quantiles of all draws.
    """
    sums = log.groupBy(key, "grp").agg(F.sum(F.col("w") * F.col("reward")).alias("s"), F.count(F.lit(1)).alias("n"))
    estimate = sums.groupBy(key).agg((F.sum("s") / F.sum("n")).alias("estimate"))
    lots = -(-n_boot // per_task)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("grp")
        s, n, lot = pdf["s"].to_numpy(float), pdf["n"].to_numpy(float), int(pdf["lot"].iloc[0])
        rng = np.random.default_rng([seed, lot])
        draws = []
        for _ in range(min(per_task, n_boot - lot * per_task)):
            pick = rng.integers(0, len(s), len(s))
            draws.append(s[pick].sum() / n[pick].sum())
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(draws), "draw": draws})

    kind = {f.name: f.dataType.simpleString() for f in log.schema.fields}[key]
    lotted = sums.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    draws = lotted.groupBy(key, "lot").applyInPandas(run, f"{key} {kind}, draw double")
    ends = draws.groupBy(key).agg(F.percentile("draw", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("ends"))
    return estimate.join(ends, key).select(key, "estimate", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))


def fixed(arm: int, n_arms: int) -> Column:
    """Probabilities of a policy that always takes one arm."""
    return F.array(*(F.lit(float(k == arm)) for k in range(n_arms)))


def uniform(n_arms: int) -> Column:
    """Probabilities of a policy that takes each arm alike."""
    return F.array(*(F.lit(1.0 / n_arms) for _ in range(n_arms)))


def epsilon_greedy(scores: Column, epsilon: float) -> Column:
    """Probabilities of a policy that takes the best of an array of scores (the first of equal ones), and any arm at random in a share ``epsilon`` of cases."""
    n = F.size(scores)
    best = F.array_position(scores, F.array_max(scores)) - 1
    return F.transform(scores, lambda _, k: epsilon / n + F.when(k == best, 1 - epsilon).otherwise(0.0))
