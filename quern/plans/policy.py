"""Queries that evaluate retrieval policies off-line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import policy as po
from quern.plans.base import query
from quern.sources import views

#: Arms and their costs (fixed values).
ARMS = ("dense", "hybrid", "rerank", "graph", "multi")
COSTS = (0.0, 0.1, 0.3, 0.4, 0.3)
DIM = 4


def r6(x: Column) -> Column:
    return F.round(x, 6)


def log(spark, sf_dir) -> DataFrame:
    """(event_id, grp, action, propensity, reward, target, q, x): logged decisions of events."""
    e, i, u = views.table(spark, sf_dir, "events"), F.col("event_id"), F.col("user_id")
    x = F.array(F.lit(1.0), (u % 10) / 10.0, (i % 7) / 7.0, F.col("value") / 100.0)
    target = F.when(u % 2 == 0, F.array(*map(F.lit, (0.6, 0.3, 0.1)))).otherwise(F.array(*map(F.lit, (0.1, 0.2, 0.7))))
    q = F.array((u % 5) / 10.0, (i % 4) / 10.0, F.lit(0.25))
    return e.select("event_id", (u % 50).cast("int").alias("grp"), (i % 3).cast("int").alias("action"), F.when(i % 3 == 0, 0.5).when(i % 3 == 1, 0.3).otherwise(0.2).alias("propensity"), ((F.floor(F.col("value")) % 10) / 10.0).alias("reward"), target.alias("target"), q.alias("q"), x.alias("x"), "event_type")


LOG = """lg AS (SELECT event_id, event_type, user_id % 50 AS grp, event_id % 3 AS action, CASE event_id % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.3::DOUBLE ELSE 0.2::DOUBLE END AS propensity, (CAST(floor(value) AS BIGINT) % 10) / 10.0::DOUBLE AS reward,
  CASE WHEN user_id % 2 = 0 THEN [0.6, 0.3, 0.1]::DOUBLE[] ELSE [0.1, 0.2, 0.7]::DOUBLE[] END AS target, [(user_id % 5) / 10.0::DOUBLE, (event_id % 4) / 10.0::DOUBLE, 0.25::DOUBLE] AS q, [1.0::DOUBLE, (user_id % 10) / 10.0::DOUBLE, (event_id % 7) / 7.0::DOUBLE, value / 100] AS x FROM events),
  wl AS (SELECT *, target[action + 1] / propensity AS w FROM lg)"""


@query(f"WITH {LOG} SELECT event_id, round(w, 6) AS w FROM wl")
def ope_weights(spark, sf_dir):
    """Importance weight of each logged decision."""
    return po.weights(log(spark, sf_dir)).select("event_id", r6(F.col("w")).alias("w"))


@query(f"WITH {LOG} SELECT event_type, count(*) AS n, round(avg(w * reward), 6) AS ips, round(sum(w * reward) / sum(w), 6) AS snips, round(sum(w) * sum(w) / sum(w * w), 6) AS ess FROM wl GROUP BY event_type")
def ope_ips_snips_ess(spark, sf_dir):
    """Value of the target policy by importance sampling, and how many decisions that is worth."""
    g = po.weights(log(spark, sf_dir)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *po.estimates())
    return g.select("event_type", "n", *(r6(F.col(x)).alias(x) for x in ("ips", "snips", "ess")))


@query(f"WITH {LOG} SELECT event_type, round(avg(list_dot_product(target, q) + w * (reward - q[action + 1])), 6) AS dr FROM wl GROUP BY event_type")
def ope_dr(spark, sf_dir):
    """Doubly robust value of the target policy."""
    return po.weights(log(spark, sf_dir)).groupBy("event_type").agg(r6(po.doubly_robust()).alias("dr"))


@query(f"WITH {LOG}, fit AS (SELECT {', '.join(f'avg(x[{k}]) AS m{k}, stddev_pop(x[{k}]) AS s{k}' for k in range(1, 5))} FROM lg WHERE grp % 4 <> 0) SELECT event_id, {', '.join(f'round(CASE WHEN s{k} < 1e-12 THEN x[{k}] ELSE (x[{k}] - m{k}) / s{k} END, 6) AS z{k - 1}' for k in range(1, 5))} FROM lg, fit")
def standardize_train_only(spark, sf_dir):
    """Contexts scaled by the training groups' mean and deviation; constant ones stay."""
    rows = log(spark, sf_dir)
    fit = rows.where("grp % 4 <> 0").agg(*(f(F.col("x")[k]).alias(f"{n}{k}") for k in range(DIM) for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    z = lambda k: F.when(F.col(f"s{k}") < 1e-12, F.col("x")[k]).otherwise((F.col("x")[k] - F.col(f"m{k}")) / F.col(f"s{k}"))
    return rows.crossJoin(F.broadcast(fit)).select("event_id", *(r6(z(k)).alias(f"z{k}") for k in range(DIM)))


@query(f"WITH a AS (SELECT unnest([{', '.join(repr(x) for x in ARMS)}]) AS arm, unnest([{', '.join(map(str, COSTS))}]::DOUBLE[]) AS cost, unnest(range(5)) AS k) SELECT item_id, arm, round((length(\"text\") * (k + 3) % 17) / 17.0::DOUBLE - 0.05::DOUBLE * cost, 6) AS reward FROM benchmark, a")
def reward_matrix(spark, sf_dir):
    """Quality less cost of every question and arm; five arms are a constant."""
    arms = F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(c).alias("cost"), F.lit(k).alias("k")) for k, (a, c) in enumerate(zip(ARMS, COSTS))))
    b = views.table(spark, sf_dir, "benchmark").select("item_id", F.length("text").alias("n"), F.inline(arms))
    return b.select("item_id", "arm", r6((F.col("n") * (F.col("k") + 3) % 17) / 17.0 - 0.05 * F.col("cost")).alias("reward"))


@query(f"WITH {LOG} SELECT event_type, round(avg(list_dot_product(target, q)), 6) AS value, round(avg(list_max(q)), 6) AS best_per_row, round(greatest(avg(q[1]), avg(q[2]), avg(q[3])), 6) AS best_fixed FROM lg GROUP BY event_type")
def true_policy_value(spark, sf_dir):
    """Value of the target under known rewards, of the best choice for each row, and of the best single arm."""
    direct = F.aggregate(F.zip_with("target", "q", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    fixed = F.greatest(*(F.avg(F.col("q")[k]) for k in range(3)))
    return log(spark, sf_dir).groupBy("event_type").agg(r6(F.avg(direct)).alias("value"), r6(F.avg(F.array_max("q"))).alias("best_per_row"), r6(fixed).alias("best_fixed"))


@query(f"WITH {LOG}, f AS (SELECT event_id, CASE WHEN event_type = 'error' THEN [1.0, 0.0, 0.0]::DOUBLE[] ELSE target END AS probs, q FROM lg) SELECT event_id, round(list_dot_product(probs, q), 6) AS value, list_position(probs, list_max(probs)) - 1 AS greedy FROM f")
def gated_policy(spark, sf_dir):
    """One arm for easy rows, the target policy for the rest."""
    probs = F.when(F.col("event_type") == "error", F.array(*map(F.lit, (1.0, 0.0, 0.0)))).otherwise(F.col("target"))
    g = log(spark, sf_dir).withColumn("probs", probs)
    value = F.aggregate(F.zip_with("probs", "q", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    return g.select("event_id", r6(value).alias("value"), (F.array_position("probs", F.array_max("probs")) - 1).cast("int").alias("greedy"))


_EPISODES = "ep AS (SELECT o_custkey, list(o_totalprice / 1e5 ORDER BY o_orderkey) AS r FROM orders GROUP BY o_custkey)"


def episodes(spark, sf_dir) -> DataFrame:
    """(o_custkey, r): rewards of each customer's orders in turn."""
    o = views.table(spark, sf_dir, "orders")
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", (F.col("o_totalprice") / 1e5).alias("r"))))
    return o.groupBy("o_custkey").agg(rows.alias("rows")).select("o_custkey", F.col("rows.r").alias("r"))


@query(f"WITH {_EPISODES} SELECT o_custkey, CAST(len(r) AS BIGINT) AS n, round(list_reduce(list_reverse(r), lambda a, x: x + 0.9::DOUBLE * a), 6) AS first_return, round(r[-1], 9) AS last_return FROM ep")
def returns_to_go(spark, sf_dir):
    """Discounted returns of each episode."""
    g = po.returns_to_go(F.col("r"), 0.9)
    e = episodes(spark, sf_dir).select("o_custkey", "r", g.alias("g"))
    return e.select("o_custkey", F.size("r").cast("long").alias("n"), r6(F.col("g")[0]).alias("first_return"), F.round(F.element_at("g", -1), 9).alias("last_return"))


@query(f"WITH {_EPISODES}, v AS (SELECT o_custkey, r, list_transform(r, lambda x: x * 0.5::DOUBLE) AS v FROM ep), d AS (SELECT o_custkey, list_transform(range(1, len(r) + 1), lambda k: r[k] + 0.9::DOUBLE * coalesce(v[k + 1], 0) - v[k]) AS d FROM v) SELECT o_custkey, round(list_reduce(list_reverse(d), lambda a, x: x + CAST(0.9 AS DOUBLE) * CAST(0.95 AS DOUBLE) * a), 6) AS first_advantage FROM d")
def gae_advantages(spark, sf_dir):
    """Generalised advantage of each episode's first step."""
    a = po.advantages(F.col("r"), F.transform("r", lambda x: x * 0.5), 0.9, 0.95)
    return episodes(spark, sf_dir).select("o_custkey", r6(a[0]).alias("first_advantage"))


@query()
def ridge_q(spark, sf_dir):
    """Ridge weights of each arm: a linear solve, tested against numpy."""
    arms = po.ridge(po.normal_equations(log(spark, sf_dir), DIM), DIM)
    return arms.select("action", *(r6(F.col("theta")[k]).alias(f"theta{k}") for k in range(DIM)))


@query()
def linucb_scores(spark, sf_dir):
    """Upper confidence scores of each row's arms and the arm they choose: a linear solve, tested against numpy."""
    rows = log(spark, sf_dir)
    arms = po.ridge(po.normal_equations(rows.where("grp % 4 <> 0"), DIM), DIM)
    s = po.linucb(rows.where("grp % 4 = 0"), arms, DIM)
    return s.select("event_id", "arm", r6(F.array_max("scores")).alias("score"))


@query()
def off_policy_evaluate(spark, sf_dir):
    """IPS, SNIPS, effective size and DR with a fitted reward model: a linear solve inside."""
    rows = po.weights(log(spark, sf_dir))
    arms = po.ridge(po.normal_equations(rows, DIM), DIM)
    q = po.predictions(rows.drop("q"), arms)
    return q.groupBy("event_type").agg(*po.estimates(), po.doubly_robust().alias("dr"))


@query()
def bootstrap_ci(spark, sf_dir):
    """95 % interval of the IPS value over groups drawn with replacement: seeded draws, tested against numpy."""
    return po.bootstrap_interval(po.weights(log(spark, sf_dir)), "event_type")


@query(
    """WITH met AS (SELECT l_orderkey, least(count(DISTINCT l_suppkey), 2) AS n_discovered FROM lineitem GROUP BY l_orderkey), c AS (SELECT unnest(['dense', 'hybrid', 'rerank', 'graph']) AS config), s AS (SELECT unnest(['self', 'discovered_0', 'discovered_1', 'fanout']) AS scope)
    SELECT n_discovered, count(DISTINCT l_orderkey) AS n_states, count(*) AS n_actions, count_if(scope = 'self' OR (scope = 'fanout' AND n_discovered > 0) OR (scope LIKE 'discovered_%' AND TRY_CAST(right(scope, 1) AS INT) < n_discovered)) AS n_legal FROM met, c, s GROUP BY n_discovered"""
)
def action_space(spark, sf_dir):
    """Retrieval actions by configuration and scope over the states that orders stand for: up to two of an order's suppliers are discovered, and that many slots are legal."""
    met = views.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.least(F.count_distinct("l_suppkey"), F.lit(2)).alias("n_discovered"))
    states = met.groupBy("n_discovered").agg(F.count(F.lit(1)).alias("n_states"))
    a = states.withColumn("config", F.explode(F.array(*map(F.lit, ("dense", "hybrid", "rerank", "graph"))))).withColumn("scope", F.explode(F.array(*map(F.lit, ("self", "discovered_0", "discovered_1", "fanout")))))
    slot = F.regexp_extract("scope", "discovered_([0-9]+)", 1).try_cast("int")
    legal = (F.col("scope") == "self") | ((F.col("scope") == "fanout") & (F.col("n_discovered") > 0)) | F.coalesce(slot < F.col("n_discovered"), F.lit(False))
    return a.groupBy("n_discovered").agg(F.first("n_states").alias("n_states"), F.sum("n_states").alias("n_actions"), F.sum(F.when(legal, F.col("n_states")).otherwise(0)).alias("n_legal"))
