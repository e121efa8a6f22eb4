"""Queries of gates, stores, rerankers and paired comparisons."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import dedupe, vectors
from quern.operators import forecast as fc
from quern.operators import retrieval as rt
from quern.plans import policy, retrieval
from quern.plans.base import query
from quern.sources import views
from quern.sources.views import BARS


def r6(x: Column) -> Column:
    return F.round(x, 6)


@query("SELECT o_orderkey, substring(sha256('{\"end\":\"' || strftime(o_orderdate, '%Y-%m-%d') || '\",\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}'), 1, 32) AS key FROM orders")
def cache_key(spark, sf_dir):
    """Cache keys: the digest of a call's parts as JSON in order of name."""
    parts = F.to_json(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("end"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", F.substring(F.sha2(parts, 256), 1, 32).alias("key"))


_GRID = "(VALUES ('boosted'), ('logistic'), ('garch')) m(model), (VALUES (20), (30), (60)) h(horizon)"


@query(
    f"""WITH art AS (SELECT CASE o_custkey % 3 WHEN 0 THEN 'boosted' WHEN 1 THEN 'logistic' ELSE 'other' END AS model, CASE o_custkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 30 ELSE 60 END AS horizon, count(*) AS n_rows, avg(o_totalprice) / 5e5 AS coverage FROM orders GROUP BY 1, 2),
    g AS (SELECT model, horizon FROM {_GRID}), j AS (SELECT g.*, n_rows, coverage FROM g LEFT JOIN art USING (model, horizon))
    SELECT model, CAST(horizon AS BIGINT) AS horizon, CASE WHEN n_rows IS NULL THEN 'missing' WHEN n_rows < 100 THEN 'few rows' ELSE 'low coverage' END AS problem FROM j WHERE n_rows IS NULL OR n_rows < 100 OR coverage < 0.85"""
)
def artifact_gate(spark, sf_dir):
    """Problems of stored models: expected (model, horizon) cells that are missing, thin or cover too little."""
    o, c = views.table(spark, sf_dir, "orders"), F.col("o_custkey")
    model = F.when(c % 3 == 0, "boosted").when(c % 3 == 1, "logistic").otherwise("other")
    horizon = F.when(c % 4 == 0, 20).when(c % 4 == 1, 30).otherwise(60).cast("long")
    have = o.groupBy(model.alias("model"), horizon.alias("horizon")).agg(F.count(F.lit(1)).alias("n"), (F.avg("o_totalprice") / 5e5).alias("coverage"))
    grid = spark.createDataFrame([(m, h) for m in ("boosted", "logistic", "garch") for h in (20, 30, 60)], "model string, horizon long")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("n") < 100, "few rows").when(F.col("coverage") < 0.85, "low coverage")
    return grid.join(have, ["model", "horizon"], "left").select("model", "horizon", problem.alias("problem")).where("problem is not null")


@query(
    f"""WITH {BARS}, n AS (SELECT sym, count(*) AS n FROM bars GROUP BY sym), k AS (SELECT sym, n, unnest(range(0, 500)) AS fold FROM n), f AS (SELECT sym, fold, 65 + fold * 30 AS s, n FROM k WHERE 65 + fold * 30 <= n - 6),
    e AS (SELECT sym, fold, s - 6 AS train_end, s, s + 5 * (least(6, (n - 6 - s) // 5 + 1) - 1) AS t FROM f), c AS (SELECT *, lag(t) OVER (PARTITION BY sym ORDER BY fold) AS before FROM e)
    SELECT sym, count(*) AS n_folds, count_if(train_end + 5 >= s) AS leaking, count_if(before >= s) AS overlapping FROM c GROUP BY sym"""
)
def fold_leakage(spark, sf_dir):
    """Folds whose training reaches into their test's horizon, or whose tests overlap: none should."""
    n = views.bars(spark, sf_dir).groupBy("sym").agg(F.count(F.lit(1)).alias("n"))
    f = fc.walk_forward(n, horizon=5, min_train=60, test_size=6).withColumn("before", F.lag("test_end").over(Window.partitionBy("sym").orderBy("fold")))
    return f.groupBy("sym").agg(F.count(F.lit(1)).alias("n_folds"), F.count_if(F.col("train_end") + 5 >= F.col("test_start")).alias("leaking"), F.count_if(F.col("before") >= F.col("test_start")).alias("overlapping"))


_OVERLAP = "len(list_intersect(qs.x, ds.x)) / len(qs.x)"


@query(
    f"""WITH {retrieval.bm25_sql()}, ds AS (SELECT doc_id, list_distinct(x) AS x FROM dtok), qs AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower("text"), '[a-z0-9]+')) AS x FROM benchmark),
    r AS (SELECT b.query_id, b.doc_id, round({_OVERLAP}, 6) AS score, b.rank AS was FROM bm b JOIN ds USING (doc_id) JOIN qs USING (query_id) WHERE b.rank <= 40)
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) <= 8"""
)
def rerank_two_stage(spark, sf_dir):
    """Forty BM25 hits rescored by the share of the question's words they hold, then the best eight."""
    d, q = retrieval.docs(spark, sf_dir), retrieval.asked(spark, sf_dir)
    words = lambda df, k: df.select(k, F.array_distinct(tx.tokens(F.col("text"))).alias(f"{k}_x"))
    hits = retrieval.found(spark, sf_dir, 40).withColumnRenamed("rank", "was").drop("score").join(words(d, "doc_id"), "doc_id").join(words(q, "query_id"), "query_id")
    hits = hits.withColumn("score", r6(F.size(F.array_intersect("query_id_x", "doc_id_x")) / F.size("query_id_x")))
    return rt.best(hits, ["query_id"], 8, F.desc("score"), F.col("was")).select("query_id", "doc_id", "score", "rank")


@query(
    f"""WITH {retrieval.LISTS}, best AS (SELECT query_id, source, max(f.score) AS s FROM fused f JOIN documents d ON d.doc_id = f.id GROUP BY 1, 2), a AS (SELECT query_id, source, s FROM best WHERE source NOT IN ('src0', 'src1'))
    SELECT query_id, source, s AS score FROM a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, source) <= 2"""
)
def bridge_candidates(spark, sf_dir):
    """Sources met in a question's evidence and not searched yet, the two best by their best row."""
    f = rt.fuse(retrieval.lists(spark, sf_dir), ["query_id"]).join(retrieval.docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source"), "id")
    met = f.groupBy("query_id", "source").agg(F.max("score").alias("score"))
    searched = spark.createDataFrame([("src0",), ("src1",)], "source string")
    left = met.join(F.broadcast(searched), "source", "left_anti")
    return rt.best(left, ["query_id"], 2, F.desc("score"), F.col("source")).select("query_id", "source", "score")


@query("""WITH t AS (SELECT conv_id, max(turn) AS turns, DATE '2024-01-01' + CAST(conv_id % 120 AS INT) AS updated FROM conversations GROUP BY conv_id) SELECT conv_id, turns + 1 AS n_turns, updated, row_number() OVER (ORDER BY updated DESC, conv_id) AS place FROM t WHERE updated >= DATE '2024-03-01' QUALIFY row_number() OVER (ORDER BY updated DESC, conv_id) <= 20""")
def thread_store(spark, sf_dir):
    """Threads kept by their retention, the newest twenty first."""
    t = views.table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("n_turns"))
    t = t.withColumn("updated", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 120).cast("int"))).where("updated >= date '2024-03-01'")
    top = t.orderBy(F.desc("updated"), "conv_id").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("updated"), "conv_id"))).select("conv_id", "n_turns", "updated", "place")


@query("""WITH r AS (SELECT event_id % 10 AS want, CASE WHEN event_id % 13 = 0 THEN -1 WHEN event_id % 7 = 0 THEN (event_id + 1) % 10 ELSE event_id % 10 END AS got, event_type FROM events)
SELECT event_type, count(*) AS n, round(count_if(got = want) / count(*), 6) AS accuracy, count_if(got <> want AND got <> -1) AS misrouted, count_if(got = -1) AS escalated, count_if(got = -1 AND want < 5) AS over_escalated FROM r GROUP BY event_type""")
def routing_eval(spark, sf_dir):
    """Accuracy, misroutes and escalations of a router's answers; -1 escalates."""
    i = F.col("event_id")
    got = F.when(i % 13 == 0, -1).when(i % 7 == 0, (i + 1) % 10).otherwise(i % 10)
    r = views.table(spark, sf_dir, "events").select("event_type", (i % 10).alias("want"), got.alias("got"))
    g, w = F.col("got"), F.col("want")
    return r.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.count_if(g == w) / F.count(F.lit(1))).alias("accuracy"), F.count_if((g != w) & (g != -1)).alias("misrouted"), F.count_if(g == -1).alias("escalated"), F.count_if((g == -1) & (w < 5)).alias("over_escalated"))


@query(f"""WITH {policy.LOG}, p AS (SELECT grp, CASE WHEN event_type IN ('error', 'view') THEN 'CTRL' ELSE 'HARD' END AS stratum, w * reward AS a, CASE WHEN action = 0 THEN reward / propensity ELSE 0 END AS b FROM wl), s AS (SELECT stratum, avg(a) - avg(b) AS delta FROM p GROUP BY stratum)
SELECT round((SELECT avg(a) - avg(b) FROM p), 6) AS delta, round(max(delta) FILTER (stratum = 'CTRL'), 6) AS ctrl, round(max(delta) FILTER (stratum = 'HARD'), 6) AS hard, (SELECT avg(a) - avg(b) FROM p) > 0 AND max(delta) FILTER (stratum = 'CTRL') >= 0 AS promote FROM s""")
def paired_delta(spark, sf_dir):
    """A policy's value less the first arm's, over all rows and by stratum, and whether it may be promoted."""
    from quern.operators import policy as po

    log = po.weights(policy.log(spark, sf_dir))
    hard = ~F.col("event_type").isin("error", "view")
    d = F.col("w") * F.col("reward") - F.when(F.col("action") == 0, F.col("reward") / F.col("propensity")).otherwise(0.0)
    s = log.agg(F.avg(d).alias("delta"), F.avg(F.when(~hard, d)).alias("ctrl"), F.avg(F.when(hard, d)).alias("hard"))
    return s.select(r6(F.col("delta")).alias("delta"), r6(F.col("ctrl")).alias("ctrl"), r6(F.col("hard")).alias("hard"), ((F.col("delta") > 0) & (F.col("ctrl") >= 0)).alias("promote"))


@query("""WITH t AS (SELECT 's' || s_suppkey AS name, [lower(s_name), 's' || (s_suppkey % 20)] AS aliases FROM supplier), u AS (SELECT name, unnest(aliases) AS alias FROM t), c AS (SELECT alias, count(*) AS n, min(name) AS name FROM u GROUP BY alias) SELECT p_partkey, CASE WHEN c.n = 1 THEN c.name END AS company FROM (SELECT p_partkey, 's' || (p_partkey % 40) AS said FROM part) p LEFT JOIN c ON c.alias = p.said""")
def resolve_company(spark, sf_dir):
    """Names resolved by aliases that one company alone has."""
    s = views.table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    alias = s.select(F.concat(F.lit("s"), k.cast("string")).alias("name"), F.explode(F.array(F.lower("s_name"), F.concat(F.lit("s"), (k % 20).cast("string")))).alias("alias"))
    known = alias.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    said = views.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("s"), (F.col("p_partkey") % 40).cast("string")).alias("alias"))
    return said.join(known, "alias", "left").select("p_partkey", F.when(F.col("n") == 1, F.col("name")).alias("company"))


@query("""WITH m AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, avg(n_chars) AS x FROM documents GROUP BY source) SELECT source, 'mean,n' AS names, CASE WHEN n > 45 THEN round(x, 3) END AS mean, n, CAST(1 + CAST(n > 45 AND x IS NOT NULL AS INT) AS BIGINT) AS n_known FROM m WHERE n > 45 AND x IS NOT NULL
UNION ALL SELECT source, 'n', NULL, n, 1 FROM m WHERE NOT (n > 45 AND x IS NOT NULL)""")
def numeric_map(spark, sf_dir):
    """A row's known numbers as a map: its names, its values, how many."""
    m = views.table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("n_chars").alias("x"))
    known = F.map_filter(F.create_map(F.lit("n"), F.col("n"), F.lit("mean"), F.when(F.col("n") > 45, F.round("x", 3))), lambda _, v: v.isNotNull())
    value = lambda k: F.try_element_at(known, F.lit(k)).alias(k)
    return m.select("source", F.array_join(F.array_sort(F.map_keys(known)), ",").alias("names"), value("mean"), value("n"), F.size(known).cast("long").alias("n_known"))


@query()
def cosine_lsh(spark, sf_dir):
    """Approximate nearest vectors by bucketed random projections; its recall against the exact list is tested."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    # a pair that shares a bucket is looked at where it passes by: buckets are wide, so a join on them would hold most pairs six times
    rows, asked = retrieval._vectors(spark, sf_dir)
    dim = rows.agg(F.mode(F.size("embedding"))).first()[0]
    e = rows.where(vectors.plain(F.col("embedding"), dim)).select("vec_id", "embedding", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.5, numHashTables=6, seed=42).fit(e)
    e = model.transform(e).select("vec_id", "embedding", F.transform("h", lambda x: vector_to_array(x)[0]).alias("h"))
    near = None
    for told in vectors.blocks(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "h")):
        block = vectors.near(e, told, dim, 5, within=0.8)
        near = block if near is None else near.unionByName(block)
    found = dedupe.stored(rt.best(near, ["query_id"], 5, F.desc("score"), F.col("vec_id")), "near")
    full = found.where("rank = 5").select("query_id")
    # queries with fewer hits than wanted are answered exactly
    return found.join(full, "query_id", "left_semi").unionByName(rt.nearest(rows, asked.join(full, "query_id", "left_anti"), 5).select(found.columns))
