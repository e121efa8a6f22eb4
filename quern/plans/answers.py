"""Queries of answers and what they rest on: cited evidence, pooled seating, sections and their chunks, policies that choose an arm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import chunking, dedupe
from quern.operators import policy as po
from quern.operators import retrieval as rt
from quern.plans import policy, retrieval
from quern.plans.base import query
from quern.sources import views


def r6(x):
    return F.round(x, 6)


def citation_accuracy(cited: DataFrame, union: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, n_cited, accuracy): share of an answer's ``cited`` rows (query_id, id) that are in its evidence ``union`` and ``relevant`` (both query_id, id).

    Citations that the evidence does not hold count against it; an answer that cites nothing has no row.  Repeated citations count each.
    """
    keys = ["query_id", "id"]
    good = union.select(*keys).distinct().join(relevant.select(*keys).distinct(), keys, "left_semi").withColumn("good", F.lit(1))
    return cited.select(*keys).join(good, keys, "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n_cited"), (F.count("good") / F.count(F.lit(1))).alias("accuracy"))


@query(
    f"""WITH {retrieval.bm25_sql()}, {retrieval.GRADES}, u AS (SELECT query_id, doc_id FROM bm WHERE rank <= 8), cited AS (SELECT query_id, doc_id FROM bm WHERE rank <= 5 AND query_id % 7 <> 0 UNION ALL SELECT item_id, -1 FROM benchmark WHERE item_id % 7 <> 0),
    good AS (SELECT g.query_id, g.doc_id FROM grades g JOIN documents d USING (doc_id) WHERE g.query_id % 2 = 0 OR d.source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9'))
    SELECT c.query_id, count(*) AS n_cited, round(avg(CASE WHEN g.doc_id IS NOT NULL AND u.doc_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM cited c LEFT JOIN u ON u.query_id = c.query_id AND u.doc_id = c.doc_id LEFT JOIN good g ON g.query_id = c.query_id AND g.doc_id = c.doc_id GROUP BY c.query_id"""
)
def multihop_citation_accuracy(spark, sf_dir):
    """Answers that cite their five best documents and one that is not in the evidence: the share that holds a span of an aspect, from the sources it is bound to."""
    hits = dedupe.stored(retrieval.found(spark, sf_dir, 8).select("query_id", F.col("doc_id").alias("id"), "rank"), "hits")
    asked = retrieval.asked(spark, sf_dir).where("query_id % 7 <> 0")
    cited = hits.where("rank <= 5 and query_id % 7 <> 0").select("query_id", "id").unionByName(asked.select("query_id", F.lit(-1).cast("long").alias("id")))
    grades = chunking.span_grades(retrieval.docs(spark, sf_dir), views.table(spark, sf_dir, "benchmark"), 40)
    sources = retrieval.index(spark, sf_dir).documents().select("doc_id", "source")
    bound = (F.col("item_id") % 2 == 0) | F.col("source").isin(*(f"src{k}" for k in range(1, 10)))
    relevant = grades.join(sources, "doc_id").where(bound).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("id"))
    return citation_accuracy(cited, hits, relevant).select("query_id", "n_cited", r6(F.col("accuracy")).alias("accuracy"))


_SHARE = "len(list_intersect(qs.x, ds.x)) / len(qs.x)"


@query(
    f"""WITH {retrieval.LISTS}, ds AS (SELECT doc_id, list_distinct(x) AS x FROM dtok), qs AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower("text"), '[a-z0-9]+')) AS x FROM benchmark),
    pool AS (SELECT query_id, id, min(list * 100 + rank) AS was FROM lists GROUP BY query_id, id), r AS (SELECT p.query_id, p.id, p.was, round({_SHARE}, 6) AS score FROM pool p JOIN ds ON ds.doc_id = p.id JOIN qs USING (query_id))
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS seat FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) <= 15"""
)
def seat_pooled_rerank(spark, sf_dir):
    """All branches' rows in one pool, each id once, scored anew by the share of the question's words they hold: the best fifteen, whatever branch they come from."""
    pool = retrieval.lists(spark, sf_dir).groupBy("query_id", "id").agg(F.min(F.col("list") * 100 + F.col("rank")).alias("was"))
    words = lambda df, k: df.select(F.col(k), F.array_distinct(tx.tokens(F.col("text"))).alias(f"{k}_x"))
    named = retrieval.docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text").join(pool.select("id").distinct(), "id", "left_semi")
    d = words(named, "id")  # of the pool's texts alone
    p = pool.join(d, "id").join(words(retrieval.asked(spark, sf_dir), "query_id"), "query_id")
    p = p.withColumn("score", r6(F.size(F.array_intersect("query_id_x", "id_x")) / F.size("query_id_x")))
    return rt.best(p, ["query_id"], 15, F.desc("score"), F.col("was")).select("query_id", "id", "score", F.col("rank").alias("seat"))


_W = "'[^ \\t\\n\\r\\f\\x0B]+'"


@query(
    f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Item 7.' ELSE 'Item 1A. Risk Factors' END AS label, regexp_extract_all(CASE WHEN doc_id % 3 = 0 THEN 'Item 7.' ELSE 'Item 1A. Risk Factors' END || chr(10) || "text", {_W}) AS w FROM documents WHERE "text" IS NOT NULL),
    kept AS (SELECT * FROM d WHERE len(w) >= 15 AND NOT (doc_id % 3 = 0 AND len(w) < 25)), c AS (SELECT doc_id, label, w, unnest(range(0, CAST(greatest(0, ceil((len(w) - 675) / 574.0)) AS BIGINT) + 1)) AS k FROM kept)
    SELECT doc_id, k AS chunk_index, label AS section, CAST(len(w[k * 574 + 1 : k * 574 + 675]) AS BIGINT) AS n_words, md5(array_to_string(w[k * 574 + 1 : k * 574 + 675], ' ')) AS digest FROM c"""
)
def section_chunk_windows(spark, sf_dir):
    """Windows of documents under item headers; a section that is a stub, or short under a bare header, gives none."""
    label = F.when(F.col("doc_id") % 3 == 0, "Item 7.").otherwise("Item 1A. Risk Factors")
    d = retrieval.docs(spark, sf_dir).select("doc_id", F.concat(label, F.lit("\n"), "text", F.lit("\nItem 9B.\nNone.")).alias("text"))
    c = chunking.section_chunks(d)
    return c.select("doc_id", "chunk_index", "section", "n_words", F.md5("text").alias("digest"))


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 2 AND lang IN ('en', 'de')")
def section_filter(spark, sf_dir):
    """Chunks of annual reports in the sections asked for, by item code; other forms with equal codes are left out."""
    section = F.when(F.col("lang") == "en", "ITEM 1 - Business").when(F.col("lang") == "de", "Item 1A. Risks").when(F.col("lang") == "fr", "Item 1.01 Entry").otherwise("Item 7.")
    d = retrieval.docs(spark, sf_dir).select("doc_id", "lang", section.alias("section"), F.when(F.col("doc_id") % 3 == 2, "10-Q").otherwise("10-K").alias("form"))
    return chunking.of_sections(d, ["Item 1. Business", "Item 1A. Risk Factors"]).select("doc_id", "lang")


_POLICIES = {"uniform": "[1/3.0::DOUBLE, 1/3.0::DOUBLE, 1/3.0::DOUBLE]", "fixed(0)": "[1.0::DOUBLE, 0, 0]", "fixed(2)": "[0.0::DOUBLE, 0, 1]", "epsilon": "list_transform([1, 2, 3], lambda k: 0.1::DOUBLE / 3 + CASE WHEN k = list_position(q, list_max(q)) THEN 0.9::DOUBLE ELSE 0 END)"}


@query(
    f"""WITH {policy.LOG}, p AS ({' UNION ALL '.join(f"SELECT '{n}' AS policy, {x}[action + 1] / propensity AS w, reward FROM lg" for n, x in _POLICIES.items())})
    SELECT policy, count(*) AS n, round(avg(w * reward), 6) AS ips, round(sum(w * reward) / sum(w), 6) AS snips, round(sum(w) * sum(w) / sum(w * w), 6) AS ess FROM p GROUP BY policy"""
)
def policy_values(spark, sf_dir):
    """Value of fixed, uniform and epsilon-greedy policies from one log, by importance sampling."""
    rows = policy.log(spark, sf_dir)
    targets = {"uniform": po.uniform(3), "fixed(0)": po.fixed(0, 3), "fixed(2)": po.fixed(2, 3), "epsilon": po.epsilon_greedy(F.col("q"), 0.1)}
    each = F.array(*(F.struct(F.lit(n).alias("policy"), t.alias("target")) for n, t in targets.items()))
    long = rows.select("action", "propensity", "reward", F.inline(each))
    g = po.weights(long).groupBy("policy").agg(F.count(F.lit(1)).alias("n"), *po.estimates())
    return g.select("policy", "n", *(r6(F.col(x)).alias(x) for x in ("ips", "snips", "ess")))
