"""Queries of the retrieval stack: search, fusion, seating, graph, incremental stores, ranking scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import chunking, dedupe
from quern.operators import forecast as fc
from quern.operators import retrieval as rt
from quern.operators.dense import CellIndex, hybrid
from quern.operators.graph import EdgeStore
from quern.operators.inverted import InvertedIndex
from quern.plans.base import query, stored
from quern.sources import views
from quern.sources.payloads import scratch


def r6(x: Column) -> Column:
    return F.round(x, 6)


def docs(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "documents")


def asked(spark, sf_dir) -> DataFrame:
    """(query_id, text): the benchmark's passages as questions."""
    return views.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def index(spark, sf_dir) -> InvertedIndex:
    """The stored index of all documents."""
    kept = lambda: docs(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return stored(spark, sf_dir, "inverted", lambda path: InvertedIndex.create(kept(), path, ("lang", "source")), lambda path: InvertedIndex(spark, path))


def cells(spark, sf_dir) -> CellIndex:
    """The stored index of all vectors."""
    rows = lambda: views.table(spark, sf_dir, "embeddings")
    return stored(spark, sf_dir, "cells", lambda path: CellIndex.create(rows(), path), lambda path: CellIndex(spark, path))


def found(spark, sf_dir, k: int, where: str | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents for each passage, from the stored index."""
    return index(spark, sf_dir).search(asked(spark, sf_dir), k, where)


def bm25_sql(where: str = "true", name: str = "bm") -> str:
    return f"""qtok AS (SELECT query_id, w, count(*) AS qn FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower("text"), '[a-z0-9]+')) AS w FROM benchmark) GROUP BY 1, 2),
  dtok AS (SELECT doc_id, regexp_extract_all(lower(coalesce("text", '')), '[a-z0-9]+') AS x FROM documents WHERE {where}), tot AS (SELECT count(*) AS n_docs, avg(len(x)) AS avgdl FROM dtok),
  tf AS (SELECT doc_id, dl, w, count(*) AS tf FROM (SELECT doc_id, len(x) AS dl, unnest(x) AS w FROM dtok) WHERE w IN (SELECT w FROM qtok) GROUP BY 1, 2, 3), dfs AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
  part AS (SELECT doc_id, w, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS part FROM tf JOIN dfs USING (w), tot),
  bmall AS (SELECT query_id, doc_id, round(sum(qn * part), 9) AS score FROM part JOIN qtok USING (w) GROUP BY 1, 2),
  {name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bmall WHERE score > 0)"""


@query(f"WITH {bm25_sql()} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bm WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    """The ten best documents for each question by BM25."""
    return found(spark, sf_dir, 10).select("query_id", "doc_id", "rank", r6(F.col("score")).alias("score"))


_EN = "lang = 'en'"


@query(f"WITH {bm25_sql(_EN)} SELECT query_id, doc_id, rank, round(score, 6) AS score FROM bm WHERE rank <= 5")
def bm25_topk_filtered(spark, sf_dir):
    """The same over one language: its own counts and lengths, since the filter comes first."""
    return found(spark, sf_dir, 5, _EN).select("query_id", "doc_id", "rank", r6(F.col("score")).alias("score"))


def _vectors(spark, sf_dir):
    """All vectors, and as queries those whose id is divisible by 100."""
    e = views.table(spark, sf_dir, "embeddings")
    return e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


_COS = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])))), 6)"


def cosine_sql(where: str, k: int, name: str = "cs") -> str:
    return f"{name} AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, a.vec_id, {_COS} AS score FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0 AND {where}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {k})"


@query(f"WITH {cosine_sql('true', 5)} SELECT * FROM cs")
def cosine_topk(spark, sf_dir):
    """The five vectors nearest to each whose id is divisible by 100."""
    e, q = _vectors(spark, sf_dir)
    return rt.nearest(e, q, 5).select("query_id", "vec_id", "score", "rank")


@query(f"WITH {cosine_sql('a.label IN (1, 2, 3)', 5)} SELECT * FROM cs")
def cosine_topk_filtered(spark, sf_dir):
    """The same among some labels: the filter comes before the ranking."""
    e, q = _vectors(spark, sf_dir)
    return rt.nearest(e.where("label in (1, 2, 3)"), q, 5).select("query_id", "vec_id", "score", "rank")


@query(
    f"""WITH {bm25_sql()}, hits AS (SELECT b.*, md5(lower(trim(regexp_replace("text", '[ \\t\\n\\r]+', ' ', 'g')))) AS norm FROM bm b JOIN documents USING (doc_id) WHERE rank <= 40),
    kept AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, norm ORDER BY score DESC, doc_id) = 1) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM kept QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10"""
)
def dedupe_by_text_topk(spark, sf_dir):
    """Four times as many hits as wanted, equal texts once, then the best ten."""
    hits = found(spark, sf_dir, 40).drop("rank").join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return rt.distinct_texts(hits, ["query_id"], 10).select("query_id", "doc_id", "rank")


@query(
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN (SELECT max(b."text") FROM benchmark b) || ' ' || coalesce("text", '') ELSE "text" END AS t FROM documents WHERE doc_id % 11 <> 0),
  qtok AS (SELECT query_id, w, count(*) AS qn FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower("text"), '[a-z0-9]+')) AS w FROM benchmark) GROUP BY 1, 2),
  dtok AS (SELECT doc_id, regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9]+') AS x FROM d), tot AS (SELECT count(*) AS n_docs, avg(len(x)) AS avgdl FROM dtok),
  tf AS (SELECT doc_id, dl, w, count(*) AS tf FROM (SELECT doc_id, len(x) AS dl, unnest(x) AS w FROM dtok) WHERE w IN (SELECT w FROM qtok) GROUP BY 1, 2, 3), dfs AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
  part AS (SELECT doc_id, w, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS part FROM tf JOIN dfs USING (w), tot)
  SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(qn * part), 9) AS score FROM part JOIN qtok USING (w) GROUP BY 1, 2) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10"""
)
def index_update_topk(spark, sf_dir):
    """The ten best documents once every seventh was changed and every eleventh removed in the stored index, without a rebuild."""
    d = docs(spark, sf_dir)
    more = views.table(spark, sf_dir, "benchmark").agg(F.max("text").alias("more"))
    changed = d.where("doc_id % 7 = 0 and doc_id % 11 <> 0").crossJoin(F.broadcast(more)).select("doc_id", F.concat_ws(" ", "more", F.coalesce("text", F.lit(""))).alias("text"), "lang", "source")
    path = scratch(spark, "inverted")
    ix = InvertedIndex.create(d.select("doc_id", "text", "lang", "source"), path, ("lang", "source"))
    ix.add(changed)
    ix.remove(d.where("doc_id % 11 = 0").select("doc_id"))
    return ix.search(asked(spark, sf_dir), 10).select("query_id", "doc_id", "rank", r6(F.col("score")).alias("score"))


def lists(spark, sf_dir) -> DataFrame:
    """(query_id, list, rank, id): BM25 over all and over English texts, stored, as those who ask read it several times."""
    a = found(spark, sf_dir, 30).select("query_id", F.lit(0).alias("list"), "rank", F.col("doc_id").alias("id"))
    b = found(spark, sf_dir, 30, _EN).select("query_id", F.lit(1).alias("list"), "rank", F.col("doc_id").alias("id"))
    return dedupe.stored(a.union(b), "lists")


LISTS = f"""{bm25_sql(name='bm1')}, dtok2 AS (SELECT doc_id, x FROM dtok WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')), tot2 AS (SELECT count(*) AS n_docs, avg(len(x)) AS avgdl FROM dtok2), tf2 AS (SELECT * FROM tf WHERE doc_id IN (SELECT doc_id FROM dtok2)), dfs2 AS (SELECT w, count(*) AS df FROM tf2 GROUP BY w),
  part2 AS (SELECT doc_id, w, ln((n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS part FROM tf2 JOIN dfs2 USING (w), tot2),
  bm2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(qn * part), 9) AS score FROM part2 JOIN qtok USING (w) GROUP BY 1, 2) WHERE score > 0),
  lists AS (SELECT query_id, 0 AS list, rank, doc_id AS id FROM bm1 WHERE rank <= 30 UNION ALL SELECT query_id, 1, rank, doc_id FROM bm2 WHERE rank <= 30),
  fused AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lists GROUP BY 1, 2))"""


@query(f"WITH {LISTS} SELECT query_id, id, score, rank FROM fused WHERE rank <= 8")
def rrf_fusion(spark, sf_dir):
    """Two ranked lists fused by reciprocal ranks."""
    return rt.fuse(lists(spark, sf_dir), ["query_id"]).where("rank <= 8").select("query_id", "id", "score", "rank")


@query(f"WITH {LISTS} SELECT f.query_id, f.id, f.rank, d.source, d.lang FROM fused f JOIN documents d ON d.doc_id = f.id WHERE f.rank <= 8")
def rrf_full_outer(spark, sf_dir):
    """The fused list with its documents' metadata."""
    f = rt.fuse(lists(spark, sf_dir), ["query_id"]).where("rank <= 8")
    return f.join(index(spark, sf_dir).documents().select(F.col("doc_id").alias("id"), "source", "lang"), "id").select("query_id", "id", "rank", "source", "lang")


@query(f"WITH {LISTS}, seen AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY rank, list) AS k FROM lists) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank, list) AS seat FROM seen WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, list) <= 15")
def seat_breadth_first(spark, sf_dir):
    """Branches interleaved by rank, each id once."""
    seen = rt.first_seen(lists(spark, sf_dir), ["query_id"], ["id"], F.col("rank"), F.col("list"))
    seen = seen.withColumn("seat", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "list")))
    return seen.where("seat <= 15").select("query_id", "id", "seat")


@query(
    f"""WITH {bm25_sql()}, hits AS (SELECT b.query_id, b.doc_id, b.score, source, row_number() OVER (PARTITION BY b.query_id, source ORDER BY b.score DESC, b.doc_id) AS k, max(b.score) OVER (PARTITION BY b.query_id, source) AS top FROM bm b JOIN documents USING (doc_id) WHERE rank <= 40),
    r AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY top DESC, source) AS branch FROM hits) SELECT query_id, source, doc_id, branch, k FROM r WHERE branch <= 3 AND k <= 3"""
)
def seat_top_branches(spark, sf_dir):
    """The three best sources of each question, three documents each."""
    hits = found(spark, sf_dir, 40).drop("rank").join(index(spark, sf_dir).documents().select("doc_id", "source"), "doc_id")
    w = Window.partitionBy("query_id", "source")
    hits = hits.withColumn("k", F.row_number().over(w.orderBy(F.desc("score"), "doc_id"))).withColumn("top", F.max("score").over(w))
    hits = hits.withColumn("branch", F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("top"), "source")))
    return hits.where("branch <= 3 and k <= 3").select("query_id", "source", "doc_id", "branch", "k")


@query()
def evidence_round_robin(spark, sf_dir):
    """Lists taken in turns, skipping what another list gave: sequential, tested against brute force."""
    q = lists(spark, sf_dir).select("query_id", F.col("list").alias("queue"), F.col("rank").alias("pos"), "id")
    return rt.round_robin(q, ["query_id"], 10)


GRADES = """spans AS (SELECT item_id, [lower(regexp_replace(trim("text"), '[ \\t\\n\\r]+', ' ', 'g'))[1:40], lower(regexp_replace(trim("text"), '[ \\t\\n\\r]+', ' ', 'g'))[-40:]] AS s FROM benchmark), dn AS (SELECT doc_id, lower(regexp_replace(trim("text"), '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM documents WHERE "text" IS NOT NULL),
  grades AS (SELECT item_id AS query_id, doc_id, CAST(contains(t, s[1]) AS INT) + CAST(contains(t, s[2]) AS INT) AS gain FROM dn JOIN spans ON contains(t, s[1]) OR contains(t, s[2]))"""
_DCG = "sum((pow(2, gain) - 1) / log2(rank + 1))"
SCORES = f"""{bm25_sql()}, {GRADES}, flags AS (SELECT b.query_id, b.rank, coalesce(g.gain, 0) AS gain FROM bm b LEFT JOIN grades g USING (query_id, doc_id) WHERE b.rank <= 8),
  got AS (SELECT query_id, max(CAST(gain > 0 AS INT)) AS hit, coalesce(1.0::DOUBLE / min(rank) FILTER (gain > 0), 0) AS mrr, count_if(gain > 0) / count(*) AS precision, count_if(gain > 0) AS hits, {_DCG} AS dcg FROM flags GROUP BY query_id),
  ideal AS (SELECT query_id, {_DCG} AS idcg FROM (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS rank FROM grades) WHERE rank <= 8 GROUP BY query_id), rel AS (SELECT query_id, count(*) AS n FROM grades GROUP BY query_id)"""


def _scores(spark, sf_dir) -> DataFrame:
    bm = dedupe.stored(found(spark, sf_dir, 8), "hits")
    g = chunking.span_grades(docs(spark, sf_dir), views.table(spark, sf_dir, "benchmark"), 40).select(F.col("item_id").alias("query_id"), "doc_id", F.col("grade").alias("gain"))
    flags = bm.join(g, ["query_id", "doc_id"], "left").select("query_id", "rank", F.coalesce("gain", F.lit(0)).alias("gain"))
    return rt.ranking_scores(flags, g.select("query_id", "gain"), "query_id", 8)


@query(f"WITH {SCORES} SELECT query_id, hit, round(mrr, 6) AS mrr, round(precision, 6) AS precision, round(hits / n, 6) AS recall FROM got LEFT JOIN rel USING (query_id)")
def hit_mrr_precision_recall(spark, sf_dir):
    """Ranking scores of the BM25 lists against the passages' own texts."""
    return _scores(spark, sf_dir).select("query_id", "hit", *(r6(F.col(x)).alias(x) for x in ("mrr", "precision", "recall")))


@query(f"WITH {SCORES} SELECT query_id, round(coalesce(dcg / nullif(idcg, 0), 0), 6) AS ndcg FROM got LEFT JOIN ideal USING (query_id)")
def ndcg_at_k(spark, sf_dir):
    """Normalised gain at 8, the ideal over all grades of the corpus."""
    return _scores(spark, sf_dir).select("query_id", r6(F.col("ndcg")).alias("ndcg"))


@query(f"WITH {SCORES} SELECT count(*) AS n_queries, round(avg(hit), 6) AS hit, round(avg(mrr), 6) AS mrr, round(avg(precision), 6) AS precision, round(avg(hits / n), 6) AS recall, round(avg(CASE WHEN n > 0 THEN coalesce(dcg / nullif(idcg, 0), 0) END), 6) AS ndcg FROM got LEFT JOIN rel USING (query_id) LEFT JOIN ideal USING (query_id)")
def evaluate_system(spark, sf_dir):
    """Means over all questions; recall and gain over those that have relevant documents."""
    s = _scores(spark, sf_dir)
    avg = lambda c: r6(F.avg(c))
    return s.agg(F.count(F.lit(1)).alias("n_queries"), *(avg(F.col(x)).alias(x) for x in ("hit", "mrr", "precision", "recall")), avg(F.when(F.col("recall").isNotNull(), F.col("ndcg"))).alias("ndcg"))


@query(f"WITH {GRADES}, a AS (SELECT item_id, item_id % 2 AS side FROM benchmark), cov AS (SELECT DISTINCT query_id FROM grades JOIN documents d USING (doc_id) WHERE d.source IN ('src1', 'src2', 'src3', 'src4', 'src5')) SELECT side AS question, count(*) AS n_aspects, round(count(cov.query_id) / count(*), 6) AS coverage FROM a LEFT JOIN cov ON cov.query_id = a.item_id GROUP BY side")
def aspect_coverage(spark, sf_dir):
    """Share of a question's aspects with a text of its sources that holds one of their spans."""
    p = views.table(spark, sf_dir, "benchmark")
    bound = docs(spark, sf_dir).where("source in ('src1', 'src2', 'src3', 'src4', 'src5')")
    hit = chunking.span_grades(bound, p, 40).select("item_id").distinct().withColumn("hit", F.lit(1))
    return p.select("item_id", (F.col("item_id") % 2).alias("question")).join(hit, "item_id", "left").groupBy("question").agg(F.count(F.lit(1)).alias("n_aspects"), r6(F.count("hit") / F.count(F.lit(1))).alias("coverage"))


def similar_questions(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Questions of the hybrid search: the vectors whose id is divisible by 100, and the whole texts of the documents of these ids."""
    _, q = _vectors(spark, sf_dir)
    texts = docs(spark, sf_dir).where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "text").join(q.select("query_id"), "query_id", "left_semi")
    return q, texts


@query(f"WITH {cosine_sql('true', 10)} SELECT * FROM cs")
def dense_index_topk(spark, sf_dir):
    """The ten nearest vectors from the stored cells: exact, since only cells that cannot hold one are left out."""
    _, q = _vectors(spark, sf_dir)
    return cells(spark, sf_dir).search(q, 10).select("query_id", "vec_id", "score", "rank")


@query(f"WITH {cosine_sql('a.label IN (1, 2, 3)', 10)} SELECT * FROM cs")
def dense_index_filtered(spark, sf_dir):
    """The same among some labels, which are left through before the ranking."""
    _, q = _vectors(spark, sf_dir)
    return cells(spark, sf_dir).search(q, 10, "label in (1, 2, 3)").select("query_id", "vec_id", "score", "rank")


@query()
def dense_probe_recall(spark, sf_dir):
    """Share of each question's ten nearest that three quarters of the cells find; the mean is above 0.9 (tested), and the exact search needs no such share."""
    _, q = _vectors(spark, sf_dir)
    ix = cells(spark, sf_dir)
    some = ix.search(q, 10, probe=-(-ix.cells.count() * 3 // 4)).select("query_id", "vec_id", F.lit(1).alias("hit"))
    exact = ix.search(q, 10).select("query_id", "vec_id")
    return exact.join(some, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


HYBRID = f"""hq AS (SELECT doc_id AS item_id, "text" FROM documents WHERE doc_id % 100 = 0 AND doc_id IN (SELECT vec_id FROM embeddings)), {bm25_sql(name='sp').replace("FROM benchmark", "FROM hq")}, {cosine_sql('true', 30)},
  arms AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.vec_id, s.doc_id) AS id, d.rank AS dense_rank, s.rank AS sparse_rank, round(coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + s.rank), 0), 9) AS score
    FROM cs d FULL OUTER JOIN (SELECT * FROM sp WHERE rank <= 30) s ON s.query_id = d.query_id AND s.doc_id = d.vec_id),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM arms)"""


@query(f"WITH {HYBRID} SELECT r.query_id, r.id, r.score, r.rank, coalesce(r.dense_rank, 0) AS dense_rank, coalesce(r.sparse_rank, 0) AS sparse_rank, d.lang, d.source FROM ranked r JOIN documents d ON d.doc_id = r.id WHERE r.rank <= 10")
def hybrid_topk(spark, sf_dir):
    """Dense and sparse hits fused by reciprocal ranks: the vector and the whole text of a document as the question, both from stored indexes; rank 0: not in that list."""
    q, texts = similar_questions(spark, sf_dir)
    dense = dedupe.stored(cells(spark, sf_dir).search(q, 30).select("query_id", F.col("vec_id").alias("id"), "rank"), "dense")
    ix = index(spark, sf_dir)
    sparse = dedupe.stored(ix.search(texts, 30).select("query_id", F.col("doc_id").alias("id"), "rank"), "sparse")
    store = ix.documents().select(F.col("doc_id").alias("id"), "lang", "source")
    ranks = (F.coalesce(c, F.lit(0)).alias(c) for c in ("dense_rank", "sparse_rank"))
    return hybrid(dense, sparse, store, 10).select("query_id", "id", "score", "rank", *ranks, "lang", "source")


# graph -----------------------------------------------------------------------------------


def edges(spark, sf_dir) -> DataFrame:
    """(subject, relation, object, confidence, provenance): suppliers, nations and regions, and brands that suppliers sell."""
    s, n = views.table(spark, sf_dir, "supplier"), views.table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    prov = lambda *c: F.array(*(x.cast("string") for x in c))
    a = s.select(name("s", k).alias("subject"), F.lit("located_in").alias("relation"), name("n", F.col("s_nationkey")).alias("object"), F.lit(1.0).alias("confidence"), prov(k, k % 7).alias("provenance"))
    b = n.select(name("n", F.col("n_nationkey")), F.lit("part_of"), name("r", F.col("n_regionkey")), F.lit(0.9), prov(F.col("n_nationkey")))
    c = s.select(name("s", k), F.lit("depends_on"), name("s", (k * 7 + 3) % 50), F.round((k % 10) / 10.0, 6), prov(k % 5, k))
    d = s.select(name("s", k), F.lit("competes_with"), name("s", (k * 3 + 1) % 50), F.round((k % 7) / 10.0, 6), prov(k % 3))
    return a.union(b).union(c.where("s_suppkey % 10 >= 1")).union(d)


EDGES = """edges AS (SELECT 's' || s_suppkey AS subject, 'located_in' AS relation, 'n' || s_nationkey AS object, 1.0::DOUBLE AS confidence, [CAST(s_suppkey AS VARCHAR), CAST(s_suppkey % 7 AS VARCHAR)] AS provenance FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey, 0.9, [CAST(n_nationkey AS VARCHAR)] FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'depends_on', 's' || ((s_suppkey * 7 + 3) % 50), round((s_suppkey % 10) / 10.0::DOUBLE, 6), [CAST(s_suppkey % 5 AS VARCHAR), CAST(s_suppkey AS VARCHAR)] FROM supplier WHERE s_suppkey % 10 >= 1
  UNION ALL SELECT 's' || s_suppkey, 'competes_with', 's' || ((s_suppkey * 3 + 1) % 50), round((s_suppkey % 7) / 10.0::DOUBLE, 6), [CAST(s_suppkey % 3 AS VARCHAR)] FROM supplier)"""
WALK = f"""{EDGES}, seeds AS (SELECT 's' || s_suppkey AS seed FROM supplier), h1 AS (SELECT seed, e.* FROM seeds JOIN edges e ON e.subject = seed),
  f2 AS (SELECT DISTINCT seed, object AS node FROM h1 WHERE object <> seed), h2 AS (SELECT f2.seed, e.* FROM f2 JOIN edges e ON e.subject = f2.node),
  walk AS (SELECT seed, subject, relation, object, min(hop) AS hop FROM (SELECT seed, subject, relation, object, 1 AS hop FROM h1 UNION ALL SELECT seed, subject, relation, object, 2 FROM h2) GROUP BY 1, 2, 3, 4)"""


def walk(spark, sf_dir) -> DataFrame:
    seeds = views.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("seed"))
    return rt.neighbours(edges(spark, sf_dir), seeds, 2)


@query(f"WITH {WALK} SELECT * FROM walk")
def graph_bfs_2hop(spark, sf_dir):
    """Edges within two hops of every supplier."""
    return walk(spark, sf_dir)


def walk_sql(hops: int, direction: str, relations: tuple[str, ...] = ()) -> str:
    """CTEs up to ``walk`` (seed, subject, relation, object, hop) of all suppliers, by a recursion over reached nodes."""
    ways = {"out": "SELECT *, subject AS node, object AS other FROM chosen", "in": "SELECT *, object AS node, subject AS other FROM chosen"}
    kept = f"WHERE relation IN ({', '.join(map(repr, relations))})" if relations else ""
    incident = " UNION ALL ".join(w for d, w in ways.items() if direction in (d, "both"))
    return f"""RECURSIVE {EDGES}, chosen AS (SELECT * FROM edges {kept}), incident AS ({incident}), seeds AS (SELECT DISTINCT 's' || s_suppkey AS seed FROM supplier),
  reach AS (SELECT seed, seed AS node, 0 AS lvl FROM seeds UNION SELECT r.seed, i.other, r.lvl + 1 FROM reach r JOIN incident i ON i.node = r.node WHERE r.lvl + 1 < {hops}),
  walk AS (SELECT r.seed, i.subject, i.relation, i.object, min(r.lvl + 1) AS hop FROM reach r JOIN incident i ON i.node = r.node GROUP BY 1, 2, 3, 4)"""


def seeds(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("seed")).distinct()


@query(f"WITH {walk_sql(2, 'in')} SELECT * FROM walk")
def graph_walk_in(spark, sf_dir):
    """Edges that lead to each supplier in one or two steps."""
    return rt.neighbours(edges(spark, sf_dir), seeds(spark, sf_dir), 2, "in")


_DEPENDS = ("depends_on",)


@query(f"WITH {walk_sql(2, 'both', _DEPENDS)} SELECT * FROM walk")
def graph_walk_both(spark, sf_dir):
    """Edges of one relation within two steps of each supplier, in either direction."""
    return rt.neighbours(edges(spark, sf_dir), seeds(spark, sf_dir), 2, "both", _DEPENDS)


_HELD = ("depends_on", "located_in", "part_of")


@query(f"WITH {walk_sql(3, 'out', _HELD)} SELECT * FROM walk")
def graph_walk_3hop(spark, sf_dir):
    """Edges of three relations within three steps of each supplier, outwards."""
    return rt.neighbours(edges(spark, sf_dir), seeds(spark, sf_dir), 3, "out", _HELD)


@query(
    f"""WITH {walk_sql(2, 'both', _DEPENDS)}, p AS (SELECT w.seed, w.subject, w.relation, w.object, e.provenance, unnest(range(1, len(e.provenance) + 1)) AS i FROM walk w JOIN edges e USING (subject, relation, object)),
    ids AS (SELECT seed, provenance[i] AS id, row_number() OVER (PARTITION BY seed ORDER BY subject, relation, object, i) AS pos FROM p) SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY min(pos)) AS place FROM ids GROUP BY seed, id"""
)
def graph_provenance(spark, sf_dir):
    """Distinct provenance ids of the edges within two steps in either direction, in the edges' order."""
    return rt.walk_provenance(edges(spark, sf_dir), seeds(spark, sf_dir), "both", _DEPENDS)


@query(
    f"""WITH {EDGES}, again AS (SELECT subject, relation, object, round(confidence / 2, 6) AS confidence, list_append(provenance, 'again') AS provenance FROM edges WHERE relation = 'depends_on'
  UNION ALL SELECT object, 'supplies', subject, 0.5, ['new'] FROM edges WHERE relation = 'depends_on')
  SELECT coalesce(a.subject, e.subject) AS subject, coalesce(a.relation, e.relation) AS relation, coalesce(a.object, e.object) AS object, coalesce(a.confidence, e.confidence) AS confidence,
    array_to_string(list_filter(coalesce(e.provenance, []) || coalesce(a.provenance, []), lambda x, i: list_position(coalesce(e.provenance, []) || coalesce(a.provenance, []), x) = i), ' ') AS provenance
  FROM (SELECT subject, relation, object, max(confidence) AS confidence, any_value(provenance) AS provenance FROM edges GROUP BY 1, 2, 3) e FULL OUTER JOIN (SELECT subject, relation, object, max(confidence) AS confidence, any_value(provenance) AS provenance FROM again GROUP BY 1, 2, 3) a
    ON a.subject = e.subject AND a.relation = e.relation AND a.object = e.object"""
)
def graph_merge_edges(spark, sf_dir):
    """A stored graph after a second extraction: keyed edges take its confidence, their provenance is united, other edges are added; only folders with changed keys are written."""
    e = edges(spark, sf_dir)
    again = e.where("relation = 'depends_on'").withColumns({"confidence": F.round(F.col("confidence") / 2, 6), "provenance": F.array_append("provenance", "again")})
    reverse = e.where("relation = 'depends_on'").select(F.col("object").alias("subject"), F.lit("supplies").alias("relation"), F.col("subject").alias("object"), F.lit(0.5).alias("confidence"), F.array(F.lit("new")).alias("provenance"))
    store = EdgeStore.create(e, scratch(spark, "edges"))
    store.merge(again.unionByName(reverse))
    return store.edges().withColumn("provenance", F.array_join("provenance", " "))


@query(
    f"""WITH {WALK}, p AS (SELECT w.seed, w.subject, w.relation, w.object, e.provenance, unnest(range(1, len(e.provenance) + 1)) AS i FROM walk w JOIN edges e USING (subject, relation, object) WHERE hop = 1),
    ids AS (SELECT seed, provenance[i] AS id, row_number() OVER (PARTITION BY seed ORDER BY relation, subject, object, i) AS pos FROM p), firsts AS (SELECT seed, id, min(pos) AS pos FROM ids GROUP BY seed, id) SELECT seed, id, row_number() OVER (PARTITION BY seed ORDER BY pos) AS place FROM firsts"""
)
def provenance_first_seen(spark, sf_dir):
    """Distinct provenance ids of a seed's edges, in the edges' order."""
    e = edges(spark, sf_dir).select("subject", "relation", "object", "provenance")
    p = walk(spark, sf_dir).where("hop = 1").join(e, ["subject", "relation", "object"]).select("seed", "relation", "subject", "object", F.posexplode("provenance").alias("i", "id"))
    pos = F.row_number().over(Window.partitionBy("seed").orderBy("relation", "subject", "object", "i"))
    firsts = p.withColumn("pos", pos).groupBy("seed", "id").agg(F.min("pos").alias("pos"))
    return firsts.select("seed", "id", F.row_number().over(Window.partitionBy("seed").orderBy("pos")).alias("place"))


@query()
def neighbor_round_robin(spark, sf_dir):
    """Five neighbours of each seed, taken in turns from its relations by confidence: sequential, tested against brute force."""
    priority = F.when(F.col("relation") == "depends_on", 0).when(F.col("relation") == "competes_with", 1).otherwise(2)
    e = edges(spark, sf_dir)
    w = walk(spark, sf_dir).where("hop = 1 and object like 's%' and object <> seed").join(e.select("subject", "relation", "object", "confidence"), ["subject", "relation", "object"])
    top = w.groupBy("seed", priority.alias("queue"), F.col("object").alias("id")).agg(F.max("confidence").alias("c"))
    q = top.withColumn("pos", F.row_number().over(Window.partitionBy("seed", "queue").orderBy(F.desc("c"), "id"))).drop("c")
    return rt.round_robin(q, ["seed"], 5)


@query(f"WITH {EDGES}, t AS (SELECT e.subject, e.object, e.relation, CASE WHEN g.relation IS NULL THEN 'discard' WHEN h.relation IS NULL THEN 'HARD' ELSE 'MED' END AS stratum FROM edges e LEFT JOIN (SELECT DISTINCT subject, relation FROM edges WHERE relation = 'competes_with') g ON g.subject = e.object LEFT JOIN (SELECT DISTINCT subject, relation FROM edges WHERE relation = 'depends_on' AND confidence >= 0.5) h ON h.subject = e.subject WHERE e.relation = 'depends_on') SELECT relation, stratum, count(*) AS n FROM t GROUP BY relation, stratum")
def multihop_stratum(spark, sf_dir):
    """Bridge edges by whether their target and their seed can answer: discard, HARD or MED."""
    e = edges(spark, sf_dir)
    target = e.where("relation = 'competes_with'").select(F.col("subject").alias("object")).distinct().withColumn("t", F.lit(1))
    seed = e.where("relation = 'depends_on' and confidence >= 0.5").select("subject").distinct().withColumn("s", F.lit(1))
    b = e.where("relation = 'depends_on'").join(target, "object", "left").join(seed, "subject", "left")
    stratum = F.when(F.col("t").isNull(), "discard").when(F.col("s").isNull(), "HARD").otherwise("MED")
    return b.groupBy("relation", stratum.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


# stores ----------------------------------------------------------------------------------


@query("SELECT doc_id, 'new' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def anti_incremental_ingest(spark, sf_dir):
    """Rows that a store does not hold yet."""
    d = docs(spark, sf_dir).select("doc_id")
    return d.join(d.where("doc_id % 3 = 0"), "doc_id", "left_anti").withColumn("state", F.lit("new"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE label = 3)")
def semi_fetch_ids(spark, sf_dir):
    """Rows of the ids asked for."""
    ids = views.table(spark, sf_dir, "embeddings").where("label = 3").select(F.col("vec_id").alias("doc_id"))
    return docs(spark, sf_dir).select("doc_id", "source").join(ids, "doc_id", "left_semi")


@query("SELECT user_id, event_type, value, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def upsert_latest_wins(spark, sf_dir):
    """The last write of each primary key."""
    e = views.table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("seq"))


@query(f"WITH {LISTS}, u AS (SELECT query_id, id, min(list * 100 + rank) AS pos FROM lists GROUP BY query_id, id) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place FROM u")
def ordered_union_distinct(spark, sf_dir):
    """Lists one after another, each id at its first place."""
    u = lists(spark, sf_dir).groupBy("query_id", "id").agg(F.min(F.col("list") * 100 + F.col("rank")).alias("pos"))
    return u.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).alias("place"))


@query("WITH g AS (SELECT source, row_number() OVER (ORDER BY md5(source)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)) SELECT doc_id, CASE WHEN k <= round_even(n * 0.3, 0) THEN 'test' ELSE 'train' END AS side FROM documents JOIN g USING (source)")
def group_split_disjoint(spark, sf_dir):
    """Whole sources to test or train by a hash order; 30 % of them to test."""
    d = docs(spark, sf_dir).select("doc_id", "source").where("source is not null")
    g = d.select("source").distinct()
    g = g.select("source", F.row_number().over(Window.orderBy(F.md5("source"))).alias("k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    return d.join(g, "source").select("doc_id", F.when(F.col("k") <= F.bround(F.col("n") * 0.3), "test").otherwise("train").alias("side"))


@query(
    """WITH asked AS (SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS horizon FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    n AS (SELECT horizon, count(*) AS n FROM asked GROUP BY horizon) SELECT CAST(horizon AS BIGINT) AS horizon, CASE WHEN abs(horizon - 20) <= abs(horizon - 30) THEN 20 WHEN abs(horizon - 30) <= abs(horizon - 60) THEN 30 ELSE 60 END AS band, n FROM n"""
)
def nearest_horizon(spark, sf_dir):
    """Days from order to shipping as asked horizons, and the configured band nearest to each; ties go to the shorter."""
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    asked = views.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate").join(o, "l_orderkey").groupBy(F.datediff("l_shipdate", "o_orderdate").cast("long").alias("horizon")).agg(F.count(F.lit(1)).alias("n"))
    bands = F.array_sort(F.array(*(F.struct(F.abs(F.col("horizon") - b).alias("apart"), F.lit(b).alias("band")) for b in fc.BANDS)))
    return asked.select("horizon", bands[0]["band"].alias("band"), "n")
