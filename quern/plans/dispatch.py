"""Queries of requests, scoped questions, evidence states, paired runs and logged policies."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.windows import symbol
from quern.operators import dedupe
from quern.operators import evaluation as ev
from quern.operators import requests as rq
from quern.operators import retrieval as rt
from quern.plans import retrieval
from quern.plans.base import query
from quern.sources import views
from quern.sources.views import BARS


def r6(x: Column) -> Column:
    return F.round(x, 6)


@query("""WITH r AS (SELECT event_id, list_filter(list_transform(string_split('t' || (user_id % 7) || ', T' || (event_id % 7) || ',,' || event_type || ', ' || (event_id % 11) || ',x' || (user_id % 5) || ',' || event_type || ',b' || (event_id % 3) || ',c', ','), lambda x: upper(trim(x))), lambda x: x <> '') AS x FROM events),
d AS (SELECT event_id, list_filter(x, lambda v, i: list_position(x, v) = i) AS x FROM r) SELECT event_id, array_to_string(x[1:6], ',') AS kept, array_to_string(x[7:], ',') AS skipped FROM d""")
def symbol_lists(spark, sf_dir):
    """Requested symbols, cleaned, each once, and those beyond the cap."""
    u, i, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
    text = lambda c: c.cast("string")
    raw = F.concat(F.lit("t"), text(u % 7), F.lit(", T"), text(i % 7), F.lit(",,"), kind, F.lit(", "), text(i % 11), F.lit(",x"), text(u % 5), F.lit(","), kind, F.lit(",b"), text(i % 3), F.lit(",c"))
    e = views.table(spark, sf_dir, "events").select("event_id", rq.symbol_list(raw).alias("x"))
    return e.select("event_id", F.array_join(F.slice("x", 1, rq.MOST_SYMBOLS), ",").alias("kept"), F.array_join(F.slice("x", rq.MOST_SYMBOLS + 1, 1000), ",").alias("skipped"))


@query("SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || strftime(o_orderdate, '%y') || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') || '/doc' || o_orderkey || '.htm' AS url FROM orders")
def filing_urls(spark, sf_dir):
    """A filing's address: its company's number without zeros, its own without hyphens."""
    cik, key = F.col("cik"), F.col("o_orderkey").cast("string")
    o = views.table(spark, sf_dir, "orders").withColumn("cik", F.lpad(F.col("o_custkey").cast("string"), 10, "0"))
    own = F.concat_ws("-", cik, F.date_format("o_orderdate", "yy"), F.lpad(key, 6, "0"))
    return o.select("o_orderkey", F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("long").cast("string"), F.lit("/"), F.replace(own, F.lit("-"), F.lit("")), F.lit("/doc"), key, F.lit(".htm")).alias("url"))


@query("""WITH t AS (SELECT p_partkey, list_concat(CASE WHEN p_size % 5 = 0 THEN [p_name] ELSE [p_name, lower(p_type), lower(p_brand)] END, CASE WHEN p_size % 2 = 0 THEN ['theme:SIZE_' || p_size] ELSE [] END) AS x FROM part),
q AS (SELECT p_partkey, len(x) AS n, array_to_string(list_transform(x, lambda v: CASE WHEN contains(v, ' ') THEN '"' || v || '"' ELSE v END), ' OR ') AS e FROM t)
SELECT p_partkey, CASE WHEN n > 1 THEN '(' || e || ')' ELSE e END AS expression FROM q""")
def topic_expressions(spark, sf_dir):
    """Keywords and themes of a topic as one search expression."""
    size = F.col("p_size")
    words = F.when(size % 5 == 0, F.array("p_name")).otherwise(F.array("p_name", F.lower("p_type"), F.lower("p_brand")))
    themes = F.when(size % 2 == 0, F.array(F.concat(F.lit("theme:SIZE_"), size.cast("string")))).otherwise(F.array().cast("array<string>"))
    return views.table(spark, sf_dir, "part").select("p_partkey", rq.any_of(F.concat(words, themes)).alias("expression"))


@query(r"""WITH a AS (SELECT DISTINCT s_nationkey, lower(unnest(['A.' || (s_suppkey % 10), 'Co (' || (s_suppkey % 7) || ')', 'plus+' || (s_suppkey % 3)])) AS a FROM supplier)
SELECT s_nationkey, '\b(' || string_agg(regexp_replace(a, '([\\.^$*+?()\[\]{}|])', '\\\1', 'g'), '|' ORDER BY length(a) DESC, a) || ')\b' AS pattern FROM a GROUP BY s_nationkey""")
def alias_patterns(spark, sf_dir):
    """One pattern for all names of a nation's suppliers, the longest first."""
    k = lambda n: (F.col("s_suppkey") % n).cast("string")
    names = F.explode(F.array(F.concat(F.lit("A."), k(10)), F.concat(F.lit("Co ("), k(7), F.lit(")")), F.concat(F.lit("plus+"), k(3))))
    n = views.table(spark, sf_dir, "supplier").select("s_nationkey", names.alias("a")).groupBy("s_nationkey").agg(F.collect_set("a").alias("names"))
    return n.select("s_nationkey", rq.alias_pattern(F.col("names")).alias("pattern"))


@query(r"""WITH l AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Item ' || (user_id % 16) || '. Business' WHEN 1 THEN 'ITEM  1' || chr(CAST(65 + user_id % 3 AS INT)) || '. Risk Factors' WHEN 2 THEN 'Item ' || (user_id % 9) || '.0' || (event_id % 3) || ' Other' ELSE event_type END AS label FROM events),
m AS (SELECT *, regexp_extract(label, '(?i)\bitem\s+(\d{1,2}[a-z]?)\b', 1) AS code, regexp_matches(label, '(?i)\bitem\s+\d{1,2}[a-z]?\.\d') AS deeper FROM l)
SELECT event_id, label, lower(CASE WHEN code <> '' AND NOT deeper THEN code END) AS code FROM m""")
def section_codes(spark, sf_dir):
    """Item codes of section labels."""
    i, u = F.col("event_id"), F.col("user_id")
    text = lambda c: c.cast("string")
    label = F.when(i % 4 == 0, F.concat(F.lit("Item "), text(u % 16), F.lit(". Business")))
    label = label.when(i % 4 == 1, F.concat(F.lit("ITEM  1"), F.chr(65 + u % 3), F.lit(". Risk Factors"))).when(i % 4 == 2, F.concat(F.lit("Item "), text(u % 9), F.lit(".0"), text(i % 3), F.lit(" Other"))).otherwise(F.col("event_type"))
    return views.table(spark, sf_dir, "events").select("event_id", label.alias("label")).withColumn("code", rq.section_code(F.col("label")))


@query("""WITH s AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT o_custkey, n / sum(n) OVER (PARTITION BY o_custkey) AS prob, o_orderstatus FROM s)
SELECT o_custkey, round(sum(prob), 6) AS total, abs(sum(prob) - 1) <= 1e-3 AS valid FROM p WHERE NOT (o_custkey % 3 = 0 AND o_orderstatus = 'P') GROUP BY o_custkey""")
def bucket_mass_check(spark, sf_dir):
    """Whether each forecast's bucket masses sum to one within a thousandth."""
    s = views.table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    s = s.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy("o_custkey"))).where("not (o_custkey % 3 = 0 and o_orderstatus = 'P')")
    return s.groupBy("o_custkey").agg(r6(F.sum("prob")).alias("total"), (F.abs(F.sum("prob") - 1) <= 1e-3).alias("valid"))


_HORIZONS = (5, 20)


@query(f"""WITH {BARS}, f AS (SELECT sym, d, hz, row_number() OVER (PARTITION BY sym, hz ORDER BY d) AS i, CASE hz WHEN 5 THEN c / lag(c, 5) OVER w - 1 ELSE c / lag(c, 20) OVER w - 1 END AS past, CASE hz WHEN 5 THEN lead(c, 5) OVER w / c - 1 ELSE lead(c, 20) OVER w / c - 1 END AS y FROM bars, (VALUES (5), (20)) v(hz) WINDOW w AS (PARTITION BY sym, hz ORDER BY d)),
b AS (SELECT *, count(past) OVER k AS n, avg(past) OVER k AS m, stddev_samp(past) OVER k AS sd FROM f WINDOW k AS (PARTITION BY sym, hz ORDER BY d ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
t AS (SELECT hz AS horizon, round(m - sd, 9) AS lo, round(m + sd, 9) AS hi, round(y, 9) AS y FROM b WHERE n = 60 AND y IS NOT NULL AND (i - 1) % 5 = 0), s AS (SELECT *, greatest(lo - y, y - hi) AS s FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY s) AS k, count(*) OVER (PARTITION BY horizon) AS n FROM s), q AS (SELECT horizon, max(n) AS n, max(s) FILTER (k = ceil(round((n + 1) * 0.9, 9))) AS q FROM r GROUP BY horizon)
SELECT horizon, q.n, round(coalesce(q, 0), 6) AS q, round(avg(CAST(y BETWEEN lo AND hi AS INT)), 6) AS coverage_before, round(avg(CAST(y >= lo - coalesce(q, 0) - 1e-12 AND y <= hi + coalesce(q, 0) + 1e-12 AS INT)), 6) AS coverage_after FROM s JOIN q USING (horizon) GROUP BY horizon, q.n, q.q""")
def conformal_pool(spark, sf_dir):
    """Intervals of past returns at every fifth bar, pooled over symbols: one correction for each horizon, and coverage before and after."""
    w, one = symbol().rowsBetween(-59, 0), []
    b = views.bars(spark, sf_dir).select("sym", "d", "c", F.row_number().over(symbol()).alias("i"), *((F.col("c") / F.lag("c", h).over(symbol()) - 1).alias(f"past{h}") for h in _HORIZONS), *((F.lead("c", h).over(symbol()) / F.col("c") - 1).alias(f"y{h}") for h in _HORIZONS))
    for h in _HORIZONS:
        past = F.col(f"past{h}")
        one.append(F.struct(F.lit(h).alias("horizon"), F.count(past).over(w).alias("n"), F.avg(past).over(w).alias("m"), F.stddev_samp(past).over(w).alias("sd"), F.col(f"y{h}").alias("y")))
    f = b.select("i", F.array(*one).alias("each")).select("i", F.inline("each")).where("n = 60 and y is not null and (i - 1) % 5 = 0")
    s = f.select("horizon", F.round(F.col("m") - F.col("sd"), 9).alias("lo"), F.round(F.col("m") + F.col("sd"), 9).alias("hi"), F.round("y", 9).alias("y"))
    s = dedupe.stored(s.withColumn("s", ev.nonconformity()), "conformal")
    fit = ev.pooled_conformal_q(s, ["horizon"], 0.1).withColumn("q", F.coalesce("q", F.lit(0.0)))
    y, q = F.col("y"), F.col("q")
    inside = lambda lo, hi: r6(F.avg(((y >= lo) & (y <= hi)).cast("int")))
    j = s.join(fit, "horizon")
    return j.groupBy("horizon", "n", r6(q).alias("q")).agg(inside(F.col("lo"), F.col("hi")).alias("coverage_before"), inside(F.col("lo") - q - 1e-12, F.col("hi") + q + 1e-12).alias("coverage_after"))


_QUESTION = "'Of the ' || CASE p_size % 3 WHEN 0 THEN 'suppliers' WHEN 1 THEN 'rivals' ELSE 'plants' END || ' that ' || p_brand || ' names, which one ' || CASE p_size % 4 WHEN 0 THEN 'discloses' WHEN 1 THEN 'warns about' WHEN 2 THEN 'mentions' ELSE 'has' END || ' ' || p_name || CASE WHEN p_size % 3 < 2 THEN ' in its own filings?' ELSE '?' END"


def _questions(spark, sf_dir):
    """(p_partkey, p_brand, p_name, p_size, question, bridging) from a template, one for each part."""
    size, text = F.col("p_size"), F.lit
    what = F.when(size % 3 == 0, "suppliers").when(size % 3 == 1, "rivals").otherwise("plants")
    verb = F.when(size % 4 == 0, "discloses").when(size % 4 == 1, "warns about").when(size % 4 == 2, "mentions").otherwise("has")
    question = F.concat(text("Of the "), what, text(" that "), F.col("p_brand"), text(" names, which one "), verb, text(" "), F.col("p_name"), F.when(size % 3 < 2, text(" in its own filings?")).otherwise(text("?")))
    p = views.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size", question.alias("question"))
    return p.withColumn("bridging", F.lower("question").rlike("|".join(tx.BRIDGE_CUES)))


@query(f"""WITH q AS (SELECT *, {_QUESTION} AS question FROM part) SELECT p_partkey, question, CASE WHEN p_size % 3 < 2 THEN p_brand || ' names the ' || CASE p_size % 3 WHEN 0 THEN 'supplier' ELSE 'rival' END || '|' || 'its own ' || p_name || ' disclosure' ELSE p_name || ' disclosure' END AS aspects, CASE WHEN p_size % 3 < 2 THEN 2 ELSE 1 END AS n_aspects FROM q""")
def question_templates(spark, sf_dir):
    """Questions with their aspects: two for a bridge to another company, one for a control."""
    bridge, what = F.col("p_size") % 3 < 2, F.when(F.col("p_size") % 3 == 0, "supplier").otherwise("rival")
    own = F.concat(F.col("p_name"), F.lit(" disclosure"))
    aspects = F.when(bridge, F.array(F.concat(F.col("p_brand"), F.lit(" names the "), what), F.concat(F.lit("its own "), own))).otherwise(F.array(own))
    return _questions(spark, sf_dir).select("p_partkey", "question", F.array_join(aspects, "|").alias("aspects"), F.size(aspects).alias("n_aspects"))


_TOPIC = "coalesce(" + ", ".join(f"CASE WHEN bridging AND strpos(lower(question), ' {c} ') > 0 THEN nullif(trim(regexp_replace(substring(question, strpos(lower(question), ' {c} ') + {len(c) + 2}), '{rq.TOPIC_TAIL}', '', 'gi')), '') END" for c in rq.TOPIC_CUES) + ", question)"


@query(f"""WITH q AS (SELECT *, {_QUESTION} AS question FROM part), b AS (SELECT *, regexp_matches(lower(question), '{'|'.join(tx.BRIDGE_CUES)}') AS bridging FROM q) SELECT p_partkey, bridging, 'Acme ' || {_TOPIC} AS scoped FROM b""")
def scoped_queries(spark, sf_dir):
    """What to search in a company that was met on the way: the topic of a bridging question, or all of it."""
    q = _questions(spark, sf_dir)
    return q.select("p_partkey", "bridging", rq.topic_query(F.col("question"), F.col("bridging"), F.lit("Acme")).alias("scoped"))


@query(f"""WITH {retrieval.LISTS}, u AS (SELECT query_id, id, min(list) AS list FROM lists GROUP BY 1, 2), g AS (SELECT u.*, d.source, d.lang FROM u JOIN documents d ON d.doc_id = u.id),
s AS (SELECT query_id, step, id, list, source, lang FROM g, (VALUES (1), (2)) v(step) WHERE list < step)
SELECT query_id, step, 2 - step AS budget, count(*) AS n_chunks, count(DISTINCT nullif(source, '')) AS n_sources, count(DISTINCT nullif(lang, '')) AS n_sections, count_if(list = step - 1) AS new_chunks FROM s GROUP BY 1, 2""")
def evidence_state(spark, sf_dir):
    """The state after each search step: what the evidence holds, what the step added, and the steps that are left."""
    u = retrieval.lists(spark, sf_dir).groupBy("query_id", "id").agg(F.min("list").alias("list"))
    g = u.join(retrieval.docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "source", "lang"), "id")
    s = g.withColumn("step", F.explode(F.sequence(F.col("list") + 1, F.lit(2))))
    known = lambda c: F.countDistinct(F.nullif(F.col(c), F.lit("")))
    out = s.groupBy("query_id", "step").agg(F.count(F.lit(1)).alias("n_chunks"), known("source").alias("n_sources"), known("lang").alias("n_sections"), F.count_if(F.col("list") == F.col("step") - 1).alias("new_chunks"))
    return out.withColumn("budget", 2 - F.col("step"))


@query(f"""WITH {retrieval.LISTS}, n AS (SELECT query_id, count(DISTINCT id) % 12 AS n_union, count(DISTINCT id) % 7 AS n_branches FROM lists GROUP BY query_id), g AS (SELECT n.*, r.wanted, CASE WHEN query_id % 2 = 0 THEN r.wanted ELSE 'breadth_first' END AS rule FROM n, (VALUES ('breadth_first'), ('pooled_rerank'), ('top_branches')) r(wanted))
SELECT query_id, wanted, rule, CASE rule WHEN 'breadth_first' THEN greatest(14, n_union + n_branches) WHEN 'top_branches' THEN least(14, n_union + 9) ELSE 14 END AS cap FROM g""")
def seating_caps(spark, sf_dir):
    """The cap of each seating rule; without a reranker (odd questions) all are breadth first."""
    n = retrieval.lists(spark, sf_dir).groupBy("query_id").agg(F.countDistinct("id").alias("n"))
    g = n.withColumn("wanted", F.explode(F.array(*map(F.lit, ("breadth_first", "pooled_rerank", "top_branches")))))
    g = g.withColumn("rule", F.when(F.col("query_id") % 2 == 0, F.col("wanted")).otherwise("breadth_first"))
    return g.select("query_id", "wanted", "rule", rq.evidence_cap(F.col("rule"), F.col("n") % 12, F.col("n") % 7).alias("cap"))


@query(f"""WITH {retrieval.LISTS}, base AS (SELECT * FROM lists WHERE list = 0 AND rank <= 10), more AS (SELECT l.query_id, 1 AS list, row_number() OVER (PARTITION BY l.query_id ORDER BY l.rank) AS rank, l.id FROM lists l ANTI JOIN base b ON b.query_id = l.query_id AND b.id = l.id WHERE l.list = 1),
f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, list, rank, id FROM base UNION ALL SELECT query_id, list, rank, id FROM more) GROUP BY 1, 2)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 12""")
def graph_fusion(spark, sf_dir):
    """A base list fused with what a second retriever adds to it."""
    all_ = retrieval.lists(spark, sf_dir)
    base = all_.where("list = 0 and rank <= 10")
    more = all_.where("list = 1").join(base.select("query_id", "id"), ["query_id", "id"], "left_anti")
    more = more.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return rt.fuse(base.unionByName(more), ["query_id"]).where("rank <= 12").select("query_id", "id", "score", "rank")


_TRIPLE = """SELECT o_orderkey AS seq, 'part ' || (o_custkey % 20) AS subject, CASE o_custkey % 5 WHEN 0 THEN 'depends_on' WHEN 1 THEN 'competes_with' WHEN 2 THEN 'mentions_risk' WHEN 3 THEN 'exposed_to' ELSE 'likes' END AS relation,
 CASE WHEN o_custkey % 5 < 2 THEN 'Part ' || (o_orderkey % 25) || ' Holdings Inc' ELSE 'Delay, ' || lower(o_orderpriority) END AS object, CASE WHEN o_orderkey % 6 < 5 THEN 'It buys from Part ' || (o_orderkey % 30) || ', among others.' END AS chunk_text, CASE WHEN o_custkey % 9 > 0 THEN o_totalprice / 300000 END AS confidence FROM orders"""
_CORE = "regexp_replace(trim(regexp_replace(lower(object), '[^a-z0-9]+', ' ', 'g')), '( (holdings|inc))+$', '')"


@query(f"""WITH t AS ({_TRIPLE}), k AS (SELECT *, {_CORE} AS core, greatest(0, least(1, coalesce(confidence, 1))) AS conf, relation IN ('depends_on', 'competes_with') AS company FROM t),
v AS (SELECT *, trim(regexp_replace(CASE WHEN company THEN core ELSE lower(object) END, '[^a-z0-9]+', '-', 'g'), '-') AS object_id FROM k WHERE relation <> 'likes' AND chunk_text IS NOT NULL AND conf >= 0.5 AND (NOT company OR (core <> subject AND contains(' ' || regexp_replace(lower(chunk_text), '[^a-z0-9]+', ' ', 'g') || ' ', ' ' || core || ' '))))
SELECT subject, relation, object_id, round(arg_max(conf, seq), 6) AS confidence, count(*) AS n, max(seq) AS seq FROM v GROUP BY 1, 2, 3""")
def edge_validation(spark, sf_dir):
    """Raw triples checked against their chunks; the last of equal edges stays."""
    i, k, text = F.col("o_orderkey"), F.col("o_custkey"), lambda c: c.cast("string")
    relation = F.element_at(F.array(*map(F.lit, (*rq.OBJECT_KINDS, "likes"))), (k % 5 + 1).cast("int"))
    name = F.when(k % 5 < 2, F.concat(F.lit("Part "), text(i % 25), F.lit(" Holdings Inc"))).otherwise(F.concat(F.lit("Delay, "), F.lower("o_orderpriority")))
    chunk = F.when(i % 6 < 5, F.concat(F.lit("It buys from Part "), text(i % 30), F.lit(", among others.")))
    t = views.table(spark, sf_dir, "orders").select(i.alias("seq"), F.concat(F.lit("part "), text(k % 20)).alias("subject"), relation.alias("relation"), name.alias("object"), chunk.alias("chunk_text"), F.when(k % 9 > 0, F.col("o_totalprice") / 300000).alias("confidence"))
    return rq.checked_triples(t).withColumn("confidence", r6(F.col("confidence")))


@query("""WITH r AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'click') AS b FROM events GROUP BY user_id), p AS (SELECT user_id % 3 AS stratum, a, b, a - b AS delta FROM r WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT coalesce(CAST(stratum AS VARCHAR), 'all') AS stratum, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(delta), 6) AS delta, count_if(delta > 0) AS wins FROM p GROUP BY ROLLUP (stratum)""")
def head_to_head(spark, sf_dir):
    """Two runs over the same episodes, paired: mean difference and wins, for each stratum and in all."""
    mean = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    r = views.table(spark, sf_dir, "events").groupBy("user_id").agg(mean("view").alias("a"), mean("click").alias("b")).where("a is not null and b is not null")
    d = F.col("a") - F.col("b")
    p = r.withColumn("stratum", (F.col("user_id") % 3).cast("string")).rollup("stratum").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("a")).alias("mean_a"), r6(F.avg("b")).alias("mean_b"), r6(F.avg(d)).alias("delta"), F.count_if(d > 0).alias("wins"))
    return p.withColumn("stratum", F.coalesce("stratum", F.lit("all")))


@query("""WITH l AS (SELECT vec_id, list_transform([1, 2, 3, 4], lambda i: CASE WHEN (label + i) % 4 <> 0 THEN CAST(embedding[i] AS DOUBLE) * 8 END) AS x FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
e AS (SELECT vec_id, list_transform(x, lambda v: coalesce(exp(v - list_max(x)), 0)) AS e FROM l) SELECT vec_id, round(e[1] / list_sum(e), 6) AS p1, round(e[2] / list_sum(e), 6) AS p2, round(e[3] / list_sum(e), 6) AS p3, round(e[4] / list_sum(e), 6) AS p4 FROM e""")
def softmax_policy(spark, sf_dir):
    """Probabilities of a linear policy over the actions that are legal."""
    e = views.table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    logits = F.transform(F.slice("embedding", 1, 4), lambda v: v.cast("double") * 8)
    legal = F.array(*((F.col("label") + i) % 4 != 0 for i in range(1, 5)))
    p = e.select("vec_id", rq.masked_softmax(logits, legal).alias("p"))
    return p.select("vec_id", *(r6(F.col("p")[i]).alias(f"p{i + 1}") for i in range(4)))


@query("""WITH h AS (SELECT event_id, user_id, value, CAST('0x' || substring(md5(CAST(event_id AS VARCHAR)), 1, 7) AS BIGINT) AS h, CAST('0x' || substring(md5('g' || user_id), 1, 7) AS BIGINT) AS g FROM events)
SELECT event_id, h % 4 AS action, 0.25::DOUBLE AS propensity, round(value / 100 - 0.05::DOUBLE * (h % 4), 6) AS reward, CASE WHEN g % 10 < 3 THEN 'test' ELSE 'train' END AS part FROM h""")
def logged_sample(spark, sf_dir):
    """A log of a uniform policy: hash-random actions, their rewards less their costs, and a split that keeps users whole."""
    h = lambda c: F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("long")
    e = views.table(spark, sf_dir, "events").withColumn("action", h(F.col("event_id").cast("string")) % 4)
    group = h(F.concat(F.lit("g"), F.col("user_id").cast("string"))) % 10
    return e.select("event_id", "action", F.lit(0.25).alias("propensity"), r6(F.col("value") / 100 - 0.05 * F.col("action")).alias("reward"), F.when(group < 3, "test").otherwise("train").alias("part"))


@query("""WITH r AS (SELECT *, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS provider_rank FROM events), m AS (SELECT *, min(provider_rank) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS best FROM r)
SELECT event_id, user_id, provider_rank FROM m WHERE provider_rank = best""")
def provider_failover(spark, sf_dir):
    """For each user and day the rows of the first provider that has any; no other provider's rows are mixed in."""
    e = views.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    kind = F.col("event_type")
    rank = F.when(kind == "purchase", 1).when(kind == "signup", 2).when(kind == "view", 3).otherwise(4)
    return rq.merged_by_priority(e, ["user_id", "day"], rank).select("event_id", "user_id", "provider_rank")


_BRAND = "CAST(substring(sym, 7) AS INT)"


@query(
    f"""WITH {BARS}, w AS (SELECT DISTINCT p_brand AS sym FROM part UNION SELECT 'Brand#none'), year AS (SELECT * FROM bars WHERE d BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'),
    a AS (SELECT sym, d, c, 'daily' AS provider FROM year WHERE {_BRAND} % 3 = 1), b AS (SELECT sym, min(d) AS d, max(c) AS c, 'weekly' AS provider FROM year WHERE {_BRAND} % 2 = 0 GROUP BY sym, date_trunc('week', d)), c AS (SELECT sym, max(d) AS d, max(c) AS c, 'yearly' AS provider FROM year WHERE {_BRAND} % 5 <> 0 GROUP BY sym),
    got AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE sym NOT IN (SELECT sym FROM a) UNION ALL SELECT * FROM c WHERE sym NOT IN (SELECT sym FROM a) AND sym NOT IN (SELECT sym FROM b))
    SELECT w.sym, got.provider, count(got.d) AS n, min(got.d) AS first_day, round(max(got.c), 6) AS highest FROM w LEFT JOIN got ON got.sym = w.sym GROUP BY w.sym, got.provider"""
)
def provider_chain(spark, sf_dir):
    """Prices of every brand in a year from the first of three sources that has any: daily, weekly or one bar; a brand that none has is a row of its own."""
    year = views.bars(spark, sf_dir).where("d between date'1997-01-01' and date'1997-12-31'").select("sym", "d", "c", F.substring("sym", 7, 9).cast("int").alias("k"))
    daily = year.where("k % 3 = 1").select("sym", "d", "c")
    weekly = year.where("k % 2 = 0").groupBy("sym", F.trunc("d", "week").alias("week")).agg(F.min("d").alias("d"), F.max("c").alias("c")).drop("week")
    yearly = year.where("k % 5 <> 0").groupBy("sym").agg(F.max("d").alias("d"), F.max("c").alias("c"))
    wanted = views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("sym")).union(spark.createDataFrame([("Brand#none",)], "sym string")).distinct()
    got = rq.first_with_rows(wanted, {"daily": daily, "weekly": weekly, "yearly": yearly}, "sym")
    return got.groupBy("sym", "provider").agg(F.count("d").alias("n"), F.min("d").alias("first_day"), r6(F.max("c")).alias("highest"))


@query(f"""WITH {BARS}, s AS (SELECT sym, count(*) AS n, arg_min(c, d) AS first_close, arg_max(c, d) AS last_close FROM bars GROUP BY sym), w AS (SELECT * FROM (VALUES ('Brand#1'), ('Brand#7'), ('Brand#99')) v(sym))
SELECT w.sym, n, round(last_close / first_close - 1, 6) AS pct_change, CASE WHEN n IS NULL THEN 'no bars' END AS error FROM w LEFT JOIN s USING (sym)""")
def compare_symbols(spark, sf_dir):
    """One row for each requested symbol; a symbol without bars is a row with an error."""
    wanted = spark.createDataFrame([("Brand#1",), ("Brand#7",), ("Brand#99",)], "sym string")
    b = views.bars(spark, sf_dir).join(F.broadcast(wanted), "sym", "left_semi")
    s = b.groupBy("sym").agg(F.count(F.lit(1)).alias("n"), r6(F.max_by("c", "d") / F.min_by("c", "d") - 1).alias("pct_change"))
    return wanted.join(s, "sym", "left").withColumn("error", F.when(F.col("n").isNull(), "no bars"))


@query("""SELECT conv_id, turn, role, md5(coalesce("text", '')) AS digest, "text" IS NULL AS blank FROM conversations""")
def message_roundtrip(spark, sf_dir):
    """Messages as JSON and back."""
    c = views.table(spark, sf_dir, "conversations")
    back = F.from_json(F.to_json(F.struct("role", "text")), "role string, text string")
    return c.select("conv_id", "turn", back["role"].alias("role"), F.md5(F.coalesce(back["text"], F.lit(""))).alias("digest"), back["text"].isNull().alias("blank"))


@query("""WITH m AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events WHERE event_type <> 'error'), s AS (SELECT DISTINCT day + 1 AS day, user_id FROM m)
SELECT m.day, count(*) AS n_new, min(m.user_id) AS first_new FROM m ANTI JOIN s ON s.day = m.day AND s.user_id = m.user_id GROUP BY m.day""")
def discovered_entities(spark, sf_dir):
    """Names met on a day that the day before had not searched."""
    m = views.table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.to_date("ts").alias("day"), "user_id").distinct()
    searched = m.select(F.date_add("day", 1).alias("day"), "user_id")
    return m.join(searched, ["day", "user_id"], "left_anti").groupBy("day").agg(F.count(F.lit(1)).alias("n_new"), F.min("user_id").alias("first_new"))
