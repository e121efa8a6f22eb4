"""Queries over texts: chunks, sections, numbers, citations, threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import chunking
from quern.plans.base import query
from quern.sources import views
from quern.sources.articles import ARTICLES, articles


def docs(spark, sf_dir) -> DataFrame:
    return views.table(spark, sf_dir, "documents")


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce("text", '')), '[a-z0-9]+') AS x FROM documents) SELECT doc_id, CAST(len(x) AS BIGINT) AS n_tokens, CAST(len(list_distinct(x)) AS BIGINT) AS n_distinct, x[1] AS first_token FROM t""")
def tokenise(spark, sf_dir):
    """ASCII word tokens of each text."""
    t = docs(spark, sf_dir).select("doc_id", tx.tokens(F.col("text")).alias("x"))
    return t.select("doc_id", F.size("x").cast("long").alias("n_tokens"), F.size(F.array_distinct("x")).cast("long").alias("n_distinct"), F.get("x", F.lit(0)).alias("first_token"))


@query(f"WITH {ARTICLES} SELECT doc_id, regexp_replace(substring(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS slug FROM articles")
def slug_norm(spark, sf_dir):
    """Node ids of titles."""
    return articles(spark, sf_dir).select("doc_id", tx.slug(F.col("title")).alias("slug"))


@query(f"SELECT s_suppkey, regexp_replace(trim(regexp_replace(lower(s_name || CASE s_suppkey % 6 WHEN 0 THEN ' Holdings, Inc.' WHEN 1 THEN ' Co Ltd' WHEN 2 THEN '' WHEN 3 THEN ' Company' WHEN 4 THEN ' Holding GmbH' ELSE ' Companies SE' END), '[^a-z0-9]+', ' ', 'g')), '^(.+?)( ({tx.SUFFIXES}))+$', '\\1') AS core FROM supplier")
def core_company_name(spark, sf_dir):
    """Company names without closing legal words."""
    k = F.col("s_suppkey") % 6
    end = F.when(k == 0, " Holdings, Inc.").when(k == 1, " Co Ltd").when(k == 2, "").when(k == 3, " Company").when(k == 4, " Holding GmbH").otherwise(" Companies SE")
    return views.table(spark, sf_dir, "supplier").select("s_suppkey", tx.core_name(F.concat("s_name", end)).alias("core"))


_WORDS = """list_filter(regexp_split_to_array("text", '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"""
CHUNKS = f"""worded AS (SELECT doc_id, lang, source, {_WORDS} AS w FROM documents WHERE "text" IS NOT NULL), kept AS (SELECT *, len(w) AS n FROM worded WHERE len(w) >= 15),
  placed AS (SELECT doc_id, lang, source, w, n, unnest(range(0, CASE WHEN n <= 150 THEN 1 ELSE CAST(ceil((n - 150) / 128.0) AS BIGINT) + 1 END)) AS k FROM kept),
  chunks AS (SELECT doc_id, lang, source, k AS chunk_index, doc_id || ':' || k AS chunk_id, w[k * 128 + 1 : k * 128 + 150] AS words FROM placed)"""


@query(f"WITH {CHUNKS} SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_id, CAST(len(words) AS BIGINT) AS n_words, md5(array_to_string(words, ' ')) AS digest FROM chunks")
def chunk_windows(spark, sf_dir):
    """Overlapping word windows of each text."""
    c = chunking.chunks(docs(spark, sf_dir), chunk_tokens=200)
    return c.select("doc_id", "chunk_index", "chunk_id", "n_words", F.md5("text").alias("digest"))


@query(f"WITH worded AS (SELECT source, len({_WORDS}) AS n FROM documents WHERE \"text\" IS NOT NULL) SELECT source, CAST(round_even(sum(n) / 0.75, 0) AS BIGINT) AS tokens FROM worded GROUP BY source")
def estimate_tokens(spark, sf_dir):
    """Approximate tokens of each source."""
    d = docs(spark, sf_dir).where("text is not null")
    return d.groupBy("source").agg(F.bround(F.sum(chunking.n_words(F.col("text"))) / 0.75).cast("long").alias("tokens"))


@query("SELECT doc_id, source, lang FROM documents WHERE source = 'src3' AND lang IN ('en', 'fr') AND doc_id BETWEEN 100 AND 100000")
def chunk_filter_predicate(spark, sf_dir):
    """A conjunction of optional metadata conditions that reaches the scan."""
    return chunking.matching(docs(spark, sf_dir), ticker="src3", sections=["en", "fr"], low=100, high=100_000).select("doc_id", "source", "lang")


@query(f"""WITH {CHUNKS} SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index FROM chunks WHERE regexp_matches(lower(array_to_string(words, ' ')), '(^|[^a-z0-9])(the|der|la)([^a-z0-9]|$)') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) <= 40""")
def per_doc_cap_40(spark, sf_dir):
    """The first 40 chunks of each document that hold a cue (the cap is the feature)."""
    c = chunking.chunks(docs(spark, sf_dir), chunk_tokens=200).where(F.lower("text").rlike("(^|[^a-z0-9])(the|der|la)([^a-z0-9]|$)"))
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    return c.withColumn("k", F.row_number().over(w)).where("k <= 40").select("doc_id", "chunk_index")


@query(f"WITH {CHUNKS} SELECT count(*) AS n_chunks, count(DISTINCT doc_id) AS n_documents, count(DISTINCT source) AS n_tickers, min(doc_id) AS earliest, max(doc_id) AS latest FROM chunks")
def corpus_status(spark, sf_dir):
    """Totals of the chunk store."""
    c = chunking.chunks(docs(spark, sf_dir), chunk_tokens=200)
    per = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("source").alias("source"))
    return per.agg(F.sum("n").alias("n_chunks"), F.count(F.lit(1)).alias("n_documents"), F.countDistinct("source").alias("n_tickers"), F.min("doc_id").alias("earliest"), F.max("doc_id").alias("latest"))


@query()
def section_detect(spark, sf_dir):
    """Sections of filings by their item headers: a parser over lines, tested on its own."""
    body = F.concat(F.lit("Cover page\nItem 1. Business\n"), F.coalesce("text", F.lit("")), F.lit("\nItem 1A. Risk Factors\nnone\nItem 7.\n"))
    s = docs(spark, sf_dir).select("doc_id", F.posexplode(chunking.sections(body)).alias("k", "s"))
    return s.select("doc_id", "k", "s.label", F.length("s.body").alias("n_chars"))


# questions and answers -------------------------------------------------------------------

_RISK, _MONEY, _TRADE, _BRIDGE = tx.RISK_CUES, tx.FINANCIAL_CUES, tx.BUSINESS_CUES, tx.BRIDGE_CUES
_QUESTION = """'What ' || CASE item_id % 5 WHEN 0 THEN 'liabilities has src' WHEN 1 THEN 'dividend has src' WHEN 2 THEN 'vendor of src' WHEN 3 THEN 'platform has src' ELSE 'competitor is src' END || (item_id % 25) || ' about ' || lower("text")"""


def questions(spark, sf_dir) -> DataFrame:
    """(item_id, q, ticker): questions made of the benchmark's passages."""
    i = F.col("item_id")
    about = F.when(i % 5 == 0, "liabilities has src").when(i % 5 == 1, "dividend has src").when(i % 5 == 2, "vendor of src").when(i % 5 == 3, "platform has src").otherwise("competitor is src")
    return views.table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("What "), about, (i % 25).cast("string"), F.lit(" about "), F.lower("text")).alias("q"), F.when(i % 2 == 0, F.concat(F.lit("src"), (i % 25).cast("string"))).alias("ticker"))


def _cue(q: Column, cues: tuple[str, ...]) -> Column:
    return F.lower(q).rlike("|".join(cues))


def query_features(q: Column, ticker: Column, named: Column, universe: list[str]) -> Column:
    """The 11 features of a question: bias, length, scope, entities, bridging, one of five kinds, in the graph."""
    flag = lambda c: c.cast("double")
    bridge, risk, money, trade = (_cue(q, c) for c in (_BRIDGE, _RISK, _MONEY, _TRADE))
    kinds = [~bridge & risk, ~bridge & ~risk & money, ~bridge & ~risk & ~money & trade, ~bridge & ~risk & ~money & ~trade, bridge]
    primary = F.coalesce(ticker, F.array_min(named))
    n = F.size(F.split(F.trim(q), "[ \\t\\n\\r\\f\\x0B]+")).cast("double")
    inside = F.coalesce(primary.isin(universe), F.lit(False))
    return F.array(F.lit(1.0), n, flag(primary.isNotNull()), F.size(named).cast("double"), flag(bridge), *map(flag, kinds), flag(inside))


_IN = {k: f"regexp_matches(lower(q), '{'|'.join(v)}')" for k, v in (("bridge", _BRIDGE), ("risk", _RISK), ("money", _MONEY), ("trade", _TRADE))}


@query(
    f"""WITH qs AS (SELECT item_id, {_QUESTION} AS q, CASE WHEN item_id % 2 = 0 THEN 'src' || (item_id % 25) END AS ticker FROM benchmark), n AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(q), 'src[0-9]+'), lambda s: CAST(substring(s, 4) AS INT) < 20)) AS named FROM qs),
    f AS (SELECT *, coalesce(ticker, list_min(named)) AS prim, {', '.join(f'{v} AS {k}' for k, v in _IN.items())} FROM n)
    SELECT item_id, 1.0::DOUBLE AS bias, CAST(len(regexp_split_to_array(trim(q), '[ \\t\\n\\r\\f\\v]+')) AS DOUBLE) AS n_tokens, CAST(prim IS NOT NULL AS DOUBLE) AS has_ticker, CAST(len(named) AS DOUBLE) AS n_entities, CAST(bridge AS DOUBLE) AS is_bridging, CAST(NOT bridge AND risk AS DOUBLE) AS qtype_risk,
      CAST(NOT bridge AND NOT risk AND money AS DOUBLE) AS qtype_financial, CAST(NOT bridge AND NOT risk AND NOT money AND trade AS DOUBLE) AS qtype_business, CAST(NOT bridge AND NOT risk AND NOT money AND NOT trade AS DOUBLE) AS qtype_overview, CAST(bridge AS DOUBLE) AS qtype_bridging, CAST(coalesce(prim IN ('src1', 'src2', 'src3'), false) AS DOUBLE) AS in_graph_universe FROM f"""
)
def query_features_11(spark, sf_dir):
    """Features of each question for the retrieval policies."""
    names = ("bias", "n_tokens", "has_ticker", "n_entities", "is_bridging", "qtype_risk", "qtype_financial", "qtype_business", "qtype_overview", "qtype_bridging", "in_graph_universe")
    q = questions(spark, sf_dir)
    named = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("q"), F.lit("src[0-9]+"), F.lit(0)), lambda s: F.substring(s, 4, 9).cast("int") < 20))
    f = q.select("item_id", query_features(F.col("q"), F.col("ticker"), named, ["src1", "src2", "src3"]).alias("f"))
    return f.select("item_id", *(F.col("f")[k].alias(n) for k, n in enumerate(names)))


_REPLY = """'Up ' || (conv_id % 97) || '.5% to 1,' || lpad(CAST((turn * 137 + conv_id) % 1000 AS VARCHAR), 3, '0') || '.25, see [' || (turn + 1) || '] and [' || (conv_id % 7) || '] [' || (turn + 1) || ']; 1,2,3 in 2024. ' || coalesce("text", '')"""


def replies(spark, sf_dir) -> DataFrame:
    """(conv_id, turn, reply): assistant texts with figures and citation marks."""
    c, t = F.col("conv_id"), F.col("turn")
    s = lambda x: x.cast("string")
    reply = F.concat(F.lit("Up "), s(c % 97), F.lit(".5% to 1,"), F.lpad(s((t * 137 + c) % 1000), 3, "0"), F.lit(".25, see ["), s(t + 1), F.lit("] and ["), s(c % 7), F.lit("] ["), s(t + 1), F.lit("]; 1,2,3 in 2024. "), F.coalesce("text", F.lit("")))
    return views.table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", reply.alias("reply"))


def checked_numbers(x: Column) -> Column:
    """Percentages and decimals of a text, thousands commas stripped; whole numbers are not checked."""
    return F.regexp_extract_all(tx.thousands_stripped(x), F.lit(r"-?\d+(?:\.\d+)?%|-?\d+\.\d+"), F.lit(0))


@query(f"""WITH r AS (SELECT conv_id, turn, {_REPLY} AS reply FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, array_to_string(regexp_extract_all(regexp_replace(reply, '([0-9]),([0-9]{{3}})([^0-9]|$)', '\\1\\2\\3', 'g'), '-?[0-9]+(?:\\.[0-9]+)?%|-?[0-9]+\\.[0-9]+'), ' ') AS numbers FROM r""")
def number_tokens(spark, sf_dir):
    """Figures of a reply that need a source."""
    return replies(spark, sf_dir).select("conv_id", "turn", F.array_join(checked_numbers(F.col("reply")), " ").alias("numbers"))


def forms(v: Column) -> Column:
    """A value and its hundredfold to 1, 2 and 4 digits."""
    return F.array(*(F.round(x, d) for x in (v, v * 100) for d in (1, 2, 4)))


_FORMS = lambda v: "[" + ", ".join(f"round({x}, {d})" for x in (v, f"({v} * 100)") for d in (1, 2, 4)) + "]"


@query(
    f"""WITH r AS (SELECT conv_id, turn, {_REPLY} AS reply FROM conversations WHERE role = 'assistant'), toks AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(regexp_replace(reply, '([0-9]),([0-9]{{3}})([^0-9]|$)', '\\1\\2\\3', 'g'), '-?[0-9]+(?:\\.[0-9]+)?%|-?[0-9]+\\.[0-9]+'))) AS tok FROM r),
    v AS (SELECT *, CAST(replace(tok, '%', '') AS DOUBLE) AS v FROM toks), f AS (SELECT *, list_concat({_FORMS('v')}, {_FORMS('(v / 100)')}) AS have, list_concat({_FORMS('CAST(conv_id % 97 + 0.5 AS DOUBLE)')}, {_FORMS('CAST(1000 + turn AS DOUBLE)')}) AS known FROM v)
    SELECT conv_id, turn, tok AS number FROM f WHERE len(list_intersect(have, known)) = 0"""
)
def ungrounded_numbers(spark, sf_dir):
    """Figures of a reply without a match, rounded, among the values it was given."""
    r = replies(spark, sf_dir).select("conv_id", "turn", F.explode(F.array_distinct(checked_numbers(F.col("reply")))).alias("number"))
    v = F.replace("number", F.lit("%"), F.lit("")).cast("double")
    known = F.concat(forms((F.col("conv_id") % 97 + 0.5).cast("double")), forms((1000 + F.col("turn")).cast("double")))
    return r.where(~F.arrays_overlap(F.concat(forms(v), forms(v / 100)), known))


@query(f"""WITH r AS (SELECT conv_id, turn, {_REPLY} AS reply FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(reply, '\\[([0-9]+)\\]', 1), lambda m: CAST(m AS INT)))), ',') AS markers FROM r""")
def citation_markers(spark, sf_dir):
    """Distinct citation numbers of a reply."""
    m = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("reply", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))))
    return replies(spark, sf_dir).select("conv_id", "turn", F.array_join(F.transform(m, lambda x: x.cast("string")), ",").alias("markers"))


@query(f"WITH {ARTICLES}, canon AS (SELECT doc_id, source, 'https://news.' || lower(source) || '.example.com/a/' || (doc_id % 300) || CASE WHEN doc_id % 2 = 0 THEN '?id=1' ELSE '?b=2' END AS url FROM articles) SELECT c.doc_id, c.url FROM canon c WHERE c.url NOT IN (SELECT url FROM canon WHERE doc_id % 5 < 3)")
def invalid_citations(spark, sf_dir):
    """Cited URLs, canonical, that are not among the allowed ones."""
    a = articles(spark, sf_dir).select("doc_id", tx.canonical_url(F.col("url")).alias("url"))
    return a.join(a.where("doc_id % 5 < 3").select("url").distinct(), "url", "left_anti").select("doc_id", "url")


@query("""WITH spans AS (SELECT item_id, [lower(regexp_replace(trim("text"), '[ \\t\\n\\r]+', ' ', 'g'))[1:40], lower(regexp_replace(trim("text"), '[ \\t\\n\\r]+', ' ', 'g'))[-40:]] AS s FROM benchmark), d AS (SELECT doc_id, lower(regexp_replace(trim("text"), '[ \\t\\n\\r]+', ' ', 'g')) AS t FROM documents WHERE "text" IS NOT NULL)
SELECT item_id, doc_id, CAST(CAST(contains(t, s[1]) AS INT) + CAST(contains(t, s[2]) AS INT) AS BIGINT) AS grade FROM d JOIN spans ON contains(t, s[1]) OR contains(t, s[2])""")
def relevance_grade(spark, sf_dir):
    """How many of a passage's spans a text holds.  Spans are found by their first word, so texts meet only passages that share it."""
    return chunking.span_grades(docs(spark, sf_dir), views.table(spark, sf_dir, "benchmark"), 40)


@query("SELECT doc_id, upper(source) || ' 10-K ' || strftime(DATE '2020-01-01' + CAST(doc_id % 900 AS INT), '%b %-d, %Y') || CASE WHEN lang IS NOT NULL THEN ' — ' || lang ELSE '' END AS label FROM documents")
def citation_label(spark, sf_dir):
    """Ticker, form, date and section as one label."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 900).cast("int"))
    end = F.when(F.col("lang").isNotNull(), F.concat(F.lit(" — "), "lang")).otherwise("")
    return docs(spark, sf_dir).select("doc_id", F.concat(F.upper("source"), F.lit(" 10-K "), F.date_format(day, "MMM d, yyyy"), end).alias("label"))


@query("""SELECT conv_id, CASE WHEN t IS NULL THEN 'New chat' WHEN length(t) > 60 THEN t[1:59] || '…' ELSE t END AS title FROM (SELECT conv_id, arg_min(c, turn) FILTER (role = 'user' AND c <> '') AS t FROM (SELECT *, trim(regexp_replace("text", '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS c FROM conversations) GROUP BY conv_id)""")
def thread_title(spark, sf_dir):
    """A thread's first user message that is not blank, at most 60 characters; a thread without one is a new chat."""
    c = views.table(spark, sf_dir, "conversations").withColumn("c", tx.clean(F.col("text")))
    asks = (F.col("role") == "user") & (F.col("c") != "")
    t = c.groupBy("conv_id").agg(F.min_by(F.when(asks, F.col("c")), F.when(asks, F.col("turn"))).alias("t"))
    return t.select("conv_id", F.when(F.col("t").isNull(), "New chat").when(F.length("t") > 60, F.concat(F.substring("t", 1, 59), F.lit("…"))).otherwise(F.col("t")).alias("title"))


_FORBIDDEN = "(?i)" + "|".join(tx.FORECASTS)
#: Lines that replies are given at their end: forecasts, and reported facts that only look like them.
_SAID = ("A 12.5% chance of rain", "Analyst raised price target to $300", "My price target is $300\nThe stock will gain 20% soon", "Revenue up 20%; the price will reach $300", "Expected return 5%: 10% upside potential")
_SAID_SQL = "CASE conv_id % 5 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_SAID)) + " END"


@query(f"""WITH f AS (SELECT conv_id, turn, unnest(string_split("text" || chr(10) || {_SAID_SQL}, chr(10))) AS x FROM conversations WHERE role = 'assistant' AND "text" IS NOT NULL) SELECT conv_id, turn, count(*) AS violations FROM f WHERE regexp_matches(x, '{_FORBIDDEN}') GROUP BY conv_id, turn""")
def forecast_violations(spark, sf_dir):
    """Fragments of replies, a line each, that forecast by themselves; reported facts do not count."""
    c = views.table(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    end = F.coalesce(*(F.when(F.col("conv_id") % 5 == k, F.lit(x)) for k, x in enumerate(_SAID)))
    f = c.select("conv_id", "turn", F.explode(F.split(F.concat("text", F.lit("\n"), end), "\n")).alias("x"))
    return f.where(F.col("x").rlike(_FORBIDDEN)).groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("violations"))


@query("SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def json_lenient(spark, sf_dir):
    """JSON out of a text around it: the whole text, else its outermost braces, else nothing."""
    form = F.col("event_id") % 3
    raw = F.when(form == 0, F.col("props")).when(form == 1, F.concat(F.lit("Sure! Here: "), "props", F.lit(" Done."))).otherwise(F.concat(F.lit("Sorry, "), F.replace("props", F.lit("}"), F.lit(""))))
    e = views.table(spark, sf_dir, "events").withColumn("raw", raw)
    whole, inner = F.from_json("raw", "k long"), F.from_json(F.regexp_extract("raw", r"(?s)\{.*\}", 0), "k long")
    return e.select("event_id", F.coalesce(whole["k"], inner["k"]).alias("k"))


#: Curated topics with their phrases, and other names of them (fixed values).
TOPICS = {
    "ai": ("artificial intelligence", "generative AI", "AI model"),
    "ai_infra": ("AI data center", "GPU cluster", "AI accelerator"),
    "ai_energy": ("AI power demand", "data center energy", "AI electricity"),
    "ai_memory": ("HBM", "high bandwidth memory", "AI memory"),
    "ev": ("electric vehicle", "EV sales", "EV battery"),
    "robotics": ("robotics", "humanoid robot", "industrial automation"),
    "semiconductors": ("semiconductor", "chipmaker", "chip foundry"),
}
TOPIC_NAMES = {
    "artificial intelligence": "ai",
    "ai infrastructure": "ai_infra",
    "ai infra": "ai_infra",
    "data centers": "ai_infra",
    "ai energy": "ai_energy",
    "ai power": "ai_energy",
    "ai memory": "ai_memory",
    "hbm": "ai_memory",
    "evs": "ev",
    "electric vehicles": "ev",
    "electric vehicle": "ev",
    "robots": "robotics",
    "humanoid robots": "robotics",
    "semis": "semiconductors",
    "semiconductor": "semiconductors",
    "chips": "semiconductors",
}
_ASKED = ("AI", " Data-Centers? ", "e.v.", "Humanoid  robots!", "hbm", "ai_power", "Semis")
_NAME = "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_ASKED)) + " ELSE title END"
_KNOWN = {**{k.replace("_", " "): k for k in TOPICS}, **TOPIC_NAMES}
_SLUG = """trim(regexp_replace(lower(regexp_replace(name, '[^A-Za-z0-9_ \\t\\n\\r-]', ' ', 'g')), '[-_ \\t\\n\\r]+', ' ', 'g'))"""


@query(
    f"""WITH {ARTICLES}, n AS (SELECT doc_id, {_NAME} AS name FROM articles), s AS (SELECT *, CASE {_SLUG} {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _KNOWN.items())} END AS found FROM n)
SELECT doc_id, coalesce(found, trim(name)) AS topic, CASE found {' '.join(f"WHEN '{k}' THEN '{'|'.join(v)}'" for k, v in TOPICS.items())} ELSE trim(name) END AS phrases, found IS NOT NULL AS known, len(list_filter(regexp_split_to_array(trim(name), '[ \\t\\n\\r]+'), lambda w: w <> '')) > 6 AS looks_like_sentence FROM s"""
)
def topic_resolve(spark, sf_dir):
    """Topic names by slug or other name, with their phrases, else as they are; and which look like a sentence."""
    i = F.col("doc_id") % 8
    name = F.coalesce(*(F.when(i == k, F.lit(x)) for k, x in enumerate(_ASKED)), F.col("title"))
    n = articles(spark, sf_dir).select("doc_id", name.alias("name"))
    mapped = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    slug = F.trim(F.regexp_replace(F.lower(F.regexp_replace("name", r"[^A-Za-z0-9_ \t\n\r-]", " ")), r"[-_ \t\n\r]+", " "))
    found = F.try_element_at(mapped(_KNOWN), slug)
    phrases = F.coalesce(F.try_element_at(mapped({k: "|".join(v) for k, v in TOPICS.items()}), found), F.trim("name"))
    long = F.size(F.filter(F.split(F.trim("name"), "[ \\t\\n\\r]+"), lambda w: w != "")) > 6
    return n.select("doc_id", F.coalesce(found, F.trim("name")).alias("topic"), phrases.alias("phrases"), found.isNotNull().alias("known"), long.alias("looks_like_sentence"))
