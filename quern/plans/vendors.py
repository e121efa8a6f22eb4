"""Queries over payloads of vendors: made from the tables in each vendor's layout, then read.

Their SQL does not parse: it says what the payloads were made from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import chunking
from quern.plans.base import query
from quern.sources import payloads, views
from quern.sources.views import BARS

START, END = "2024-01-03", "2024-01-20"
NAMES = list(payloads.VENDORS)

#: Events as articles: some lack title, url, source or summary, some have no time that can be read.
POSTS = """posts AS (SELECT event_id, user_id, date_trunc('second', ts) AS seen, CASE WHEN event_id % 7 <> 0 THEN event_type || ' ' || event_id END AS title, CASE WHEN event_id % 11 <> 0 THEN 'https://n.example/' || event_id ELSE '' END AS url,
  CASE WHEN event_id % 3 <> 0 THEN event_type END AS source, CASE WHEN event_id % 5 <> 0 THEN 'note ' || event_id ELSE '' END AS summary, event_id % 13 = 0 AS bad FROM events)"""
_GOOD = f"title IS NOT NULL AND url <> '' AND NOT bad AND CAST(seen AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'"
_AT = "strftime(seen, '%Y-%m-%d %H:%M:%S') AS published"


def posts(spark, sf_dir) -> DataFrame:
    """Lists of posts of a user's day; none is longer than that day."""
    i = F.col("event_id")
    text = i.cast("string")
    p = views.table(spark, sf_dir, "events").select(
        i, "user_id", F.date_trunc("second", "ts").alias("at"), F.when(i % 7 != 0, F.concat("event_type", F.lit(" "), text)).alias("title"), F.when(i % 11 != 0, F.concat(F.lit("https://n.example/"), text)).otherwise("").alias("url"),
        F.when(i % 3 != 0, F.col("event_type")).alias("source"), F.when(i % 5 != 0, F.concat(F.lit("note "), text)).otherwise("").alias("summary"), (i % 13 == 0).alias("bad"),
    )
    items = F.collect_list(F.struct("event_id", "at", "title", "url", "source", "summary", "bad"))
    return p.groupBy("user_id", F.to_date("at").alias("day")).agg(F.array_sort(items).alias("posts"))


def _time(p: Column, vendor: str) -> Column:
    if vendor == "finnhub":
        return F.when(~p["bad"], F.unix_timestamp(p["at"]))
    form = {"alpha_vantage": "yyyyMMdd'T'HHmmss", "gdelt_doc": "yyyyMMdd'T'HHmmss'Z'", "guardian": "yyyy-MM-dd'T'HH:mm:ss'Z'"}.get(vendor, "yyyy-MM-dd HH:mm:ss")
    return F.when(p["bad"], F.lit("soon")).otherwise(F.date_format(p["at"], form))


def layout(items: Column, vendor: str) -> Column:
    """The JSON of ``items`` as a vendor sends it; the last of its fields for source and summary hold them."""
    at, title, url, source, when, summary = payloads.VENDORS[vendor]

    def one(p: Column) -> Column:
        parts = [p["title"].alias(title), p["url"].alias(url), _time(p, vendor).alias(when)]
        parts += [p["source"].alias(source[-1])] if source else []
        for name in summary[-1:]:
            head, _, rest = name.partition(".")
            parts.append((F.struct(p["summary"].alias(rest)) if rest else p["summary"]).alias(head))
        return F.struct(*parts)

    out = F.transform(items, one)
    for key in reversed(at.split(".")) if at else []:
        out = F.struct(out.alias(key))
    return F.to_json(out)


@query(
    f"""WITH {POSTS}, v AS (SELECT *, {NAMES!r}[user_id % {len(NAMES)} + 1] AS vendor FROM posts)
    SELECT vendor, title, url, CASE vendor WHEN 'guardian' THEN 'The Guardian' ELSE coalesce(source, vendor) END AS source, {_AT}, CASE WHEN vendor <> 'gdelt_doc' THEN nullif(summary, '') END AS summary FROM v WHERE {_GOOD}"""
)
def vendor_articles(spark, sf_dir):
    """Articles of nine vendors' JSON layouts within a window of days; each user's days come from one vendor."""
    p = posts(spark, sf_dir).withColumn("vendor", F.element_at(F.array(*map(F.lit, NAMES)), (F.col("user_id") % len(NAMES) + 1).cast("int")))
    of = lambda make: F.coalesce(*[F.when(F.col("vendor") == v, make(v)) for v in NAMES])
    sent = p.select("vendor", of(lambda v: layout(F.col("posts"), v)).alias("payload"))
    rows = sent.select("vendor", F.inline(of(lambda v: payloads.vendor_articles(F.col("payload"), v, START, END))))
    return rows.select("vendor", "title", "url", "source", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"), "summary")


@query(f"WITH {POSTS} SELECT title, url, coalesce(source, 'Google News') AS source, {_AT} FROM posts WHERE {_GOOD}")
def rss_articles(spark, sf_dir):
    """Items of RSS documents within a window of days; an item without a title does not shift the others."""
    tag = lambda name, x: F.coalesce(F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>")), F.lit(""))
    when = lambda p: F.when(p["bad"], F.lit("soon")).otherwise(F.date_format(p["at"], "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    item = lambda p: F.concat(F.lit("<item>"), tag("title", p["title"]), tag("link", p["url"]), tag("pubDate", when(p)), F.coalesce(F.concat(F.lit('<source url="https://n.example">'), p["source"], F.lit("</source>")), F.lit("")), F.lit("</item>"))
    xml = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("posts", item), ""), F.lit("</channel></rss>"))
    rows = posts(spark, sf_dir).select(xml.alias("xml")).select(F.inline(payloads.rss_articles(F.col("xml"), START, END)))
    return rows.select("title", "url", "source", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published"))


@query(f"WITH {BARS} SELECT sym, d, round(o, 8) AS o, round(h, 8) AS h, round(l, 8) AS l, round(c, 8) AS c, v FROM bars")
def price_payload(spark, sf_dir):
    """Daily bars read from JSON objects of dates, one for each symbol and year."""
    names = {"o": "1. open", "h": "2. high", "l": "3. low", "c": "4. close", "v": "5. volume"}
    day = F.struct(F.col("d").cast("string").alias("d"), F.struct(*[F.col(k).cast("string").alias(n) for k, n in names.items()]).alias("bar"))
    sent = views.bars(spark, sf_dir).groupBy("sym", F.year("d").alias("y")).agg(F.to_json(F.map_from_entries(F.collect_list(day))).alias("payload"))
    rows = sent.select("sym", F.inline(payloads.price_payload(F.col("payload"))))
    return rows.select("sym", "d", *[F.round(k, 8).alias(k) for k in "ohlc"], "v")


def _in_parts(spark, sf_dir, key: Column, value: Column) -> DataFrame:
    """JSON objects of the suppliers, a thousand ids each at most."""
    s = views.table(spark, sf_dir, "supplier")
    return s.groupBy(F.floor(F.col("s_suppkey") / 1000)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))).alias("value"))


@query("SELECT upper(s_name) AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik FROM supplier WHERE s_suppkey % 4 <> 0")
def cik_map(spark, sf_dir):
    """Tickers and ten-digit numbers of company maps; companies with a blank ticker are dropped."""
    i = F.col("s_suppkey")
    company = F.struct(i.alias("cik_str"), F.when(i % 4 != 0, F.concat(F.lit(" "), F.lower("s_name"), F.lit(" "))).otherwise(" ").alias("ticker"), F.col("s_name").alias("title"))
    return _in_parts(spark, sf_dir, i.cast("string"), company).select(F.inline(payloads.cik_map(F.col("value"))))


@query("SELECT s_name AS ticker, lower(s_name) || '|' || s_nationkey AS aliases FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0")
def alias_map(spark, sf_dir):
    """Aliases of each ticker of JSON objects; keys that begin with _ and empty lists are dropped."""
    i = F.col("s_suppkey")
    key = F.concat(F.when(i % 5 == 0, "_").otherwise(""), F.col("s_name"))
    names = F.when(i % 7 != 0, F.array(F.lower("s_name"), F.col("s_nationkey").cast("string"))).otherwise(F.array().cast("array<string>"))
    return payloads.alias_map(_in_parts(spark, sf_dir, key, names)).select("ticker", F.array_join("aliases", "|").alias("aliases"))


@query(
    """WITH h AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id % 21 - 10 AS bin, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, day, round(sum(bin * n) / CAST(sum(n) AS DOUBLE), 3) AS tone FROM h GROUP BY user_id, day)
    SELECT *, CASE WHEN tone > 1 THEN 'positive' WHEN tone < -1 THEN 'negative' ELSE 'neutral' END AS label FROM t"""
)
def tone_histogram(spark, sf_dir):
    """Mean tone and its label of each user's days, from JSON histograms; bins without a count do not matter."""
    e = views.table(spark, sf_dir, "events")
    h = e.groupBy("user_id", F.to_date("ts").alias("day"), (F.col("event_id") % 21 - 10).alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    bins = F.array_append(F.collect_list(F.struct("bin", "count")), F.struct(F.lit(99).cast("long").alias("bin"), F.lit(0).cast("long").alias("count")))
    tone = payloads.tone_histogram(F.col("payload"))
    return h.groupBy("user_id", "day").agg(F.to_json(bins).alias("payload")).select("user_id", "day", F.inline(F.array(tone)))


@query(
    """SELECT 'T' || o_custkey AS ticker, CAST(o_orderdate AS DATE) AS filing_date, CAST(l_shipdate AS DATE) AS transaction_date, l_returnflag AS code, CASE WHEN l_linestatus = 'O' THEN 'A' ELSE 'D' END AS ad, round(l_quantity, 6) AS shares, round(l_extendedprice, 6) AS price, l_linenumber % 2 = 0 AS is_derivative,
    o_orderkey % 10 = 0 OR (l_linenumber % 3 = 0 AND o_orderkey % 3 = 0) AS planned FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber % 7 <> 0"""
)
def ownership_transactions(spark, sf_dir):
    """Transactions of ownership XML documents, one document for each order; those without a code are dropped."""
    el = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    value = lambda name, x: el(name, el("value", x.cast("string")))

    def transaction(kind: str, t: Column) -> Column:
        n = t["l_linenumber"]
        code = F.when(n % 7 != 0, el("transactionCode", t["l_returnflag"])).otherwise("")
        note = F.when(n % 3 == 0, '<footnoteId id="F1"/>').otherwise('<footnoteId id="F2"/>')
        amounts = F.concat(value("transactionShares", t["l_quantity"]), value("transactionPricePerShare", t["l_extendedprice"]), value("transactionAcquiredDisposedCode", F.when(t["l_linestatus"] == "O", "A").otherwise("D")))
        return el(kind, F.concat(value("transactionDate", F.to_date(t["l_shipdate"])), el("transactionCoding", F.concat(code, note)), el("transactionAmounts", amounts)))

    # rows are grouped as they are; XML would be ten times as much to shuffle
    line = F.struct("l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", "l_linestatus", "l_shipdate")
    lines = views.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(line).alias("lines"))
    docs = lines.join(views.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    table = lambda kind, rest: F.array_join(F.transform(F.filter("lines", lambda t: t["l_linenumber"] % 2 == rest), lambda t: transaction(kind, t)), "")
    rule = F.when(F.col("o_orderkey") % 3 == 0, "sold under a Rule 10b5-1 plan").otherwise("sold at several prices")
    notes = F.concat(F.lit('<footnotes><footnote id="F1">'), rule, F.lit('</footnote><footnote id="F2">held by a trust</footnote></footnotes>'))
    parts = [el("issuer", el("issuerTradingSymbol", F.concat(F.lit("T"), F.col("o_custkey").cast("string")))), el("aff10b5One", F.when(F.col("o_orderkey") % 10 == 0, "1").otherwise("0")), el("nonDerivativeTable", table("nonDerivativeTransaction", 1)), el("derivativeTable", table("derivativeTransaction", 0)), notes]
    rows = payloads.ownership_transactions(docs.select(F.to_date("o_orderdate").alias("filing_date"), el("ownershipDocument", F.concat(*parts)).alias("xml")))
    return rows.select("ticker", "filing_date", "transaction_date", "code", "ad", F.round("shares", 6).alias("shares"), F.round("price", 6).alias("price"), "is_derivative", "planned")


_RANK = "CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE 4 END"


@query(f"SELECT event_id, user_id, {_RANK} AS provider_rank, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY {_RANK}, event_id) AS place FROM events")
def provider_merge(spark, sf_dir):
    """All providers' rows of each user's day, one provider after the other by priority; nothing is dropped."""
    e = views.table(spark, sf_dir, "events").withColumn("provider_rank", F.expr(_RANK))
    order = Window.partitionBy("user_id", F.to_date("ts")).orderBy("provider_rank", "event_id")
    return e.select("event_id", "user_id", "provider_rank", F.row_number().over(order).alias("place"))


@query("SELECT p_name AS question, p_brand AS expected FROM part WHERE p_partkey % 6 NOT IN (0, 1)")
def labelled_lines(spark, sf_dir):
    """Labelled examples of JSON lines; blank lines and comments are skipped."""
    i = F.col("p_partkey")
    example = F.to_json(F.struct(F.col("p_name").alias("question"), F.col("p_brand").alias("expected")))
    lines = views.table(spark, sf_dir, "part").select(F.when(i % 6 == 0, F.concat(F.lit("  # "), example)).when(i % 6 == 1, "  ").otherwise(F.concat(F.lit(" "), example)).alias("value"))
    return payloads.labelled_lines(lines)


@query("SELECT o_custkey, arg_min(1 + o_orderkey % 60, row(abs(1 + o_orderkey % 60 - 20), o_orderkey)) AS horizon FROM orders GROUP BY o_custkey")
def headline_forecast(spark, sf_dir):
    """Of each customer's forecasts the one whose horizon is nearest to 20 days, the first of equals."""
    h = F.col("o_orderkey") % 60 + 1
    return views.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by(h, F.struct(F.abs(h - 20), "o_orderkey")).alias("horizon"))


_LABELS = ["Item 1", "ITEM 7A.", "item 2.01 ", "Item 1. Business", "Items 3", "Item 123"]


@query(f"SELECT p_partkey, {_LABELS!r}[p_partkey % 6 + 1] AS label, p_partkey % 6 < 3 AS bare FROM part")
def bare_header(spark, sf_dir):
    """Whether a section's label is an item's number and nothing else."""
    label = F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return views.table(spark, sf_dir, "part").select("p_partkey", label.alias("label")).withColumn("bare", chunking.bare_header(F.col("label")))
