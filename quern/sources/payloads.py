"""Readers and writers of payloads: parallel arrays, JSON, XML, CSV, HTML, list files."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, tag: str) -> str:
    """A path of its own in the folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    On one machine, where none is named, a temporary folder is taken and removed at the end; a cluster without one is an error,
    since each executor would write to its own disk.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def filings(lists: DataFrame, keys: list[str], form: str, since: str, limit: int) -> DataFrame:
    """Rows (keys, form, day, acc) of parallel arrays, of one exact form since a date, the newest ``limit`` for each key."""
    from pyspark.sql import Window

    rows = lists.select(*keys, F.inline(F.arrays_zip("form", "day", "acc"))).where((F.col("form") == form) & (F.col("day") >= F.lit(since).cast("date")))
    newest = Window.partitionBy(*keys).orderBy(F.desc("day"), F.desc("acc"))
    return rows.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= limit).drop("k")


def universe(lines: DataFrame) -> DataFrame:
    """Distinct upper-case names of text lines (value) without comments and blanks."""
    name = F.upper(F.trim(F.split("value", "#")[0]))
    return lines.select(name.alias("ticker")).where("ticker <> ''").distinct()


def labelled_lines(lines: DataFrame) -> DataFrame:
    """(question, expected) of JSON lines (value); blank lines and those that begin with # are skipped."""
    text = lines.select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')")
    return text.select(F.inline(F.array(F.from_json("value", "question string, expected string"))))


def alias_map(lines: DataFrame) -> DataFrame:
    """(ticker, aliases) of a JSON object (value); keys that begin with _ and empty lists are dropped."""
    m = lines.select(F.explode(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.StringType())))).alias("ticker", "aliases"))
    return m.where(~F.startswith("ticker", F.lit("_")) & (F.size("aliases") > 0))


def price_payload(payload: Column) -> Column:
    """array<struct<d, o, h, l, c, v>> of a JSON object of dates with OHLCV strings; ascending by date."""
    bar = T.StructType([T.StructField(k, T.StringType()) for k in ("1. open", "2. high", "3. low", "4. close", "5. volume")])
    entries = F.map_entries(F.from_json(payload, T.MapType(T.StringType(), bar)))
    num = lambda x: x.cast("double")
    rows = F.transform(entries, lambda e: F.struct(e["key"].cast("date").alias("d"), num(e["value"]["1. open"]).alias("o"), num(e["value"]["2. high"]).alias("h"), num(e["value"]["3. low"]).alias("l"), num(e["value"]["4. close"]).alias("c"), e["value"]["5. volume"].cast("long").alias("v")))
    return F.array_sort(rows)


def tone_histogram(payload: Column) -> Column:
    """struct<tone, label> of a JSON list of bins and counts: the mean by count to 3 digits, and what it means; bins without a count do not matter."""
    bins = F.filter(F.from_json(payload, "array<struct<bin:double,count:double>>"), lambda b: b["count"] > 0)
    add = lambda f: F.aggregate(bins, F.lit(0.0), lambda s, b: s + f(b))
    tone = F.round(F.try_divide(add(lambda b: b["bin"] * b["count"]), add(lambda b: b["count"])), 3)
    return F.struct(tone.alias("tone"), F.when(tone > 1, "positive").when(tone < -1, "negative").when(tone.isNotNull(), "neutral").alias("label"))


def cik_map(payload: Column) -> Column:
    """array<struct<ticker, cik>> of a JSON map of companies; rows without ticker or number are dropped."""
    rows = F.map_values(F.from_json(payload, "map<string, struct<cik_str:long,ticker:string,title:string>>"))
    good = F.filter(rows, lambda r: r["cik_str"].isNotNull() & (F.trim(F.coalesce(r["ticker"], F.lit(""))) != ""))
    return F.transform(good, lambda r: F.struct(F.upper(F.trim(r["ticker"])).alias("ticker"), F.lpad(r["cik_str"].cast("string"), 10, "0").alias("cik")))


#: Article layouts by vendor (fixed values): where the list lies, fields of title, url, source, time and summary; of several the first that is not empty.
VENDORS = {
    "alpha_vantage": ("feed", "title", "url", ["source"], "time_published", ["summary"]),
    "finnhub": ("", "headline", "url", ["source"], "datetime", ["summary"]),
    "fmp": ("", "title", "url", ["site", "publisher"], "publishedDate", ["text"]),
    "gdelt_doc": ("articles", "title", "url", ["domain"], "seendate", []),
    "guardian": ("response.results", "webTitle", "webUrl", [], "webPublicationDate", ["fields.trailText"]),
    "marketaux": ("data", "title", "url", ["source"], "published_at", ["description", "snippet"]),
    "newsdata": ("results", "title", "link", ["source_id"], "pubDate", ["description"]),
    "thenewsapi": ("data", "title", "url", ["source"], "published_at", ["description", "snippet"]),
    "tiingo": ("", "title", "url", ["source"], "publishedDate", ["description"]),
}
#: Sources of articles that name none, where it is not the vendor's name.
SOURCES = {"guardian": "The Guardian"}


def _published(at: Column, vendor: str) -> Column:
    """The time of an article; null where it cannot be read."""
    if vendor == "finnhub":
        return F.timestamp_seconds(F.nullif(at.try_cast("long"), F.lit(0)))
    if vendor in ("alpha_vantage", "gdelt_doc"):
        return F.try_to_timestamp(F.regexp_replace(F.trim(at), "T|Z$", ""), F.lit("yyyyMMddHHmmss"))
    return F.when(at.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(at))


def _window(articles: Column, start: str | None, end: str | None, top_n: int | None) -> Column:
    """The articles of the days from ``start`` to ``end``, the first ``top_n`` of them."""
    day = lambda a: F.to_date(a["published"])
    if start:
        articles = F.filter(articles, lambda a: day(a) >= F.lit(start).cast("date"))
    if end:
        articles = F.filter(articles, lambda a: day(a) <= F.lit(end).cast("date"))
    return F.slice(articles, 1, top_n) if top_n else articles


def vendor_articles(payload: Column, vendor: str, start: str | None = None, end: str | None = None, language: str | None = None, top_n: int | None = None) -> Column:
    """array<struct<title, url, source, published, summary, sentiment, topics>> of a vendor's JSON.

    Rows without title, url or a readable time are dropped, as are those outside the days from
    ``start`` to ``end`` and, where the vendor tells it, of another language; at most ``top_n`` stay.
    A payload of another form gives null or an empty list.
    """
    at, title, url, source, when, summary = VENDORS[vendor]
    texts = F.from_json(F.get_json_object(payload, f"$.{at}") if at else payload, "array<string>")
    rows = F.transform(texts, lambda x: F.from_json(x, "map<string,string>"))

    def field(r: Column, name: str) -> Column:
        head, _, rest = name.partition(".")
        return F.nullif(F.get_json_object(r[head], f"$.{rest}") if rest else r[head], F.lit(""))

    def one(r: Column) -> Column:
        return F.struct(
            field(r, title).alias("title"), field(r, url).alias("url"), F.coalesce(*[field(r, s) for s in source], F.lit(SOURCES.get(vendor, vendor))).alias("source"), _published(r[when], vendor).alias("published"),
            F.coalesce(*[field(r, s) for s in summary], F.lit(None).cast("string")).alias("summary"), (r["overall_sentiment_score"].try_cast("double") if vendor == "alpha_vantage" else F.lit(None).cast("double")).alias("sentiment"),
            F.array_compact(F.array(field(r, "category") if vendor == "finnhub" else F.lit(None).cast("string"))).alias("topics"),
        )

    if language and vendor == "gdelt_doc":
        rows = F.filter(rows, lambda r: F.lower(F.trim(r["language"])) == language.strip().lower())
    good = F.filter(F.transform(rows, one), lambda a: a["title"].isNotNull() & a["url"].isNotNull() & a["published"].isNotNull())
    return _window(good, start, end, top_n)


RSS = "channel struct<item:array<struct<title:string,link:string,pubDate:string,source:struct<_VALUE:string,_url:string>>>>"


def rss_articles(xml: Column, start: str | None = None, end: str | None = None, top_n: int | None = None) -> Column:
    """array<struct<title, url, source, published>> of an RSS document; items without title, link or a readable time are dropped, as are those outside the days."""
    rows = F.from_xml(xml, RSS, {"rowTag": "rss", "valueTag": "_VALUE", "attributePrefix": "_", "mode": "PERMISSIVE"})["channel"]["item"]
    day = lambda s: F.try_to_timestamp(F.regexp_extract(s, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
    there = lambda x: F.nullif(x, F.lit(""))
    all_ = F.transform(rows, lambda r: F.struct(there(r["title"]).alias("title"), there(r["link"]).alias("url"), F.coalesce(there(r["source"]["_VALUE"]), F.lit("Google News")).alias("source"), day(r["pubDate"]).alias("published")))
    return _window(F.filter(all_, lambda a: a["title"].isNotNull() & a["url"].isNotNull() & a["published"].isNotNull()), start, end, top_n)


#: What a transaction is read into; texts are cast in SQL.
_OWNED = {n: pa.string() for n in ("ticker", "transaction_date", "code", "ad", "shares", "price", "title", "owned_after")} | {"is_derivative": pa.bool_(), "planned": pa.bool_()}
_PLANNED = re.compile(r"10b5[\s-]?1", re.IGNORECASE | re.ASCII)


def _at(el: ElementTree.Element | None, name: str, below: str) -> str | None:
    """The trimmed text of ``el``'s element ``name`` / ``below``, or None where there is none."""
    el = el.find(name) if el is not None else None
    text = el.findtext(below) if el is not None else None
    return text and text.strip(" \t\r\n") or None


def _owned(xml: str | None) -> Iterator[tuple]:
    """The transactions (_OWNED) of an ownership document that have a code, shares and a direction."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return
    if "xmlns" in xml:
        for el in root.iter():
            el.tag = el.tag.rpartition("}")[2]
    ticker, title = _at(root, "issuer", "issuerTradingSymbol"), _at(root.find("reportingOwner"), "reportingOwnerRelationship", "officerTitle")
    always = root.findtext("aff10b5One", "").strip().lower() in ("1", "true")
    notes = {n.get("id") for n in root.iterfind("footnotes/footnote") if n.text and _PLANNED.search(n.text)}
    for tables, rows, derivative in (("nonDerivativeTable", "nonDerivativeTransaction", False), ("derivativeTable", "derivativeTransaction", True)):
        for table in root.findall(tables):
            for t in table.findall(rows):
                code, amounts = _at(t, "transactionCoding", "transactionCode"), t.find("transactionAmounts")
                shares, ad = _at(amounts, "transactionShares", "value"), _at(amounts, "transactionAcquiredDisposedCode", "value")
                if code and shares and ad:
                    planned = always or bool(notes) and any(n.get("id") in notes for n in t.find("transactionCoding").findall("footnoteId"))
                    after = _at(t.find("postTransactionAmounts"), "sharesOwnedFollowingTransaction", "value")
                    yield ticker, _at(t, "transactionDate", "value"), code, ad, shares, _at(amounts, "transactionPricePerShare", "value"), title, after, derivative, planned


def _owned_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = [], []
        for k, xml in enumerate(batch.column("xml").to_pylist()):
            found = [*_owned(xml)]
            rows += found
            at += [k] * len(found)
        columns = zip(*rows, strict=True) if rows else [()] * len(_OWNED)
        read = [pa.array(c, kind) for c, kind in zip(columns, _OWNED.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("filing_date").take(pa.array(at, pa.int64())), *read], ["filing_date", *_OWNED])


def ownership_transactions(docs: DataFrame) -> DataFrame:
    """Transactions of ownership XML documents (filing_date, xml); both tables, rows without code, shares or direction dropped.

    A trade is planned if the document says so or one of its footnotes names Rule 10b5-1.  A
    document that does not parse gives no rows.  Documents are parsed in Arrow batches.
    """
    day = docs.schema["filing_date"].dataType.simpleString()
    kinds = ", ".join(f"{n} {'string' if kind == pa.string() else 'boolean'}" for n, kind in _OWNED.items())
    rows = docs.select("filing_date", "xml").mapInArrow(_owned_batches, f"filing_date {day}, {kinds}")
    number = lambda c: F.col(c).try_cast("double").alias(c)
    out = rows.select("ticker", "filing_date", F.left("transaction_date", F.lit(10)).try_cast("date").alias("transaction_date"), "code", "ad", number("shares"), number("price"), "is_derivative", "title", number("owned_after"), "planned")
    return out.where("shares is not null")


def csv_round_trip(df: DataFrame) -> DataFrame:
    """``df`` written as CSV and read under its own schema; an absent folder would read as an empty table of that schema."""
    path = scratch(df.sparkSession, "csv")
    df.write.mode("overwrite").option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def json_log(df: DataFrame) -> DataFrame:
    """``df`` appended twice to a log of JSON lines, and the log read past blank and broken lines."""
    path = scratch(df.sparkSession, "log")
    for _ in range(2):
        df.write.mode("append").json(path)
    df.sparkSession.createDataFrame([("",), ("{broken",)], "value string").write.mode("append").text(path)
    return df.sparkSession.read.schema(df.schema).option("mode", "DROPMALFORMED").json(path)


#: Elements whose text is not shown, elements that end a line, and what a head may hold (fixed values).
HIDDEN = {"script", "style", "head", "title", "noscript", "ix:hidden", "ix:header", "ix:references", "ix:resources"}
BLOCKS = {"p", "div", "br", "hr", "li", "tr", "table", "section", "article", "blockquote", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6"}
HEAD_HOLDS = {"title", "meta", "link", "script", "style", "base", "noscript", "template"}
#: Elements that may stay open, by what their next one stands in.
_ITEMS = {"li": ("ul", "ol"), "tr": ("table",)}


class _Text(HTMLParser):
    """Collects shown text with a line's end behind each block, also behind those that HTML closes by itself."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden: list[str] = []  # open elements that are not shown
        self.paragraph = False
        self.items = {"li": [False], "tr": [False]}  # whether an item is open in each open list or table

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if "head" in self.hidden and tag not in HEAD_HOLDS:  # a head ends where something else begins
            self.hidden.clear()
        if tag in HIDDEN:
            self.hidden.append(tag)
        if tag == "br" or tag == "hr" or tag in BLOCKS and self.paragraph:
            self.out.append("\n")
            self.paragraph = self.paragraph and tag == "br"
        self.paragraph |= tag == "p"
        for item, around in _ITEMS.items():
            if tag in around:
                self.items[item].append(False)
            elif tag == item:
                if self.items[item][-1]:
                    self.out.append("\n")
                self.items[item][-1] = True

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]
        if tag in BLOCKS:
            self.out.append("\n")
        self.paragraph &= tag != "p"
        for item, around in _ITEMS.items():
            if tag in around and len(self.items[item]) > 1:
                self.items[item].pop()
            elif tag == item:
                self.items[item][-1] = False

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(data)


def html_text(content: str | None) -> str:
    """Shown text of HTML, white space collapsed, one line for each block; text without tags keeps its lines."""
    if not content:
        return ""
    parser = _Text()
    parser.feed(content)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.out).split("\n"))
    return "\n".join(line for line in lines if line)


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        text = [html_text(h) for h in pdf["html"]]
        yield pd.DataFrame({"page_id": pdf["page_id"], "text": text, "n_lines": [len(t.split("\n")) if t else 0 for t in text]})


def page_texts(pages: DataFrame, kind: str = "long") -> DataFrame:
    """(page_id, text, n_lines) of HTML pages, parsed in Arrow batches; ``kind`` is the type of their ids."""
    return pages.select("page_id", "html").mapInPandas(_texts, f"page_id {kind}, text string, n_lines long")


def with_texts(rows: DataFrame) -> DataFrame:
    """``rows`` with text and n_lines of their ``html`` in its place."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [html_text(h) for h in pdf["html"]]
            yield pdf.drop(columns="html").assign(text=text, n_lines=[len(t.split("\n")) if t else 0 for t in text])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("html").schema.fields)
    return rows.mapInPandas(texts, f"{kept}, text string, n_lines long")


def filing_folders(spark: SparkSession, base: str, ticker: str | None = None) -> DataFrame:
    """(folder, ticker, form, day, metadata map<string,string>, text) of folders base/sec/TICKER/FORM/DAY that hold filing.html.

    Files are found and read by tasks; the metadata.json beside a filing joins by its folder, and is null where there is none.
    """
    root = f"{base.rstrip('/')}/sec" + (f"/{ticker}" if ticker else "")

    def files(name: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
        return found.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), F.decode("content", "utf-8").alias("body"))

    meta = files("metadata.json").select("folder", F.from_json("body", "map<string,string>").alias("metadata"))
    part = lambda k: F.element_at(F.split("folder", "/"), k)
    rows = files("filing.html").join(meta, "folder", "left").select("folder", part(-3).alias("ticker"), part(-2).alias("form"), part(-1).alias("day"), "metadata", F.col("body").alias("html"))

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(text=[html_text(h) for h in pdf["html"]]).drop(columns="html")

    return rows.mapInPandas(texts, "folder string, ticker string, form string, day string, metadata map<string,string>, text string")
