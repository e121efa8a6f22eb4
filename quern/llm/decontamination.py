"""Benchmark decontamination (operator 13): a prefix-filtered set join, DataFrame functions alone.

An item is the set of its windows of WINDOW words, a window the set of its SHINGLE-word shingles.  A document holds a
window only if it holds each of its shingles, so one necessary token is enough to meet: shingles are counted
over all documents and each window is looked up by its rarest one (windows with a shingle that no document
holds go at once).  Where the two meet, the token's place in the window fixes where the window would start; it must
lie within the document (positional and length bounds), and the words there are then compared one by one.

Both passes over the documents explode words inside one code-generated stage, against a broadcast block of the benchmark
of counted size; of a document only what is proven to occur leaves its task.  A benchmark of more tokens
takes more passes, a block each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import HUBS, unused, written

WINDOW, SHINGLE = 10, 3
#: Shingles, or windows, of the benchmark that one pass over the documents looks up; both are broadcast.
BLOCK = 200_000
#: Windows that may share a token; more of them are looked up by all their words, so common shingles bring no false meetings.
SHARED = 64
#: What lies between words, A-Z in upper or lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Characters outside A-Z that lower() might change; texts without them take the faster of two equal ways.
CASED = r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; null has none."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(text.rlike(CASED), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))
    return _split(lower)


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, BETWEEN), "")


def _token(ws: Column, at: Column, width: int) -> Column:
    """Hash of ``width`` words from place ``at`` (from 0)."""
    if width <= SHINGLE:
        return F.xxhash64(*(F.get(ws, at + k) for k in range(width)))
    return F.xxhash64(F.slice(ws, at + 1, width))


def _tokens(ws: Column, at: Column, widths: list[int]) -> Column:
    """The tokens of all widths at a place, as the column ``token``."""
    if len(widths) == 1:
        return _token(ws, at, widths[0]).alias("token")
    return F.explode(F.array(*(_token(ws, at, w) for w in widths))).alias("token")


def _named(*cols: Column | str) -> tuple[Column, Column]:
    """128 bits that name a value, in two halves."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)


def _text_name() -> tuple[Column, Column]:
    h, g = _named(F.coalesce("text", F.lit("")))
    return h.alias("th"), g.alias("tg")


def item_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (words, length, ih, ig) of (item_id, text), and the sets of items (ih, ig, items) that hold the same ones.

    An item of fewer words than WINDOW is one window, one without words has none.  Rows of
    one item_id are one item, those of null one whose name is empty.
    """
    ws = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("ws")).where("size(ws) > 0")
    length = F.least(F.size("ws"), F.lit(WINDOW))
    cut = ws.select("item", "ws", length.alias("length"), F.explode(F.sequence(F.lit(0), F.size("ws") - length)).alias("at"))
    h, g = _named("words")
    each = cut.select("item", "length", F.slice("ws", F.col("at") + 1, F.col("length")).alias("words")).withColumns({"h": h, "g": g})
    grouped = each.groupBy("h", "g").agg(F.first("words").alias("words"), F.first("length").alias("length"), F.sort_array(F.collect_set("item")).alias("items"))
    h, g = _named("items")
    grouped = written(grouped.select("words", "length", "items", h.alias("ih"), g.alias("ig")), "windows")
    return grouped.select("words", "length", "ih", "ig"), grouped.groupBy("ih", "ig").agg(F.first("items").alias("items"))


def _in_blocks(side: DataFrame, work) -> DataFrame:
    """The union of ``work`` over blocks of ``side`` (a stored table with a column token) of at most about BLOCK rows."""
    n = -(-side.count() // BLOCK) or 1
    block = F.pmod(F.xxhash64(F.lit("block"), "token"), F.lit(n))
    return reduce(DataFrame.unionByName, (work(F.broadcast(side.where(block == k) if n > 1 else side)) for k in range(n)))


def _widths(side: DataFrame) -> list[int]:
    return sorted(r[0] for r in side.select("width").distinct().collect()) or [SHINGLE]


def _exploded(texts: DataFrame) -> DataFrame:
    """A row for each place of the words; outer, since Spark would otherwise split each text once more to leave out empty ones."""
    return texts.select("*", F.posexplode_outer("ws").alias("at", "word"))


def _prefixes(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """The windows all of whose shingles occur in ``texts`` (ws), with token, width and offset of the rarest one."""
    width = F.least("length", F.lit(SHINGLE))
    placed = windows.select("*", width.alias("width"), F.explode(F.sequence(F.lit(0), F.col("length") - width)).alias("offset"))
    placed = placed.withColumn("token", F.xxhash64(F.slice("words", F.col("offset") + 1, F.col("width"))))
    tokens = written(placed.select("token", "width").distinct(), "tokens")
    at = _exploded(texts).select(_tokens(F.col("ws"), F.col("at"), _widths(tokens)))
    found = _in_blocks(tokens.select("token").distinct(), lambda block: at.join(block, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    found = written(found, "token-counts")
    ranked = placed.join(found, "token", "left")
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset"))
    rarest = ranked.groupBy("words", "length", "ih", "ig", "width").agg(best.alias("best")).where("best.n > 0")
    rarest = rarest.select("words", "length", "ih", "ig", "width", F.col("best.token").alias("token"), F.col("best.offset").alias("offset"))
    shared = rarest.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARED).select("token", F.lit(True).alias("shared"))
    rarest = rarest.join(shared, "token", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    whole = {"token": F.xxhash64("words"), "width": F.col("length"), "offset": F.lit(0)}
    return written(rarest.withColumns({c: F.when(F.col("shared"), v).otherwise(F.col(c)) for c, v in whole.items()}).drop("shared"), "prefixes")


def occurrences(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where windows of ``benchmark`` occur in the texts of ``docs``, and the items they come from.

    The first table has a row (th, tg, start, length, ih, ig) for each distinct text (named by 128 bits), place in words
    and window; the second one (ih, ig, items) for each set of items that share windows.  Both are stored.
    """
    windows, items = item_windows(benchmark)
    texts = docs.select(*_text_name(), words(F.col("text")).alias("ws"))
    prefixes = _prefixes(texts, windows)
    widths = _widths(prefixes)
    at = _exploded(texts).select("th", "tg", "ws", "at", _tokens(F.col("ws"), F.col("at"), widths))
    start = F.col("at") - F.col("offset")
    fits = (start >= 0) & (start + F.col("length") <= F.size("ws"))
    same = F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.col("length")) == F.col("words")

    def met(block: DataFrame) -> DataFrame:
        block = block.withColumnRenamed("token", "prefix")
        return at.join(block, (F.col("token") == F.col("prefix")) & fits & same).select("th", "tg", start.alias("start"), "length", "ih", "ig")

    return written(_in_blocks(prefixes, met).distinct(), "occurrences"), items


def contaminated_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(th, tg, n_hit, n_items, items_sha256) for each distinct text of ``docs`` that a window of ``benchmark`` occurs in.

    n_hit is the number of words that lie within any occurrence.  The list of a set of items is put together once for each set of sets that
    texts hold, not for each text.
    """
    found, items = occurrences(docs, benchmark)
    spans = found.groupBy("th", "tg", "start").agg((F.col("start") + F.max("length")).alias("end"))
    before = Window.partitionBy("th", "tg").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    hit = spans.withColumn("new", new).groupBy("th", "tg").agg(F.sum("new").cast("long").alias("n_hit"))
    sets = found.groupBy("th", "tg").agg(F.sort_array(F.collect_set(F.struct("ih", "ig"))).alias("sets"))
    h, g = _named("sets")
    sets = written(sets.select("th", "tg", "sets", h.alias("sh"), g.alias("sg")), "item-sets")
    parts = sets.groupBy("sh", "sg").agg(F.first("sets").alias("sets")).select("sh", "sg", F.explode("sets").alias("s")).select("sh", "sg", "s.ih", "s.ig")
    ids = F.sort_array(F.array_distinct(F.flatten(F.collect_list("items"))))
    lists = parts.join(items, ["ih", "ig"]).groupBy("sh", "sg").agg(ids.alias("ids"))
    lists = lists.select("sh", "sg", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    return sets.select("th", "tg", "sh", "sg").join(lists, ["sh", "sg"]).join(hit, ["th", "tg"]).select("th", "tg", "n_hit", "n_items", "items_sha256")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs`` (doc_id, text).

    A word is hit if it lies within any occurrence of WINDOW consecutive words of an item, or of a whole shorter item;
    items are those with such an occurrence, listed in string order.  Null and empty texts have no
    words; null and repeated doc_ids and repeated rows are rows of their own; an empty benchmark hits nothing; other
    columns do not matter.  A very long text is one value, as it is in its table.
    """
    count = F.size(_split(F.coalesce("text", F.lit("")))).cast("long")
    name = ["th", "tg"]
    rows = written(docs.select("doc_id", *_text_name(), count.alias("n_words")), "rows")
    hits = written(contaminated_texts(docs, benchmark), "hits")
    # texts of very many rows, fewer than HUBS, meet theirs without a shuffle
    hot = written(rows.groupBy(*name).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HUBS > rows.count()).select(*name), "hot")
    many = rows.join(F.broadcast(hot), name, "left_semi").join(F.broadcast(hits.join(F.broadcast(hot), name, "left_semi")), name, "left")
    rows = rows.join(F.broadcast(hot), name, "left_anti").join(hits, name, "left").unionByName(many)
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    nothing = F.sha2(F.lit(""), 256)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", nothing).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no window of ``benchmark`` occurs in, with all their columns."""
    h, g = _text_name()
    dh, dg = unused(docs, "dirty_h"), unused(docs, "dirty_g")
    dirty = contaminated_texts(docs, benchmark).select(F.col("th").alias(dh), F.col("tg").alias(dg))
    return docs.join(dirty, (h == F.col(dh)) & (g == F.col(dg)), "left_anti")


ORACLE = r"""
WITH rows_ AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), cut AS (
  SELECT item, ws, least(len(ws), 10) AS n, unnest(range(0, len(ws) - least(len(ws), 10) + 1)) AS p FROM items WHERE len(ws) > 0
), windows AS (
  SELECT DISTINCT item, n, array_to_string(ws[p + 1 : p + n], ' ') AS w FROM cut
), sizes AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT r, ws, unnest(range(0, len(ws))) AS p FROM rows_ WHERE len(ws) > 0
), texts AS (
  SELECT r, n, p, array_to_string(ws[p + 1 : p + n], ' ') AS w FROM places JOIN sizes ON p + n <= len(ws)
), found AS (
  SELECT t.r, t.p, t.n, w.item FROM texts t JOIN windows w ON t.n = w.n AND t.w = w.w
), hit AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS k FROM found) GROUP BY r
), listed AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(l.n_items, 0) AS n_items,
  coalesce(l.sha, sha256('')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM rows_ d LEFT JOIN hit h ON h.r = d.r LEFT JOIN listed l ON l.r = d.r
"""
