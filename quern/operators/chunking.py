"""Sections, word windows, span matches and metadata conditions of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.dedupe import stored
from quern.operators.requests import section_code

#: Spans, or words of spans, that are looked for in each text of a task at once; rows of words that are told to all tasks.
TOLD, MOST_TOLD = 4096, 200_000
_SPACE = "[ \\t\\n\\r\\f\\x0B]+"
#: Words for a token; fewest words of a chunked text; fewest of one under a bare header.
WORDS_PER_TOKEN, LEAST_WORDS, STUB_WORDS = 0.75, 15, 25


def words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def window_sizes(chunk_tokens: int, overlap: float) -> tuple[int, int]:
    """Words of a window, and words from one window to the next."""
    target = max(1, round(chunk_tokens * WORDS_PER_TOKEN))
    return target, max(1, target - min(max(0, round(target * overlap)), target - 1))


def chunks(docs: DataFrame, chunk_tokens: int = 900, overlap: float = 0.15) -> DataFrame:
    """(doc_id, lang, source, chunk_index, chunk_id, n_words, text): word windows until one reaches the end; short texts give none."""
    target, step = window_sizes(chunk_tokens, overlap)
    w = docs.where("text is not null").select("doc_id", "lang", "source", words(F.col("text")).alias("w")).where(F.size("w") >= LEAST_WORDS)
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - target) / step)).cast("int")
    c = w.select("doc_id", "lang", "source", "w", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    part = F.slice("w", F.col("k") * step + 1, F.lit(target))
    return c.select("doc_id", "lang", "source", F.col("k").cast("long").alias("chunk_index"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("k").cast("string")).alias("chunk_id"), F.size(part).cast("long").alias("n_words"), F.array_join(part, " ").alias("text"))


def section_chunks(docs: DataFrame, chunk_tokens: int = 900, overlap: float = 0.15) -> DataFrame:
    """(doc_id, chunk_index, chunk_id, section, n_words, text): word windows of each section of ``docs`` (doc_id, text), numbered through a document.

    Windows never cross sections.  Sections of fewer than LEAST_WORDS words give none, nor do those under a bare item header of fewer than STUB_WORDS, which are
    lines of a table of contents.  A section without a label has NULL.  All of a document's windows are made in its own row, so no rows move.
    """
    target, step = window_sizes(chunk_tokens, overlap)
    cut = F.transform(sections(F.col("text")), lambda s: F.struct(s["label"].alias("label"), words(s["body"]).alias("w")))
    kept = F.filter(cut, lambda s: (F.size(s["w"]) >= LEAST_WORDS) & ~(bare_header(s["label"]) & (F.size(s["w"]) < STUB_WORDS)))
    last = lambda s: F.greatest(F.lit(0), F.ceil((F.size(s["w"]) - target) / step)).cast("int")
    windows = F.flatten(F.transform(kept, lambda s: F.transform(F.sequence(F.lit(0), last(s)), lambda k: F.struct(F.nullif(s["label"], F.lit("")).alias("section"), F.slice(s["w"], k * step + 1, F.lit(target)).alias("w")))))
    c = docs.where("text is not null").select("doc_id", F.posexplode(windows).alias("k", "c"))
    name = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("k").cast("string"))
    return c.select("doc_id", F.col("k").cast("long").alias("chunk_index"), name.alias("chunk_id"), "c.section", F.size("c.w").cast("long").alias("n_words"), F.array_join("c.w", " ").alias("text"))


def of_sections(chunks: DataFrame, names: list[str], form: str = "10-K") -> DataFrame:
    """``chunks`` (form, section, ...) of one form whose section has the item code of any of ``names``; all of the form if no name has a code.

    The form matters: another form's items have the same codes and mean something else.
    """
    rows = chunks.where(F.col("form") == form)
    wanted = F.array_compact(F.array(*(section_code(F.lit(n)) for n in names))) if names else F.array().cast("array<string>")
    return rows.where((F.size(wanted) == 0) | F.coalesce(F.array_contains(wanted, section_code(F.col("section"))), F.lit(False)))


def matching(docs: DataFrame, ticker: str | None = None, sections: list[str] | None = None, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows that meet all the conditions given; a NULL section meets none."""
    if ticker is not None:
        docs = docs.where(F.col("source") == ticker)
    if sections:
        docs = docs.where(F.col("lang").isin(sections))
    if low is not None:
        docs = docs.where(F.col("doc_id") >= low)
    if high is not None:
        docs = docs.where(F.col("doc_id") <= high)
    return docs


_HEADER = r"(?i)^Item\s+\d{1,2}(?:\.\d{1,2}|[A-Za-z])?\b"


def sections(text: Column) -> Column:
    """array<struct<label, body>>: a text cut at lines that begin an item; what stands before is the Preamble.

    Labels are a header's line, at most 120 characters; bodies hold their header.  A text without items is one section without a label.
    """
    parts = F.filter(F.split(F.concat(F.lit("\n"), text), r"(?im)\n(?=[ \t]*Item\s+\d{1,2}(?:\.\d{1,2}|[A-Za-z])?\b)"), lambda p: F.trim(p) != "")
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    item = lambda p: p.rlike(_HEADER)
    label = lambda p: F.when(item(p), F.substring(F.trim(F.substring_index(p, "\n", 1)), 1, 120)).when(F.exists(trimmed, item), F.lit("Preamble")).otherwise(F.lit(""))
    return F.transform(trimmed, lambda p: F.struct(label(p).alias("label"), p.alias("body")))


def bare_header(label: Column) -> Column:
    """Whether a label is an item's number and nothing else."""
    return label.rlike(r"(?i)^Item\s+\d{1,2}(?:\.\d{1,2}|[A-Za-z])?\.?\s*$")


def _told(words: DataFrame) -> DataFrame:
    """``words``, told to all tasks where they are few."""
    return F.broadcast(words) if words.count() <= MOST_TOLD else words


def span_grades(docs: DataFrame, passages: DataFrame, span: int) -> DataFrame:
    """(item_id, doc_id, grade): how many of a passage's first and last ``span`` characters a text holds, where any.

    A passage of ``span`` characters or fewer is both spans itself, so it counts twice.  Spans and texts meet on a whole word: a span inside a
    text brings its inner words as whole words, so an equi-join on the rarest of them finds every match.  No text moves: the words are told to all tasks.  Spans without an inner word are
    told to all tasks, TOLD at a time, and looked for in each text.
    """
    norm = lambda c: F.lower(F.regexp_replace(F.trim(c), "[ \\t\\n\\r]+", " "))
    p = passages.where("text is not null").select("item_id", norm(F.col("text")).alias("t"))
    s = p.select("item_id", F.explode(F.array(F.substring("t", 1, span), F.expr(f"right(t, {span})"))).alias("s"))
    s = s.groupBy("item_id", "s").agg(F.count(F.lit(1)).alias("times")).withColumn("ws", F.split("s", " "))
    d = docs.where("text is not null").select("doc_id", norm(F.col("text")).alias("t"))
    inner = s.where(F.size("ws") > 2).select("item_id", "s", "times", F.explode(F.array_distinct(F.slice("ws", 2, F.size("ws") - 2))).alias("w"))
    held = d.select(F.explode(F.array_distinct(F.split("t", " "))).alias("w")).join(_told(inner.select("w").distinct()), "w", "left_semi")
    freq = held.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    rare = stored(inner.join(freq, "w").groupBy("item_id", "s", "times").agg(F.min_by("w", F.struct("df", "w")).alias("w")), "spans")
    names, hit = rare.select("w").distinct(), None
    parts = max(1, -(-names.count() // TOLD))
    for k in range(parts):  # a text meets the words told in its own row, and goes on with those that it holds
        block = rare.where(F.pmod(F.xxhash64("w"), F.lit(parts)) == k)
        wanted = block.agg(F.collect_set("w").alias("wanted"))
        met = d.crossJoin(F.broadcast(wanted)).select("doc_id", "t", F.array_intersect(F.split("t", " "), "wanted").alias("ws")).where(F.size("ws") > 0)
        met = met.select("doc_id", "t", F.explode("ws").alias("w")).join(_told(block), "w").where(F.contains("t", F.col("s"))).select("item_id", "doc_id", "times")
        hit = met if hit is None else hit.unionByName(met)
    short = s.where(F.size("ws") <= 2).select("item_id", "s", "times")
    blocks = -(-short.count() // TOLD)
    for k in range(blocks):
        block = short.where(F.pmod(F.xxhash64("item_id", "s"), F.lit(blocks)) == k)
        hit = hit.unionByName(d.join(F.broadcast(block), F.contains("t", F.col("s"))).select("item_id", "doc_id", "times"))
    return hit.groupBy("item_id", "doc_id").agg(F.sum("times").alias("grade"))
