"""Filter interaction audit by packed bitmap indexes (operator 11).

Each document's five filters are decided once.  Every partition then packs its documents into bitsets, one for each filter, label and part,
and counts by AND-NOT and popcount what each of the 32 subsets of filters would keep: of a part, of its good and of its toxic documents.
These counts add up over partitions, and all 120 orders are differences of them: a filter that follows the filters of S
removes kept(S) - kept(S with it), whatever their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import HUBS, written

#: Filters by letter, in the order of their bits.
FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Documents in a bitset; its parts are no more than these, so a block's bitsets stay within a few MB.
BLOCK = 4096
#: Parts whose counts a task holds before it passes them on.
HELD = 4096
#: What lies between words.
SPACES = r"[\x20\x09-\x0D]+"
COUNTS = ["kept", "good", "toxic"]


def _failures(text: Column) -> dict[str, Column]:
    """Whether a text fails each filter that looks at it alone."""
    words = F.array_remove(F.split(text, SPACES), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 100, "B": 100 * distinct < 80 * n, "C": 100 * capitals > 10 * F.length(text), "D": text.rlike("[#$%&*|]")}


def failure_flags(docs: DataFrame) -> DataFrame:
    """(doc_id, part, A, B, C, D, E) for every row of ``docs`` (doc_id, text, lang): whether it fails each filter.

    E fails rows whose text stands in a row with a smaller doc_id.  Texts are named by 128 bits; texts of very many rows, fewer than HUBS, are broadcast, so that their
    rows are not shuffled.  A null text is empty, a null lang the part '', and a null doc_id is neither smaller nor larger than another.
    """
    text = F.coalesce("text", F.lit(""))
    names = {"h": F.xxhash64(text), "g": F.xxhash64(F.lit("second"), text)}
    rows = written(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), *(c.alias(k) for k, c in (_failures(text) | names).items())), "flags")
    copies = rows.groupBy("h", "g").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = written(copies, "copies")
    total = copies.agg(F.sum("n")).first()[0] or 0
    hot, cold = (copies.where(c).select("h", "g", "least") for c in (F.col("n") * HUBS > total, F.col("n") * HUBS <= total))
    joined = rows.join(F.broadcast(hot), ["h", "g"])
    others = rows.join(F.broadcast(hot), ["h", "g"], "left_anti").join(cold, ["h", "g"], "left")
    return joined.unionByName(others).select("doc_id", "part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("E"))


def _labelled(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A to E, good, toxic); a document is good or toxic if any row of its doc_id in ``labels`` says so."""
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    cols = ["part", *FILTERS, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))]
    known = flags.where("doc_id IS NOT NULL").join(marks.where("good OR toxic"), F.col("doc_id") == F.col("id"), "left").select(*cols)
    return known.unionByName(flags.where("doc_id IS NULL").select("part", *FILTERS, F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def subset_counts(part: np.ndarray, fails: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Part codes, and (parts, SUBSETS, 3) counts of documents that no filter of a subset fails: all, good, toxic.

    ``fails`` (5, n) and ``labels`` (2, n) are booleans; all bits are packed, and a subset's failures are the union of those of the
    subset without its lowest filter and of that filter.
    """
    codes = np.unique(part)
    parts = np.packbits(part == codes[:, None], axis=1)
    marked = [parts, *(parts & x for x in np.packbits(labels, axis=1))]
    bits = np.packbits(fails, axis=1)
    failed = np.zeros((SUBSETS, bits.shape[1]), np.uint8)
    out = np.empty((len(codes), SUBSETS, len(marked)), np.int64)
    for s in range(SUBSETS):
        if s:
            failed[s] = failed[s & (s - 1)] | bits[(s & -s).bit_length() - 1]
        for k, m in enumerate(marked):
            out[:, s, k] = np.bitwise_count(m & ~failed[s]).sum(axis=1, dtype=np.int64)
    return codes, out


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (part, subset, kept, good, toxic) for each part and subset of a task's documents."""
    held: dict[str, np.ndarray] = {}

    def flush() -> pa.RecordBatch:
        n = np.concatenate(list(held.values()))
        names = np.repeat(np.arange(len(held)), SUBSETS)
        part = pa.array(list(held), pa.string()).take(pa.array(names))
        subset = pa.array(np.tile(np.arange(SUBSETS, dtype=np.int32), len(held)))
        held.clear()
        return pa.RecordBatch.from_arrays([part, subset, *(pa.array(n[:, k]) for k in range(3))], names=["part", "subset", *COUNTS])

    for whole in batches:
        for lo in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(lo, BLOCK)
            coded = batch.column("part").dictionary_encode()
            flag = lambda names: np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            codes, n = subset_counts(coded.indices.to_numpy(), flag(FILTERS), flag(COUNTS[1:]))
            for code, own in zip(codes.tolist(), n):
                name = coded.dictionary[code].as_py()
                held[name] = held[name] + own if name in held else own
            if len(held) >= HELD:
                yield flush()
    if held:
        yield flush()


def _steps(spark) -> DataFrame:
    """(filter_order, step, filter, before, after): the subsets before and after each step of the 120 orders."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, f in enumerate(order, 1):
            after = before | 1 << FILTERS.index(f)
            rows.append(("".join(order), step, f, before, after))
            before = after
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: what the step's filter keeps, removes and would have removed.

    (part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for
    ``docs`` (doc_id, text, lang) and ``labels`` (doc_id, quality, toxic).  Every row counts, repeated
    ones too; rows without a doc_id have no labels; several label rows of one doc_id count once; no documents, no parts.
    Other columns do not matter, and a very long text is one value.  Counts alone leave the tasks: 32 rows for each part and task.
    """
    spark = docs.sparkSession
    schema = "part string, subset int, kept long, good long, toxic long"
    per_task = _labelled(failure_flags(docs), labels).mapInArrow(_bitmaps, schema)
    counts = written(per_task.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in COUNTS)), "subset-counts")
    named = lambda k, *cols: counts.select(F.col("part"), F.col("subset").alias(f"s_{k}"), *(F.col(c).alias(f"{c}_{k}") for c in cols))
    steps = F.broadcast(_steps(spark).withColumns({"alone": F.col("after") - F.col("before"), "all": F.lit(SUBSETS - 1)}))
    rows = named("before", *COUNTS).join(steps, F.col("s_before") == F.col("before"))
    everything = counts.where("subset = 0").select("part", F.col("kept").alias("documents"))
    rows = rows.join(named("after", *COUNTS).withColumnRenamed("s_after", "after"), ["part", "after"])
    rows = rows.join(named("alone", "kept").withColumnRenamed("s_alone", "alone"), ["part", "alone"])
    rows = rows.withColumn("others", F.col("all") - F.col("alone")).join(named("others", "kept").withColumnRenamed("s_others", "others"), ["part", "others"])
    rows = rows.join(named("all", "kept").withColumnRenamed("s_all", "all"), ["part", "all"]).join(everything, "part")
    removed = F.col("kept_before") - F.col("kept_after")
    rows = rows.select(
        "part", "filter_order", "step", "filter", F.col("kept_after").alias("kept"), removed.alias("removed"),
        (F.col("documents") - F.col("kept_alone") - removed).alias("redundant"), (F.col("kept_others") - F.col("kept_all")).alias("unique_fails"),
        (F.col("good_before") - F.col("good_after")).alias("good_lost"), (F.col("toxic_before") - F.col("toxic_after")).alias("toxic_lost"),
    )
    shapley = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shapley, ["part", "filter"]).select(*[c for c in rows.columns if c != "filter"], "shapley", "filter")


ORACLE = r"""
WITH letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f
), steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, substr(filter_order, s, 1) AS filter, substr(filter_order, 1, s - 1) AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS part, coalesce("text", '') AS t, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), marks AS (
  SELECT doc_id, coalesce(max(CAST(quality = 1 AS INTEGER)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INTEGER)), 0) AS toxic FROM labels GROUP BY doc_id
), flagged AS (
  SELECT t.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
    CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
      || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END
      || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN coalesce(t.doc_id > min(t.doc_id) OVER (PARTITION BY t), false) THEN 'E' ELSE '' END AS fails
  FROM texts t LEFT JOIN marks m ON m.doc_id = t.doc_id
), grouped AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY part, fails
), counted AS (
  SELECT part, filter_order, step, filter,
    CAST(coalesce(sum(n) FILTER (length(translate(fails, earlier || filter, '')) = length(fails)), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (contains(fails, filter) AND length(translate(fails, earlier, '')) = length(fails)), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (contains(fails, filter) AND length(translate(fails, earlier, '')) < length(fails)), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails = filter), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (contains(fails, filter) AND length(translate(fails, earlier, '')) = length(fails)), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (contains(fails, filter) AND length(translate(fails, earlier, '')) = length(fails)), 0) AS BIGINT) AS toxic_lost
  FROM grouped, steps GROUP BY part, filter_order, step, filter
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM counted
"""
