"""Mixing sources to target weights (operator 10): DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import unused, word_count, written

#: Weights dealt to the sources in code-point order, null last, again and again.
WEIGHTS = (5, 2, 1)
#: Words of the mix over words of all documents, and of a source's target over its own words at most.
SHARE, MOST = 1.5, 2
#: Rows that one range of keys holds at most, about; a range is put in order by one task.
RANGE_ROWS = 50_000
#: Equal documents that are listed by one task.
PIECE = 4096
#: Sources up to which their cuts are broadcast.
BROADCAST_SOURCES = 10_000


def source_targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) of (source, size).

    The excess over a source's limit is dealt by weight to the rest until none is above:
    sources in order of limit / weight are full as long as the level, what is left over
    the weights that are left, would lift them above their limit.  One row for each source is all
    that the windows see.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(WEIGHTS)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1).cast("double"))
    limit = (MOST * F.col("source_size")).cast("double")
    fill = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, ahead = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(ahead)
    per = per.withColumn("full", F.col("weight") * level >= limit).withColumn("level", level)
    open_level = F.min(F.when(~F.col("full"), F.struct((limit / F.col("weight")).alias("r"), F.col("level").alias("level")))).over(everything)
    target = F.when(F.col("full"), limit).otherwise(F.least(limit, F.col("weight") * open_level["level"]))
    return per.select("source", "source_size", target.alias("target"))


def _key() -> Column:
    """A document's random key: MD5 of its id, or of its text where it has none."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("no id "), F.coalesce("text", F.lit("")))))


def range_digits(rows: int) -> int:
    """Leading hex digits of a key that cut ``rows`` rows into ranges of at most about RANGE_ROWS, two at least."""
    digits = 2
    while rows > RANGE_ROWS << 4 * digits:
        digits += 1
    return digits


def _placed(docs: DataFrame) -> DataFrame:
    """Each distinct (source, key, doc_id, size) with its rows ``n``, source totals, whole epochs and the words ``rest`` that the rest takes from all of its rows."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key().alias("key"))
    sized = written(sized.groupBy("source", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("words", F.col("size") * F.col("n")), "sized")
    targets = source_targets(sized.select("source", F.col("words").alias("size")))
    sized = sized.withColumn("bucket", F.substring("key", 1, range_digits(sized.count())))
    per = sized.groupBy("source", "bucket").agg(F.sum("words").alias("n"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("source", "bucket", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("bucket_start"))
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inside", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]
    placed = placed.join(starts, same(placed, starts, "source", "bucket")).select(placed["*"], starts["bucket_start"])
    placed = placed.join(targets, same(placed, targets, "source")).select(placed["*"], targets["source_size"], targets["target"])
    budget = F.floor(F.col("target") + F.lit(0.5))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size")
    rest = F.least(F.col("words"), F.greatest(F.lit(0), left - F.col("bucket_start") - F.col("inside")))
    return placed.select("doc_id", "source", "key", "size", "n", "source_size", "target", epochs.alias("epochs"), rest.alias("rest"))


def _each(placed: DataFrame) -> DataFrame:
    """A row for each document of ``placed``, with its number ``at`` among equal ones; many equal ones are dealt out in pieces of PIECE."""
    pieces = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))
    many = placed.where(F.col("n") > PIECE).withColumn("first", F.explode(pieces)).repartition("key", "first")
    cut = placed.where(F.col("n") <= PIECE).withColumn("first", F.lit(0).cast("long")).unionByName(many)
    return cut.withColumn("at", F.explode(F.sequence("first", F.least(F.col("first") + PIECE, "n") - 1)))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs`` (doc_id, text, source).

    Each row gets the MD5 of its doc_id as a random key.  A source's target is so many
    whole epochs and a rest; the rest goes to rows in key order until its words are used up,
    and the row at the cut gives just the words that are missing.  Prefix sums are
    distributed: sums per range of keys within a source, a running sum over one row for each
    range, and a running sum within each range.  Ranges grow in number with the rows, so each stays at about
    RANGE_ROWS even if one source holds all of them.

    Null texts have no words; null sources are a source; rows without a doc_id take their text's MD5;
    repeated rows count each, are summed before any window and share no single task,
    and rows of one key lie by size.  The result depends on the rows alone, not on
    their order or partitions.
    """
    cut = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("at") * F.col("size")))
    taken = F.col("epochs") * F.col("size") + cut
    return _each(_placed(docs)).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: once for each epoch that takes any of their words.

    A row at the cut stays whole, so a source exceeds its target by less than one
    document.  Rows without words never enter a mix.  Per source, the epochs and
    the last key of the rest decide, so texts are not shuffled as long as the sources
    fit in ``BROADCAST_SOURCES`` rows.  Columns of any names stay as they are.
    """
    source, epochs, last, copy = (unused(docs, c) for c in ("cut_source", "cut_epochs", "cut_last", "cut_copy"))
    cuts = _placed(docs).groupBy(F.col("source").alias(source)).agg(F.max("epochs").alias(epochs), F.max(F.when(F.col("rest") > 0, F.col("key"))).alias(last))
    cuts = written(cuts, "cuts")
    if cuts.count() <= BROADCAST_SOURCES:
        cuts = F.broadcast(cuts)
    times = F.col(epochs).cast("int") + F.coalesce(_key() <= F.col(last), F.lit(False)).cast("int")
    times = F.when(word_count(F.col("text")) > 0, times).otherwise(F.lit(0))
    joined = docs.join(cuts, docs["source"].eqNullSafe(F.col(source)))
    return joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times))).select(docs.columns)


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'no id ' || coalesce("text", ''))) AS key,
         CAST(len(regexp_extract_all(coalesce("text", ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM per
), levels AS (
  SELECT *, 2.0 * source_size / weight AS r,
    (CAST(1.5 AS DOUBLE) * sum(source_size) OVER ()
      - coalesce(sum(CAST(2 * source_size AS DOUBLE)) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), flagged AS (
  SELECT *, weight * level >= 2 * source_size AS is_full FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE) ELSE least(CAST(2 * source_size AS DOUBLE), weight * (SELECT arg_min(level, r) FROM flagged WHERE NOT is_full)) END AS target
  FROM flagged
), placed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CAST(floor(t.target + 0.5) AS BIGINT) AS budget
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, source, size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN budget // source_size * size + least(size, greatest(0, budget % source_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM placed
"""
