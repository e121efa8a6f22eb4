"""SimHash near-duplicates by pivot distance tables (operator 6).

Every distinct fingerprint gets a table of its Hamming distances to fixed reference
fingerprints.  Fingerprints within RADIUS bits differ by at most RADIUS in every coordinate
of the table, which rules pairs out without looking at the fingerprints:

* Key pivots are a base and the 64 fingerprints one bit away from it, in five groups.  A pair's distances relative to the base can
  differ in at most two groups, so it agrees in three, and meets in one of the ten joins on
  three groups' relative distances.  A distance relative to the base tells one bit of the fingerprint, so these joins are
  those of a block permutation, put in pivot coordinates: no coarser coordinates of a radius of 2 would
  part 10^10 fingerprints.
* Far pivots are spread over the space.  Pairs that met and differ by more than RADIUS in any
  of these coordinates are discarded; the survivors' fingerprints are compared.  ``pivot_shares`` counts both.

Only joins of more than BUCKET fingerprints are left out of the pair step; their members meet at the
fingerprints one bit away from them instead, which is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import join_counted, sliced, unused, written
from quern.llm.components import connected_components

SEED = 42
RADIUS = 2
SHINGLE = 3
FAR_PIVOTS = 16
BUCKET = 256
_KEYS = 5
#: Bits of the key groups, and the triples of groups that pairs meet on.
GROUPS = [np.arange(64)[g::_KEYS] for g in range(_KEYS)]
TRIPLES = [(a, b, c) for a in range(_KEYS) for b in range(a + 1, _KEYS) for c in range(b + 1, _KEYS)]


def pivots() -> np.ndarray:
    """Base, the 64 one bit from it, and the far pivots: XXH64 of their numbers."""
    far = np.array([xxhash.xxh64_intdigest(b"pivot %d" % k, SEED) for k in range(FAR_PIVOTS + 1)], np.uint64)
    return np.concatenate([far[:1], far[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64)), far[1:]])


def shingle_hashes(text: str | None) -> np.ndarray:
    """XXH64 of a whole text's shingles of SHINGLE words, repeats included; of fewer words, of all; no words: none."""
    words = (text or "").encode().lower().split()  # bytes.lower and bytes.split know ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    parts = [b" ".join(words)] if len(words) < SHINGLE else map(b" ".join, zip(*(words[k:] for k in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    return np.fromiter([digest(p, SEED) for p in parts], np.uint64)


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text's word shingles, repeats included; no words: 0."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[lo : lo + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every whole text; null and empty texts have fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sliced(_fingerprints), "doc_id long, fp long")


def distance_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances (n, pivots) of uint64 fingerprints."""
    return np.bitwise_count(prints[:, None] ^ pivots()[None, :])


def meeting_keys(distances: np.ndarray) -> np.ndarray:
    """(n, triples) keys: the relative distances to the key pivots of three groups, one bit each, and the triple's number."""
    nearer = (distances[:, 1:65] < distances[:, :1]).astype(np.uint64)
    parts = [(nearer[:, g] << np.arange(len(g), dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for g in GROUPS]
    width = [np.uint64(len(g)) for g in GROUPS]
    return np.stack([(((parts[a] << width[b] | parts[b]) << width[c] | parts[c]) << np.uint64(4)) | np.uint64(t) for t, (a, b, c) in enumerate(TRIPLES)], axis=1)


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy()
        for lo in range(0, len(fp), 4096):
            keys = meeting_keys(distance_table(fp[lo : lo + 4096].view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp[lo : lo + 4096], keys.shape[1]))], names=["key", "fp"])


def pivot_survivors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, i, j) of the pairs i < j in buckets (B, n) that no far pivot tells to lie beyond RADIUS."""
    table = distance_table(prints.ravel())[:, 65:].astype(np.int8).reshape(*prints.shape, -1)
    near = np.ones((prints.shape[0], prints.shape[1], prints.shape[1]), bool)
    for k in range(table.shape[2]):
        near &= np.abs(table[:, :, None, k] - table[:, None, :, k]) <= RADIUS
    return np.nonzero(near & np.triu(np.ones(near.shape[1:], bool), 1))


def pivot_shares(buckets: list[np.ndarray]) -> tuple[int, int, int]:
    """(pairs that meet, pairs that the far pivots leave, pairs within RADIUS) of buckets of fingerprints."""
    met = left = near = 0
    for prints in buckets:
        _, i, j = pivot_survivors(prints[None, :])
        met += len(prints) * (len(prints) - 1) // 2
        left += len(i)
        near += int((np.bitwise_count(prints[i] ^ prints[j]) <= RADIUS).sum())
    return met, left, near


def bucket_links(prints: np.ndarray) -> np.ndarray:
    """(m, 2) links that join what lies within RADIUS, transitively, in buckets (B, n) of equal size.

    Each fingerprint that is not the first of its part of a bucket is linked to that first one, so
    a bucket gives fewer links than members.
    """
    b, i, j = pivot_survivors(prints)
    keep = np.bitwise_count(prints[b, i] ^ prints[b, j]) <= RADIUS
    b, i, j = b[keep], i[keep], j[keep]
    label = np.tile(np.arange(prints.shape[1]), (prints.shape[0], 1))
    while True:
        before = label.copy()
        np.minimum.at(label, (b, j), label[b, i])
        np.minimum.at(label, (b, i), label[b, j])
        if (label == before).all():
            break
    b, j = np.nonzero(label != np.arange(prints.shape[1]))
    return np.stack([prints[b, label[b, j]], prints[b, j]], axis=1)


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("fps")
        n = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy().view(np.uint64)
        starts = np.cumsum(n) - n
        for size in np.unique(n):
            own = starts[n == size]
            step = max(1, (1 << 18) // int(size) ** 2)
            for lo in range(0, len(own), step):
                links = bucket_links(np.sort(flat[own[lo : lo + step, None] + np.arange(size)], axis=1)).view(np.int64)
                if len(links):
                    yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], names=["a", "b"])


def fingerprint_links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b) links of distinct fingerprints (fp); their components are those of all pairs within RADIUS bits."""
    meetings = written(distinct.mapInArrow(_meetings, "key long, fp long"), "meetings")
    shared = written(meetings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    met = written(join_counted(meetings, shared, ["key"], "n"), "met")
    small = met.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    links = small.mapInArrow(_bucket_rows, "a long, b long")
    hot = met.where(F.col("n") > bucket).select("fp").distinct()
    around = F.concat(F.array("fp"), *[F.array(F.col("fp").bitwiseXOR(F.lit(int(np.int64(np.uint64(1) << np.uint64(i)))))) for i in range(64)])
    points = hot.select("fp", F.explode(around).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("point", "a")
    return links.union(points.join(least, "point").where("a <> fp").select("a", F.col("fp").alias("b")).distinct())


def _rooted(distinct: DataFrame) -> DataFrame:
    """``distinct`` (fp, ...) with root, the smallest fingerprint of its component."""
    nodes = written(connected_components(fingerprint_links(distinct.select("fp"))), "nodes")
    return distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id reachable over fingerprints that differ in at most
    RADIUS bits.  Equal fingerprints are one node, so groups of copies make no pairs.  Null
    doc_ids keep their row and never name a component; repeated rows stay.
    """
    prints = written(fingerprints(docs), "prints")
    rooted = written(_rooted(written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")), "distinct")), "rooted")
    roots = written(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")), "roots")
    of_print = written(join_counted(rooted, roots, ["root"], "n").select("fp", "component_id", "rows"), "named")
    out = join_counted(prints, of_print, ["fp"], "rows")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def group_heads(prints: DataFrame) -> DataFrame:
    """(row, root) of one row of each component of ``prints`` (row, rank, fp): that of the least rank (any ordered type); root is the component's least fingerprint."""
    best = written(prints.groupBy("fp").agg(F.min(F.struct("rank", "row")).alias("best")), "distinct")
    return _rooted(best).groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("row"), "root")


def row_rank(docs: DataFrame) -> Column:
    """What orders rows (doc_id, text, ...) for the choice of one: doc_id (null last), then hashes of the text and of all columns."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text"), F.xxhash64(*cols, *(c.isNull() for c in cols)).alias("all"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Exactly one row of every component of ``docs`` (doc_id, text, ...); all columns stay.

    The row with the smallest doc_id stays (null last), of these the one with the smallest hash of its
    text, so rows with a null or a repeated doc_id count like all others and the choice does not depend on their order.
    Columns of any names stay as they are.
    """
    rows, row, rank = numbered(docs)
    prints = rows.select(F.col(row).alias("__row"), F.col(rank).alias("__rank"), "text").mapInArrow(sliced(_row_prints), T.StructType([T.StructField("row", T.LongType()), T.StructField("rank", rows.schema[rank].dataType), T.StructField("fp", T.LongType())]))
    heads = group_heads(written(prints, "prints")).select(F.col("row").alias(row))
    return rows.join(heads, row, "left_semi").select(*docs.columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """``docs`` stored with a number and a rank of each row, and the names of these two columns, which no column of ``docs`` has."""
    row, rank = unused(docs, "row_number"), unused(docs, "row_rank")
    return written(docs.withColumn(rank, row_rank(docs)).withColumn(row, F.monotonically_increasing_id()), "rows"), row, rank


def _row_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("__rank"), pa.array(prints, pa.int64())], names=["row", "rank", "fp"])
