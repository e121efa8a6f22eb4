"""Rows without texts alike: a set-similarity join on word shingles (the pipeline's near-duplicate stage).

Operator 6 groups what lies within 2 bits, and one row of each group goes on.  Two of these are
alike if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.  At most n // 5
of a text's n shingles are then not in the other text, so two alike texts share one of the first few of each in any
common order, and only texts that do meet (prefix filter).  The order is that of the hashes; n // 5 + 1 shingles
are sure to do, and fewer where the chance that none of them is shared lies below MISS, less than that of two shingles with one hash.

Shingles that a sample shows to be common come last, so that a line in many
texts brings few of them together; it bears on the work alone, never on the result.  Shingles that
many rows share compare all of these with the least one first: copies of one text leave after one
comparison each, and only what stays is compared with more.

A pair that meets is held at once, inside the join, against parity maps: LANES * 64 bits, one for every hash class of
shingles.  Maps never differ in more bits than the sets do in shingles, so too many bits rule a pair out; two unlike texts
differ in about half of the bits, which tells pairs of up to some 2,300 shingles each apart, and longer ones go on.  Only
what is left is compared by whole sets, each text at first with one earlier text alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import simhash
from quern.llm.common import join_counted, sliced, written

WIDTH = 5
#: Chance that a text's prefix misses another text at the similarity.
MISS = 1e-15
#: One text in so many is looked at for common shingles; these are in COMMON of them or more, and at most MOST are told to all tasks.
SAMPLE, COMMON, MOST = 16, 8, 1 << 16
#: Rows of a shingle that are compared in all pairs, eight times as many each round, and rounds after which those of any shingle are.
BUCKET, ROUNDS = 32, 5
#: Pairs for each text up to which what is left is held against each other by maps, so that no more rounds are needed.
PAIRS = 128
#: Rows of a shingle that one task holds against all others of it.
SPLIT = 256
#: 64-bit words of a parity map.
LANES = 16
#: Row numbers that are broadcast, so that texts are not shuffled to find theirs.
TOLD = 1 << 20
#: Texts that are compared with one copy of an earlier one's set.
SHARE = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Ascending distinct hashes (int64) of each text's WIDTH-word shingles, lower-case in A-Z; of fewer words, of all; no words: none."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    coded = lists.flatten().dictionary_encode()
    word = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    flat = word[coded.indices.to_numpy()] if len(word) else np.zeros(0, np.uint64)
    ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
    mixed = np.zeros(max(0, len(flat) - WIDTH + 1), np.uint64)
    for k in range(WIDTH):
        mixed = (mixed ^ flat[k : k + len(mixed)]) * _STEP
        mixed ^= mixed >> np.uint64(29)
    mixed = mixed * _MIX
    mixed ^= mixed >> np.uint64(32)
    out, start, empty = [], 0, xxhash.xxh3_64_intdigest("")
    for stop in ends:
        n = stop - start
        if n >= WIDTH:
            keys = np.unique(mixed[start : stop - WIDTH + 1])
        elif n == 0 or n == 1 and int(flat[start]) == empty:  # an empty text splits into one empty word
            keys = np.zeros(0, np.uint64)
        else:
            keys = np.array([xxhash.xxh64_intdigest(flat[start:stop].tobytes())], np.uint64)
        out.append(np.sort(keys.view(np.int64)))
        start = stop
    return out


def prefix_length(n: int, rare: int) -> int:
    """Shingles of a prefix of a text with n shingles, ``rare`` of which are not common."""
    other = n // 5  # shingles at most that an alike text has not
    if other == 0 or rare <= other:
        return min(n, other + 1)
    return min(other + 1, math.ceil(math.log(MISS) / math.log(other / rare)))


def parity_map(keys: np.ndarray) -> np.ndarray:
    """A bit for each hash class of the keys, set where it holds an odd number of them, in LANES int64 words."""
    odd = np.bincount(keys & (LANES * 64 - 1), minlength=LANES * 64) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def _sketches(common: np.ndarray):
    """(row, rank, fp, n, keys, map): fingerprint, number of shingles, those of the prefix, parity map."""
    by = np.argsort(common)

    def prefix(keys: np.ndarray) -> np.ndarray:
        place = np.zeros(len(keys), np.int64)  # 0: not common, then the commoner the later
        if len(common):
            at = by[np.minimum(np.searchsorted(common, keys, sorter=by), len(common) - 1)]
            place = np.where(common[at] == keys, len(common) - at, 0)
        return keys[np.lexsort((keys, place))][: prefix_length(len(keys), int((place == 0).sum()))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            prints = np.array([simhash.fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64)
            sets = shingle_sets(texts)
            cols = [pa.array(prints), pa.array(list(map(len, sets)), pa.int64()), pa.array(list(map(prefix, sets)), pa.list_(pa.int64())), pa.array(list(map(parity_map, sets)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("__rank"), *cols], names=["row", "rank", "fp", "n", "keys", "map"])

    return rows


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key) of every distinct shingle of each text."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *shingle_sets(batch.column(0))]))], names=["key"])


def common_shingles(texts: DataFrame) -> np.ndarray:
    """The shingles of most texts in a sample, the commonest first; copies count once."""
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").distinct().mapInArrow(sliced(_shingles), "key long")
    many = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(MOST)
    return np.array([r.key for r in many.collect()], np.int64)


def sketched(rows: DataFrame) -> DataFrame:
    """The stored sketches of ``rows`` (__row, __rank, text)."""
    rank = rows.schema["__rank"].dataType
    kinds = {"row": T.LongType(), "rank": rank, "fp": T.LongType(), "n": T.LongType(), "keys": T.ArrayType(T.LongType()), "map": T.ArrayType(T.LongType())}
    work = sliced(_sketches(common_shingles(rows)))
    return written(rows.select("__row", "__rank", "text").mapInArrow(work, T.StructType([T.StructField(k, v) for k, v in kinds.items()])), "sketches")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [c for name, c in zip(batch.schema.names, batch.columns) if name != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(shingle_sets(batch.column("text")), pa.list_(pa.int64()))], names=[*names, "keys"])


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored ``pairs`` (a, b) as (a, b, part), and (a, part) for each part of about SHARE pairs of an a.

    What a brings to its pairs then meets them in parts, so a text met by very many others is no single task's work.
    """
    heads = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "heads")
    parts = (F.floor(F.col("n") / SHARE) + 1).cast("int")
    dealt = join_counted(pairs.select("a", "b"), heads, ["a"], "n").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    return dealt, heads.select("a", parts.alias("parts"))


def _per_part(of_a: DataFrame) -> DataFrame:
    return of_a.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def _texts(pairs: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The ``rows`` (__row, text) that the stored ``pairs`` (a, b) name: only their texts are shuffled, as long as TOLD numbers name them all."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = written(kept.join(nodes, "node", "left_semi").select("__row"), "named")
    return rows.join(F.broadcast(named), "__row", "left_semi") if named.count() <= TOLD else rows


def _alike(pairs: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The stored ``pairs`` (a, b) whose whole sets of shingles reach the similarity."""
    dealt, heads = _dealt(pairs)
    rows = _texts(pairs, rows, kept)
    text = lambda ends, node: rows.join(ends.join(kept.withColumnRenamed("node", node), node), "__row")
    of_b = text(dealt, "b").select("a", "b", "part", "text").mapInArrow(sliced(_sets), "a long, b long, part int, keys array<long>")
    of_a = text(heads, "a").select("a", "parts", "text").mapInArrow(sliced(_sets), "a long, parts int, keys array<long>")
    of_a = _per_part(of_a.withColumnRenamed("keys", "own"))
    both = F.size(F.array_intersect("own", "keys"))
    return of_b.join(of_a, ["a", "part"]).where(both * 5 >= (F.size("own") + F.size("keys") - both) * 4).select("a", "b")


def _maybe_alike(pairs: DataFrame) -> DataFrame:
    """(a, b, apart), a < b, of the ``pairs`` (x, y: structs of node, n, map) whose sizes and parity maps do not rule them out."""
    x, y = F.col("x"), F.col("y")
    apart = sum((F.bit_count(x["map"][k].bitwiseXOR(y["map"][k])) for k in range(LANES)), F.lit(0))
    fit = (x["n"] * 5 >= y["n"] * 4) & (y["n"] * 5 >= x["n"] * 4)
    return pairs.where((x["node"] < y["node"]) & fit & (apart * 9 <= x["n"] + y["n"])).select(x["node"].alias("a"), y["node"].alias("b"), apart.alias("apart"))


def _paired(met: DataFrame) -> DataFrame:
    """(x, y) of the rows of ``met`` (key, text, m) with equal keys, SPLIT rows of a key at a time."""
    parts = (F.floor(F.col("m") / SPLIT) + 1).cast("int")
    left = met.select("key", F.col("text").alias("x"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return left.join(met.select("key", F.col("text").alias("y"), F.pmod(F.xxhash64("text.node"), parts).cast("int").alias("part")), ["key", "part"])


def _shared(met: DataFrame) -> DataFrame:
    """(key, head, m) of the shingles that several rows hold: the least node and the number of rows."""
    return met.groupBy("key").agg(F.min("text").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1")


def _first_alike(near: DataFrame, rows: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored links (a, b) of ``near`` (stored: a, b, apart) to each b's nearest a, where alike; and the other pairs of the texts without one."""
    first = written(near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select("best.a", "b"), "first")
    new = first if first.isEmpty() else written(_alike(first, rows, kept), "alike")
    return new, near.join(new.select("b"), "b", "left_anti").join(first, ["a", "b"], "left_anti").select("a", "b", "apart")


def similar_links(rows: DataFrame, sketches: DataFrame, kept: DataFrame, bucket: int = BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """(a, b) links, a < b, of alike texts: no two texts that are no link's b are alike.

    ``rows`` (__row, text) and ``sketches`` are stored tables, ``kept`` (__row, node) is stored too and names the
    rows that take part; nodes are distinct longs.
    """
    text = F.struct("node", "n", "map")
    known = written(sketches.join(kept, sketches["row"] == kept["__row"]).select("node", "n", "map", "keys"), "known")
    maps = known.select("node", text.alias("text"))
    prefix = known.select("node", F.explode("keys").alias("key"))
    groups = written(prefix.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("m")).where("m > 1"), "groups")
    met = written(join_counted(prefix, groups, ["key"], "m").where("node <> head").select("key", "node", "head"), "met")
    # first every shingle's rows meet its least one; maps travel with distinct pairs, not with each shingle
    pairs = written(met.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    heads = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs")).join(known.select(F.col("node").alias("a"), text.alias("x")), "a"), "heads")
    both = join_counted(pairs, heads, ["a"], "pairs").join(maps.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    found, pending = _first_alike(written(_maybe_alike(both), "near"), rows, kept)
    pending = written(pending, "pending")
    left = written(met.join(found.select(F.col("b").alias("node")).distinct(), "node", "left_anti").select("key", "node"), "left")
    groups = written(left.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "groups")
    met = written(join_counted(left, groups, ["key"], "m").join(maps, "node").select("key", "text"), "met")
    most = PAIRS * known.count()
    for turn in range(1, max(1, rounds) + 1):
        # small groups are paired out, and the rows of large ones meet the next least one
        groups = written(_shared(met), "groups")
        last = turn >= rounds or (groups.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2)).first()[0] or 0) <= most
        whole = F.lit(True) if last else F.col("m") <= bucket * 8 ** (turn - 1)
        in_group = written(join_counted(met, groups, ["key"], "m"), "grouped")
        near = _maybe_alike(in_group.where(~whole).select(F.col("head").alias("x"), F.col("text").alias("y")))
        near = written(near.unionByName(_maybe_alike(_paired(in_group.where(whole)))).unionByName(pending).distinct(), "near")
        new, pending = _first_alike(near, rows, kept)
        if last and not (second := written(pending.select("a", "b"), "second")).isEmpty():
            new = written(new.union(_alike(second, rows, kept)), "alike")
        found = found.union(new)
        if last:
            break
        pending = written(pending, "pending")
        left = in_group.where("text.node <> head.node").where(~whole).withColumn("node", F.col("text.node"))
        met = written(left.join(new.select(F.col("b").alias("node")).distinct(), "node", "left_anti").select("key", "text"), "left")
    return found


def keep_dissimilar(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with one row of each SimHash group, and of these none alike to another; all columns stay.

    Groups are operator 6's; of each the row with the least doc_id stays (null last, then by hashes of the text and all columns).
    Among these no two are alike, and each that goes is alike to one with a smaller root fingerprint, which stays or
    is itself alike to such a one.  Empty texts are one group; texts without words are alike to none.
    Columns of any names stay as they are.
    """
    rows, row, rank = simhash.numbered(docs)
    texts = rows.select(F.col(row).alias("__row"), F.col(rank).alias("__rank"), "text")
    sketches = sketched(texts)
    kept = written(simhash.group_heads(sketches.select("row", "rank", "fp")).select(F.col("row").alias("__row"), F.col("root").alias("node")), "kept")
    gone = similar_links(texts, sketches, kept).select(F.col("b").alias("node")).distinct()
    stay = written(kept.join(gone, "node", "left_anti").select(F.col("__row").alias(row)), "stay")
    return rows.join(F.broadcast(stay) if stay.count() <= TOLD else stay, row, "left_semi").select(*docs.columns)
