"""Toxicity scores by FTRL-proximal logistic regression (operator 2).

Features are hashes of a text's lower-cased words, word pairs and pairs one word apart
(skip-grams), present or not.  FTRL-proximal keeps a rate for each coordinate and its L1 term
leaves few weights, which are broadcast to the scoring tasks.  Only texts give features.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import sliced

#: Hash space of the features, in bits.
BITS = 20
#: Labelled rows that the model is fitted on at most: those with the least hash of their id.
FIT_ROWS = 8_000
#: Bytes of text that they hold at most; rows beyond this, in the same order, are not fitted on.
FIT_BYTES = 64 << 20
#: Passes over them.
EPOCHS = 8
#: FTRL-proximal: rate, its smoothing, L1 and L2 terms.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
#: A toxic row counts as so many clean ones, which are far more frequent.
POSITIVE_WEIGHT = 3.0
#: Remainders of crc32(doc_id) by FOLDS that are not 0 are learned from.
FOLDS = 5
#: Bytes of text turned into features at once.
CHUNK_BYTES = 4 << 20
CACHE_WORDS = 150_000
_MARKS = r"[!-/:-@\[-`{-~]+"
_WORDS: dict[str, int] = {}
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fold(doc_id) -> "F.Column":
    """crc32 of doc_id as text, modulo FOLDS; 0 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def _hash(a: np.ndarray) -> np.ndarray:
    """A feature's place in the hash space."""
    a = (a ^ (a >> np.uint64(31))) * _MIX
    return (a >> np.uint64(64 - BITS)).astype(np.int64)


def _word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    new = [w for w in words if w not in _WORDS]
    if len(_WORDS) + len(new) > CACHE_WORDS:
        _WORDS.clear()
        new = words
    _WORDS.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every word, word pair and skip-gram of texts, repeats included, rows ascending by kind."""
    texts = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=_MARKS, replacement=" ")
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    n = lists.value_lengths().to_numpy()
    flat = lists.flatten()
    word = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # an empty text splits into one empty word
    coded = flat.dictionary_encode()
    h = _word_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy()][word]
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)[word]
    rows, places = [row], [_hash(h)]
    for gap, salt in ((1, 3), (2, 7)):
        if len(row) > gap:
            one = row[gap:] == row[:-gap]
            rows.append(row[gap:][one])
            places.append(_hash((h[:-gap] * np.uint64(salt) + h[gap:] * np.uint64(2 * salt + 5))[one]))
    return np.concatenate(rows), np.concatenate(places)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, size: int = 1 << BITS) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) that are not 0 after FTRL-proximal passes over rows of distinct places.

    Place ``size`` is the bias, without L1.
    """
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    l1 = np.full(size + 1, L1)
    l1[size] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1[at], 0.0, (np.sign(zi) * l1[at] - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for places, y in zip(rows, labels):
            at = np.append(places, size)
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = (p - y) * (POSITIVE_WEIGHT if y else 1.0)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    at = np.flatnonzero(w)
    return at, w[at]


def chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about CHUNK_BYTES of text each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    slot = np.cumsum(sizes) // CHUNK_BYTES
    edges = np.flatnonzero(np.diff(slot, prepend=-1)) if len(sizes) else np.zeros(0, int)
    for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(sizes)]):
        yield texts.slice(lo, hi - lo)


def _distinct(row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((row.astype(np.int64) << (BITS + 1)) | place)
    return key >> (BITS + 1), key & ((1 << (BITS + 1)) - 1)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, labels, order = [], [], []
    for batch in batches:
        order += batch.column(0).to_pylist()
        labels += batch.column(2).to_pylist()
        for texts in chunks(batch.column(1)):
            r, p = _distinct(*features(texts))
            rows += np.split(p.astype(np.int32), np.searchsorted(r, np.arange(1, len(texts))))
    turn = sorted(range(len(rows)), key=lambda k: (zlib.crc32(b"%d" % order[k]), order[k]))
    at, w = ftrl([rows[k] for k in turn], np.array([labels[k] for k in turn], np.float64)) if rows else (np.zeros(0, np.int64), np.zeros(0))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w)], names=["place", "weight"])
    rows.clear()
    pa.default_memory_pool().release_unused()


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Weights fitted on at most ``fit_rows`` labelled rows outside the held-out fold, and ``fit_bytes`` of text.

    The sample's ids are broadcast (their number is bounded), its texts pass through one task in
    order of their hash until the bytes are reached, and only the weights that L1 leaves come to the driver.  Ids labelled more than once count as
    their highest label; null labels or ids do not count.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    text = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    text = text.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")
    running = F.sum(F.octet_length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    got = text.withColumn("bytes", running).where(F.col("bytes") <= fit_bytes).drop("bytes").mapInArrow(sliced(_fit), "place long, weight double").toPandas()
    return got["place"].to_numpy(), got["weight"].to_numpy()


def _scores(model: tuple[np.ndarray, np.ndarray]):
    at, w = model

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((1 << BITS) + 1)
        table[at] = w
        bias = table[1 << BITS]
        for batch in batches:
            out = []
            for texts in chunks(batch.column(1)):
                row, place = features(texts)
                live = table[place] != 0
                row, place = _distinct(row[live], place[live])
                total = bias + np.bincount(row, table[place], len(texts))
                out.append(1 / (1 + np.exp(-np.clip(total, -500, 500))))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])
        pa.default_memory_pool().release_unused()

    return rows


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every whole text; empty and null texts get the bias alone, repeated rows repeat."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sliced(_scores(model)), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, by a model of ``labels``.

    Rows with a null doc_id are scored and not held out; they are never learned from.
    """
    scored = score(docs, train(docs, labels))
    held = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _kept(model: tuple[np.ndarray, np.ndarray], at_least: float):
    scores = _scores(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (got,) = scores(iter([batch.select(["doc_id", "text"])])) if batch.num_rows else (None,)
            if got is not None:
                yield batch.filter(pc.less(got.column(1), at_least))

    return rows


def drop_toxic(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``at_least``; all columns stay, whatever the doc_id, null and repeated ones included."""
    model = train(docs, labels)
    return docs.mapInArrow(sliced(_kept(model, at_least)), docs.schema)
