"""Token ids in fixed-width bit-packed files (operator 5).

A file row holds one container: a header, its documents' ids and lengths, the byte
offset of each block, and the blocks.  Every id takes the fewest bits that the
vocabulary needs; a block holds ``BLOCK_IDS`` ids and starts on a byte, so numpy unpacks
any block without the ones before it.  Spark's writer stores the rows, so containers live in any
store that Spark can write, and a lost executor's files are never half there.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import fresh_path, sliced
from quern.llm.tokens import vocabulary_path, worker_tokenizer

MAGIC = b"QTOK"
#: Ids in a block; a multiple of 8, so that every block but the last fills whole bytes.
BLOCK_IDS = 4096
#: Ids after which a container closes; a document is never split over two.
CONTAINER_IDS = 1 << 18
END_ID = 1
_HEAD = struct.Struct("<4sBxHIQQ")  # magic, bits, -, block ids, documents, ids


def bits_for(vocabulary: int) -> int:
    """Fewest bits that hold ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as big-endian fields of ``bits`` bits, filled up to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :]).tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


def container(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """One container's bytes."""
    blocks = [pack(ids[i : i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = _HEAD.pack(MAGIC, bits, BLOCK_IDS, len(lengths), len(ids), len(blocks))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), offsets.tobytes(), *blocks])


class Container:
    """Random access to a container's ids and documents."""

    def __init__(self, data: bytes):
        self.data = data
        magic, self.bits, self.block, self.n_docs, self.n_ids, self.n_blocks = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token container")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        self.lengths = np.frombuffer(data, "<u4", self.n_docs, at := at + 8 * self.n_docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", self.n_blocks + 1, at := at + 4 * self.n_docs)
        self.base = at + 8 * (self.n_blocks + 1)

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n; only the blocks that hold them are unpacked."""
        first, last = start // self.block, -(-(start + n) // self.block)
        parts = []
        for k in range(first, last):
            lo, hi = (self.base + int(x) for x in self.offsets[k : k + 2])
            parts.append(unpack(self.data[lo:hi], min(self.block, self.n_ids - k * self.block), self.bits))
        return np.concatenate(parts)[start - first * self.block :][:n] if parts else np.zeros(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        """Ids of the container's k-th document."""
        return self.ids(int(self.lengths[:k].sum()), int(self.lengths[k]))


FILE_SCHEMA = "part int, seq int, start_in_part long, n_docs long, n_ids long, null_docs array<int>, payload binary"


def _containers(path: str, end_id: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(path)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        bits = bits_for(max(tok.size, end_id + 1))
        docs: list[np.ndarray] = []
        nulls: list[np.ndarray] = []
        lens: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, start, held
            ids = np.concatenate(parts)
            none = np.flatnonzero(np.concatenate(nulls)).tolist()
            data = container(np.concatenate(docs), n := np.concatenate(lens), ids, bits)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([len(n)], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([none], pa.list_(pa.int32())), pa.array([data], pa.binary())],
                names=["part", "seq", "start_in_part", "n_docs", "n_ids", "null_docs", "payload"],
            )
            seq, start, held = seq + 1, start + len(ids), 0
            for x in (docs, nulls, lens, parts):
                x.clear()
            return out

        for batch in batches:
            key = batch.column(0)
            key_null = key.is_null().to_numpy(zero_copy_only=False)
            key = key.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, ids, n in tok.encode_batches(batch.column(1)):
                ends = np.cumsum(n)
                ids = np.insert(ids, ends, end_id)  # after each document's last id
                n = n + 1
                ends = np.cumsum(n)
                at = 0
                while at < len(n):
                    before = int(ends[at - 1]) if at else 0
                    stop = int(np.searchsorted(ends, before + CONTAINER_IDS - held)) + 1
                    stop = min(max(stop, at + 1), len(n))
                    docs.append(key[lo + at : lo + stop])
                    nulls.append(key_null[lo + at : lo + stop])
                    lens.append(n[at:stop])
                    parts.append(ids[before : int(ends[stop - 1])])
                    held += len(parts[-1])
                    at = stop
                    if held >= CONTAINER_IDS:
                        yield flush()
        if docs:
            yield flush()
        pa.default_memory_pool().release_unused()

    return rows


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID) -> None:
    """Encode every whole text of ``docs`` (doc_id, text) and write containers under ``path`` in doc_id order.

    Null texts count as empty and hold the end id alone; null doc_ids come first; rows of
    one doc_id lie by their texts' hashes, so that no task needs all of them; repeated rows are repeated.  One range shuffle of the texts
    sets the order.  Parts are numbered in that order and a container knows its start in
    its part, so no task sees more than its own range.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # hashes and row numbers part the rows of one doc_id, and equal rows; texts would be sampled whole for the ranges
    rows = rows.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(n, "doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    ranged.select("doc_id", "text").mapInArrow(sliced(_containers(vocabulary or vocabulary_path(), end_id)), FILE_SCHEMA).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            (row,) = batch.slice(k, 1).to_pylist()
            box = Container(row["payload"])
            ids = box.ids(0, box.n_ids).astype("<u4").tobytes()
            ends = np.cumsum(box.lengths)
            starts = ends - box.lengths
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            none = np.zeros(box.n_docs, bool)
            none[row["null_docs"]] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(box.doc_ids, pa.int64(), mask=none), pa.array(starts + row["start"], pa.int64()), pa.array(box.lengths, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32.

    Part offsets are prefix sums over one row for each part, never for each document.
    """
    from pyspark.sql import Window

    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = files.join(F.broadcast(offsets), "part").select((F.col("base") + F.col("start_in_part")).alias("start"), "null_docs", "payload")
    return placed.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_digests(docs: DataFrame) -> DataFrame:
    """Write all documents' token files to the shared folder and read them back."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_token_files(docs, path)
    return read_token_files(docs.sparkSession, path)
