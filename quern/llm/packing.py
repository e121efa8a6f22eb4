"""Hierarchical packing of token ids into several context lengths (operator 3).

Every length is a power of two.  Documents longer than the largest tier give whole
windows first; what is left goes to the smallest tier that holds it.  Tiers are packed
from the longest down: a sequence opens with a document of its tier, its gap takes the
largest documents of shorter tiers that still fit, and the last gap takes a piece cut
from the longest of them.  So each sequence is full, and only a group's tail, cut into
powers of two, is shorter.  Last, each tier's sequences are dealt to step groups of equal
attention cost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import sliced
from quern.llm.tokens import vocabulary_path, worker_tokenizer

TIERS = (256, 512, 1024, 2048)
#: Ids packed together in a task; bounds its memory.
GROUP_IDS = 4 << 20
#: Sequences of one tier in a step.
STEP_SEQUENCES = 16
END_ID = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class _Shelf:
    """Remaining pieces by length; the longest that fits is found by one bit scan."""

    def __init__(self, longest: int):
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.mask = 0

    def put(self, doc: int, start: int, length: int) -> None:
        self.at[length].append((doc, start))
        self.mask |= 1 << length

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``most`` ids."""
        if not (fits := self.mask & ((2 << most) - 1)):
            return None
        length = fits.bit_length() - 1
        doc, start = self.at[length].pop()
        if not self.at[length]:
            self.mask &= ~(1 << length)
        return doc, start, length


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """(tier, pieces (document, start, length)) of sequences that hold every id once, each exactly full.

    Tiers are ascending powers of two.  Only the tail of the whole call is in sequences
    below the smallest tier; they are powers of two as well.
    """
    longest = tiers[-1]
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    shelf = _Shelf(longest)
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        out += [(longest, [(doc, s, longest)]) for s in range(0, whole, longest)]
        if n > whole:
            shelf.put(doc, whole, n - whole)
    left = sum(n % longest for n in lengths)
    powers = [1 << k for k in range(longest.bit_length() - 1, -1, -1)]
    while left:
        top = shelf.mask.bit_length() - 1
        tier = next((t for t in tiers if t >= top), longest)  # the tier of the longest piece there is
        if tier > left:
            tier = next(p for p in powers if p <= left)
        room, pieces = tier, []
        while room:
            got = shelf.take(room)
            if got is None:  # cut the gap from the longest piece
                doc, start, n = shelf.take(longest)
                shelf.put(doc, start + room, n - room)
                got = doc, start, room
            pieces.append(got)
            room -= got[2]
        out.append((tier, pieces))
        left -= tier
    return out


def step_groups(sequences: list[tuple[int, list[tuple[int, int, int]]]], size: int = STEP_SEQUENCES) -> list[int]:
    """A step group for each sequence: one tier each, about ``size`` sequences, near-equal sums of squared piece lengths."""
    out, base = [0] * len(sequences), 0
    for tier in sorted({t for t, _ in sequences}):
        own = [k for k, (t, _) in enumerate(sequences) if t == tier]
        own.sort(key=lambda k: -sum(p[2] * p[2] for p in sequences[k][1]))
        groups = -(-len(own) // size)
        for i, k in enumerate(own):
            turn, place = divmod(i, groups)
            out[k] = base + (groups - 1 - place if turn % 2 else place)
        base += groups
    return out


def _packed(path: str, tiers: tuple[int, ...], end_id: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = worker_tokenizer(path)
        high = TaskContext.get().partitionId() << 36
        sequence, step = high, high
        keys: list = []
        texts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, step, held
            plan = pack_lengths([len(x) for x in texts], tiers)
            groups = step_groups(plan)
            cols: list[list] = [[] for _ in range(9)]
            for (tier, pieces), group in zip(plan, groups):
                offset = 0
                for doc, start, n in pieces:
                    ids = texts[doc]
                    crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
                    for c, v in zip(cols, (keys[doc], start, n, crc, len(ids), sequence, offset, tier, step + group)):
                        c.append(v)
                    offset += n
                sequence += 1
            step += max(groups, default=-1) + 1
            keys.clear()
            texts.clear()
            held = 0
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for batch in batches:
            ids_of = batch.column(0).to_pylist()
            for lo, ids, n in tok.encode_batches(batch.column(1)):
                ids = np.insert(ids, np.cumsum(n), end_id)
                ends = np.cumsum(n + 1).tolist()
                begin = 0
                for k, stop in enumerate(ends):
                    keys.append(ids_of[lo + k])
                    texts.append(ids[begin:stop])
                    begin = stop
                held += len(ids)
                if held >= GROUP_IDS:
                    yield flush()
        if keys:
            yield flush()
        pa.default_memory_pool().release_unused()

    return rows


def pack_documents(docs: DataFrame, vocabulary: str | None = None, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID) -> DataFrame:
    """Pack every document (doc_id, text) into full sequences; one row for each piece.

    Null and empty texts hold the end id alone.  Repeated rows, and rows with a null doc_id, are documents of their own;
    no other column is looked at.
    Each task packs its own input split, so nothing is shuffled and a lost task is done
    again alone; a task leaves at most eleven short sequences, none of them padded.
    """
    src = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return src.mapInArrow(sliced(_packed(vocabulary or vocabulary_path(), tiers, end_id)), SCHEMA)
