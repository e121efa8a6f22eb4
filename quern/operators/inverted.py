"""A stored inverted index, dealt by documents: each range of documents holds its own postings, and BM25 is worked out range by range.

A document belongs to one of the index's ranges by a hash of its id.  A range is one row: its documents, its terms in order, and for
each term the places and counts of the documents that hold it.  So an index is written with one exchange of the texts, and a search
moves nothing but the best k of each range.  Within a task the k-th best score so far of a query is a threshold for the ranges that follow.
The answer is exact.

An index is a folder of segments.  New and changed documents come as a further segment, removed ones as marks in one; the last
segment that names a document is the one that counts, and ``compact`` writes what counts as a single segment.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.operators.retrieval import best

#: Documents of a range, about.
RANGE_DOCS = 2048
#: Pairs of queries and terms that are told to all tasks at once; more take further scans of the index.
TOLD = 2_000_000
#: Documents whose places are told to all tasks, where not all count; those of more are joined by shuffle.
TOLD_DOCS = 8_000_000
#: Products of a task's step, and queries that meet a range together; they bound its memory.
STEP, TOGETHER = 1_000_000, 512
#: Share of pairs of documents and queries from which a term is part of a matrix product; such terms at most.
DENSE, MOST_DENSE = 0.01, 4096


def _ints(column: pa.Array, row: int) -> np.ndarray:
    return np.frombuffer(column[row].as_py(), "<i4")


def _packed(number: int, docs: pa.StructArray, names: pa.Array, code: np.ndarray, place: np.ndarray, tf: np.ndarray | None, schema: pa.Schema) -> pa.Table:
    """The row of a range from postings (code of a name, place of a document), repeated ones counted where ``tf`` is not given."""
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    key = rank[code] * max(1, len(docs)) + place if len(code) else np.zeros(0, np.int64)
    if tf is None:
        key, tf = np.unique(key, return_counts=True)
    else:
        at = np.argsort(key, kind="stable")
        key, tf = key[at], tf[at]
    term, place = np.divmod(key, max(1, len(docs)))
    starts = np.searchsorted(term, np.arange(len(order) + 1))
    one = lambda x: pa.array([x.astype("<i4").tobytes()], pa.binary())
    listed = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x).cast(kind)
    columns = [pa.array([number], pa.int64()), listed(docs, schema.field("docs").type), listed(names.take(pa.array(order)), pa.list_(pa.string())), one(starts), one(place), one(tf)]
    return pa.Table.from_arrays(columns, schema=schema)


def _indexed(columns: list[str], schema: pa.Schema):
    """Rows of one range (range, doc_id, words, columns) as its row of the index."""

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("doc_id").combine_chunks()
        words = pc.ascii_split_whitespace(rows["words"].combine_chunks())
        length = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        held = words.flatten()
        blank = pc.equal(held, "").to_numpy(zero_copy_only=False)
        doc = np.repeat(np.arange(len(length)), length)[~blank]
        coded = held.filter(pa.array(~blank)).dictionary_encode()
        dl = np.bincount(doc, minlength=len(length)).astype(np.int32)
        fields = [rows["doc_id"].combine_chunks(), pa.array(dl), pa.array(np.arange(len(length), dtype=np.int32)), *(rows[c].combine_chunks() for c in columns)]
        docs = pa.StructArray.from_arrays(fields, names=["doc_id", "dl", "place", *columns])
        return _packed(rows["range"][0].as_py(), docs, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), doc, None, schema)

    return build


def _merged(schema: pa.Schema):
    """Rows of one range (the index's columns, live) as one, of the documents that are live."""

    def build(rows: pa.Table) -> pa.Table:
        docs, names, codes, places, counts, base, shift = [], [], [], [], [], 0, 0
        for batch in rows.combine_chunks().to_batches():
            for row in range(batch.num_rows):
                held = batch.column("docs")[row].values
                live = np.sort(np.asarray(batch.column("live")[row].as_py(), np.int64))
                new = np.full(len(held), -1, np.int64)
                new[live] = np.arange(len(live)) + base
                starts, place, tf = (_ints(batch.column(c), row) for c in ("starts", "at", "tf"))
                code, stays = np.repeat(np.arange(len(starts) - 1), np.diff(starts)), new[place] >= 0
                docs.append(held.take(pa.array(live)))
                names.append(batch.column("terms")[row].values)
                codes.append(code[stays] + shift)
                places.append(new[place][stays])
                counts.append(tf[stays])
                base, shift = base + len(live), shift + len(names[-1])
        whole = pa.concat_arrays(docs)
        order = pc.sort_indices(whole.field("doc_id")).to_numpy()
        to = np.empty(len(order), np.int64)
        to[order] = np.arange(len(order))
        fields = {f.name: whole.field(f.name).take(pa.array(order)) for f in whole.type} | {"place": pa.array(np.arange(len(order), dtype=np.int32))}
        coded = pa.concat_arrays(names).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[np.concatenate(codes)]
        used, code = np.unique(code, return_inverse=True)  # terms that no live document holds are gone
        ordered = pa.StructArray.from_arrays(list(fields.values()), names=list(fields))
        return _packed(rows["range"][0].as_py(), ordered, coded.dictionary.take(pa.array(used)), code, to[np.concatenate(places)], np.concatenate(counts), schema)

    return build


class _Range:
    """A range's postings of the terms asked for: ``local`` terms by their numbers in ``asked``, without documents that do not count."""

    def __init__(self, batch: pa.RecordBatch, row: int, asked: pa.Array):
        held = batch.column("docs")[row].values
        self.ids, self.dl = held.field("doc_id"), held.field("dl").to_numpy(zero_copy_only=False)
        found = pc.fill_null(pc.index_in(batch.column("terms")[row].values, value_set=asked), -1).to_numpy(zero_copy_only=False)
        starts, place, tf = (_ints(batch.column(c), row) for c in ("starts", "at", "tf"))
        n = np.diff(starts)
        stays = np.repeat(found >= 0, n)
        if "live" in batch.schema.names:
            live = np.zeros(len(self.dl), bool)
            live[batch.column("live")[row].values.to_numpy(zero_copy_only=False)] = True
            stays &= live[place]
        term = np.repeat(found, n)[stays]
        order = np.argsort(term, kind="stable")
        self.term, self.place, self.tf = term[order].astype(np.int64), place[stays][order].astype(np.int64), tf[stays][order].astype(np.float64)


def _counted(told):
    """(term, df): in how many documents that count each term asked for stands, for each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = told.value
        df = np.zeros(len(asked), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                df += np.bincount(_Range(batch, row, asked).term, minlength=len(df))
        yield pa.RecordBatch.from_arrays([asked.filter(pa.array(df > 0)), pa.array(df[df > 0])], names=["term", "df"])

    return count


def _expanded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts ``n`` the number of each one's owner, and its place within it."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)


def _sums(r: _Range, part: np.ndarray, starts: np.ndarray, own: np.ndarray, term: np.ndarray, times: np.ndarray, queries: int) -> np.ndarray:
    """By query and document about the scores: terms that stand in many documents and queries by a matrix product, the others posting by posting."""
    docs, n = len(r.dl), np.diff(starts)
    dense = np.flatnonzero(n * np.bincount(term, minlength=len(n)) > DENSE * docs * queries)[:MOST_DENSE]
    column = np.full(len(n), -1)
    column[dense] = np.arange(len(dense))
    which, step = _expanded(n[dense])
    at = starts[dense][which] + step
    w, q = np.zeros((len(dense), docs), np.float32), np.zeros((queries, len(dense)), np.float32)
    w[which, r.place[at]] = part[at]
    thick = column[term] >= 0
    q[own[thick], column[term[thick]]] = times[thick]
    s = q @ w
    thin = np.flatnonzero(~thick)
    load = np.cumsum(n[term[thin]])
    for piece in np.split(thin, np.searchsorted(load, np.arange(STEP, load[-1], STEP))) if len(thin) else ():
        which, step = _expanded(n[term[piece]])
        at = starts[term[piece]][which] + step
        s += np.bincount(own[piece][which] * docs + r.place[at], times[piece][which] * part[at], minlength=queries * docs).reshape(s.shape)
    return s


def _scored(told, k: int, k1: float, b: float):
    """(query_id, doc_id, score): of each range those that may be of a query's k best.  Sums choose documents, which are then scored term by term."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ids, owner, number, qn, idf, avgdl = told.value  # entries by query and term
        tops = np.full((len(ids), k), -np.inf)  # the k best scores of each query so far, ascending
        names = len(asked)
        for batch in batches:
            for row in range(batch.num_rows):
                r = _Range(batch, row, asked)
                docs = len(r.dl)
                starts = np.searchsorted(r.term, np.arange(names + 1))
                part = idf[r.term] * r.tf * (k1 + 1) / (r.tf + k1 * (1 - b + b * r.dl[r.place] / avgdl))
                there = np.flatnonzero(np.diff(starts)[number])
                own, term, times = owner[there], number[there], qn[there]
                forward = np.lexsort((r.term, r.place))
                f_term, f_part, f_starts = r.term[forward], part[forward], np.searchsorted(r.place[forward], np.arange(docs + 1))
                keys = own * names + term
                for q0 in range(0, len(ids), TOGETHER):
                    q1 = min(q0 + TOGETHER, len(ids))
                    e = slice(*np.searchsorted(own, [q0, q1]))
                    if e.start == e.stop:
                        continue
                    s = _sums(r, part, starts, own[e] - q0, term[e], times[e], q1 - q0)
                    low = tops[q0:q1, 0]
                    if docs > k and np.isneginf(low).any():
                        low = np.maximum(low, np.partition(s, docs - k, axis=1)[:, docs - k])
                    floor = np.where(np.isneginf(low), low, low - 1e-4 * (1 + np.abs(low)))
                    q, d = np.nonzero((s > 0) & (s >= floor[:, None]))
                    got = np.zeros(len(q))
                    for c in range(0, len(q), 5_000):
                        p = slice(c, c + 5_000)
                        which, step = _expanded(f_starts[d[p] + 1] - f_starts[d[p]])
                        pos = f_starts[d[p]][which] + step
                        wanted = (q[p] + q0)[which] * names + f_term[pos]
                        hit = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                        good = keys[hit] == wanted
                        got[p] = np.bincount(which[good], times[hit[good]] * f_part[pos[good]], minlength=len(q[p]))
                    got = np.round(got, 9)
                    q = q + q0
                    keep = (got > 0) & (got >= tops[q, 0])
                    q, d, got = q[keep], d[keep], got[keep]
                    order = np.lexsort((d, -got, q))
                    q, d, got = q[order], d[order], got[order]
                    first = np.arange(len(q)) - np.searchsorted(q, q) < k
                    q, d, got = q[first], d[first], got[first]
                    for one, begin, n in zip(*np.unique(q, return_index=True, return_counts=True)):
                        tops[one] = np.sort(np.concatenate([tops[one], got[begin : begin + n]]))[-k:]
                    if len(q):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), r.ids.take(pa.array(d)), pa.array(got)], names=["query_id", "doc_id", "score"])

    return score


class InvertedIndex:
    """The index under ``path``; ``columns`` of the documents are kept for filters."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        facts = spark.read.parquet(f"{self.path}/facts").orderBy(F.desc("segments")).first()
        self.ranges, self.segments, self.columns = facts.ranges, facts.segments, list(facts.columns)

    @classmethod
    def create(cls, docs: DataFrame, path: str, columns: tuple[str, ...] = (), range_docs: int = RANGE_DOCS) -> InvertedIndex:
        """Index ``docs`` (doc_id, text, columns) under a new ``path``.

        Rows without a doc_id are left out, as nothing could name them; of rows of one doc_id the one with the greatest hash of its text counts.  A null text has no words.
        """
        spark = docs.sparkSession
        ranges = max(1, -(-docs.count() // range_docs))
        cls._facts(spark, path, ranges, 0, columns, "errorifexists")
        index = cls(spark, path)
        index.add(docs)
        return index

    @staticmethod
    def _facts(spark: SparkSession, path: str, ranges: int, segments: int, columns, mode: str) -> None:
        spark.createDataFrame([(ranges, segments, list(columns))], "ranges long, segments int, columns array<string>").coalesce(1).write.mode(mode).parquet(f"{path.rstrip('/')}/facts")

    def _next(self) -> None:
        self.segments += 1
        self._facts(self.spark, self.path, self.ranges, self.segments, self.columns, "append")

    def add(self, docs: DataFrame) -> None:
        """New or changed ``docs`` (doc_id, text, columns) as a further segment; they replace all postings of the same doc_ids.

        Texts move once, to their range, and need no further exchange.  Readers see the segment once it is whole.
        """
        ranged = docs.where("doc_id IS NOT NULL").withColumns({"range": F.pmod(F.xxhash64("doc_id"), F.lit(self.ranges)), "h": F.xxhash64("text")})
        words = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " ")).alias("words")  # those of ``tokens``
        dealt = ranged.select("range", "doc_id", "h", words, *self.columns).repartition("range")
        last = dealt.withColumn("place", F.row_number().over(Window.partitionBy("range", "doc_id").orderBy(F.desc("h")))).where("place = 1")
        schema = self._schema(docs)
        rows = last.select("range", "doc_id", "words", *self.columns).groupBy("range").applyInArrow(_indexed(self.columns, self._arrow(schema)), schema)
        self._write(rows, self.path, self.segments)
        self._next()

    def _schema(self, docs: DataFrame) -> str:
        kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
        fields = ",".join([f"doc_id:{kinds['doc_id']}", "dl:int", "place:int", *(f"`{c}`:{kinds[c]}" for c in self.columns)])
        return f"range long, docs array<struct<{fields}>>, terms array<string>, starts binary, at binary, tf binary"

    def _arrow(self, schema: str) -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(self.spark.createDataFrame([], schema).schema)

    def _write(self, rows: DataFrame, path: str, segment: int) -> None:
        rows.write.parquet(f"{path}/ranges/segment={segment}")
        docs = self.spark.read.schema(rows.schema).parquet(f"{path}/ranges/segment={segment}").select("range", F.inline("docs"))
        docs.withColumn("removed", F.lit(False)).write.parquet(f"{path}/documents/segment={segment}")

    def remove(self, ids: DataFrame) -> None:
        """Marks that the documents of ``ids`` (doc_id) are gone."""
        gone = ids.select("doc_id").where("doc_id IS NOT NULL").distinct()
        kinds = {f.name: f.dataType for f in self._documents().schema.fields}
        rows = gone.select(F.lit(0).cast("long").alias("range"), F.col("doc_id").cast(kinds["doc_id"]), F.lit(0).alias("dl"), F.lit(0).alias("place"), *(F.lit(None).cast(kinds[c]).alias(c) for c in self.columns))
        rows.withColumn("removed", F.lit(True)).write.parquet(f"{self.path}/documents/segment={self.segments}")
        self._next()

    def compact(self, path: str) -> InvertedIndex:
        """What counts of all segments as one, under a new ``path``."""
        out_at = path.rstrip("/")
        self._facts(self.spark, out_at, self.ranges, 1, self.columns, "errorifexists")
        rows = self._ranges(self.documents())
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("segment", "live").schema.fields)
        merged = rows.drop("segment").groupBy("range").applyInArrow(_merged(self._arrow(schema)), schema)
        self._write(merged, out_at, 0)
        return InvertedIndex(self.spark, out_at)

    def _documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents").where(F.col("segment") < self.segments)

    def documents(self) -> DataFrame:
        """(doc_id, range, dl, place, columns, segment) of the documents that count."""
        if self.segments == 1:
            return self._documents().where("NOT removed").drop("removed")
        last = self._documents().groupBy("doc_id").agg(F.max("segment").alias("segment"))
        return self._documents().join(last, ["doc_id", "segment"]).where("NOT removed").drop("removed")

    def _ranges(self, live: DataFrame | None = None) -> DataFrame:
        """The index's rows, of ``live`` documents (segment, range, place) if not of all: ``live`` has their places."""
        rows = self.spark.read.parquet(f"{self.path}/ranges").where(F.col("segment") < self.segments)
        if live is None:
            return rows
        places = live.groupBy("segment", "range").agg(F.collect_list("place").alias("live"))
        return rows.join(F.broadcast(places) if live.count() <= TOLD_DOCS else places, ["segment", "range"])

    def search(self, queries: DataFrame, k: int, where: Column | str | None = None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
        """(query_id, doc_id, score, rank) of the k best documents for each of ``queries`` (query_id, text), ``where`` over the kept columns holds.

        Scores and ties are those of ``retrieval.bm25``: document counts, lengths and frequencies are of the documents that count and that ``where`` lets through, a term counts as often as
        its query repeats it.  No text is read and no posting moves.  Queries are told to all tasks, TOLD pairs with their terms at a time.
        """
        q = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qn"))
        live = self.documents() if where is None else self.documents().where(where)
        n_docs, avgdl = live.agg(F.count(F.lit(1)), F.avg("dl")).first()
        rows = self._ranges(None if where is None and self.segments == 1 else live)
        tell = self.spark.sparkContext.broadcast
        asked = q.select("term").distinct().toArrow()["term"].combine_chunks()
        df = rows.mapInArrow(_counted(tell(asked)), "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
        order = pc.sort_indices(df["term"])
        terms, counts = df["term"].combine_chunks().take(order), df["df"].combine_chunks().take(order).to_numpy(zero_copy_only=False)
        idf = np.log((n_docs - counts + 0.5) / (counts + 0.5) + 1)
        kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "doc_id": self._documents().schema["doc_id"].dataType.simpleString()}
        schema = f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double"
        blocks, out = max(1, -(-q.count() // TOLD)), None
        for block in range(blocks):
            part = q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
            told = self._entries(part, terms)
            found = rows.mapInArrow(_scored(tell((terms, *told, idf, avgdl)), k, k1, b), schema)
            out = found if out is None else out.unionByName(found)
        return best(out, ["query_id"], k, F.desc("score"), F.col("doc_id"))

    @staticmethod
    def _entries(q: DataFrame, terms: pa.Array) -> tuple:
        """Ids of ``q`` (query_id, term, qn), and by query and term: number of the query, number of the term, count; without terms that no document holds."""
        t = q.groupBy("term").agg(F.collect_list("query_id").alias("ids"), F.collect_list("qn").alias("qn")).toArrow()  # a term once
        number = pc.fill_null(pc.index_in(t["term"].combine_chunks(), value_set=terms), -1).to_numpy(zero_copy_only=False)
        ids, qn = t["ids"].combine_chunks(), t["qn"].combine_chunks()
        number = np.repeat(number, pc.list_value_length(ids).to_numpy(zero_copy_only=False))
        coded = ids.flatten().dictionary_encode()
        owner = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.lexsort((number, owner))
        order = order[number[order] >= 0]
        return coded.dictionary, owner[order], number[order].astype(np.int64), qn.flatten().to_numpy(zero_copy_only=False)[order].astype(np.float64)
