"""Near-duplicate embeddings by an epsilon grid order join (operator 8).

Unit vectors with cosine of at least COSINE lie within EPS of each other, and so do their
projections on any principal axes.  Vectors are put in epsilon grid order: by label, then by the cells of
side EPS of their leading principal coordinates.  The sequence is cut into blocks with bounding boxes; pairs of blocks whose boxes lie
more than EPS apart are never joined, and within a pair the halves of the sequence
are joined recursively under the same rule, down to leaves that one matrix product compares.
Blocks lie in runs, and a task joins the pairs of blocks between two runs, so a block moves once for each run that it meets, not for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import join_counted, written
from quern.llm.components import connected_components

COSINE = 0.98
#: Largest distance of unit vectors that reach COSINE, and room for rounding.
EPS = float(np.sqrt(2 - 2 * COSINE)) * (1 + 1e-9) + 1e-9
#: Leading principal axes: of the grid order, and of the bounding boxes.
ORDER_DIMS, BOX_DIMS = 4, 16
#: Vectors that the axes are fitted on; any axes give right results, these prune well.
FIT_ROWS = 4096
#: Vectors of a block, and bytes of them, at most; vectors of a leaf.
BLOCK, BLOCK_BYTES, LEAF = 8192, 4 << 20, 128
#: Neighbouring blocks that meet those of another run in one task.
RUN = 4
#: Parts that the blocks of a label and cell are dealt to when they look for partners.
SALTS = 16


def principal_axes(vectors: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """(dim, BOX_DIMS) orthonormal axes from a bounded sample: the fit_rows vectors with the least hash of their id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("embedding").toPandas()["embedding"]
    if not len(rows):
        return np.zeros((1, 1))
    dim = max(map(len, rows))
    x = np.array([r for r in rows if len(r) == dim], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.linalg.eigh(np.cov(x.T, bias=True).reshape(dim, dim))[1][:, ::-1][:, :BOX_DIMS].copy()


def _projected(axes: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            emb = batch.column("embedding")
            size = emb.value_lengths().to_numpy()
            cells = np.zeros((len(emb), ORDER_DIMS), np.int32)
            own = size == len(axes)
            if own.any():
                x = _unit(emb.flatten().to_numpy()[np.repeat(own, size)].reshape(-1, len(axes)).astype(np.float64))
                c = np.floor(x @ axes[:, :ORDER_DIMS] / EPS)
                cells[own, : c.shape[1]] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(cells[:, d]) for d in range(ORDER_DIMS))], names=[*batch.schema.names, *(f"c{d}" for d in range(ORDER_DIMS))])

    return rows


def _unit(flat: np.ndarray) -> np.ndarray:
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _blocks(axes: np.ndarray):
    """Runs of one label and dimension, at most BLOCK vectors and BLOCK_BYTES each, with the box of their projections."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # nodes, copies, vectors of slices of one run
        run, most = (None, None), BLOCK

        def flush():
            nonlocal seq, held
            node, copies, x = (np.concatenate(c) for c in zip(*held))
            box = _unit(x.astype(np.float64)) @ axes if x.shape[1] == len(axes) else np.zeros((len(x), 1))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([(part << 32) + seq], pa.int64()),
                    pa.array([run[0]], pa.int64()),
                    pa.array([x.shape[1]], pa.int32()),
                    pa.array([box.min(axis=0).tolist()], pa.list_(pa.float64())),
                    pa.array([box.max(axis=0).tolist()], pa.list_(pa.float64())),
                    pa.array([node.tolist()], pa.list_(pa.int64())),
                    pa.array([copies.tolist()], pa.list_(pa.int64())),
                    pa.array([x.tobytes()], pa.binary()),
                ],
                names=["block", "label", "dim", "lo", "hi", "ids", "copies", "vectors"],
            )
            seq += 1
            held = []
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            emb = batch.column("embedding")
            label, node, copies = (batch.column(c).to_numpy() for c in ("label", "node", "copies"))
            size = emb.value_lengths().to_numpy()
            flat, ends = emb.flatten().to_numpy(), np.cumsum(size)
            cuts = np.flatnonzero((np.diff(label) != 0) | (np.diff(size) != 0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(label)]):
                if held and run != (int(label[lo]), int(size[lo])):
                    yield flush()
                run = int(label[lo]), int(size[lo])
                most = max(1, min(BLOCK, BLOCK_BYTES // (run[1] * flat.itemsize)))
                x = flat[ends[lo] - size[lo] : ends[hi - 1]].reshape(hi - lo, -1)
                while lo < hi:
                    n = min(hi - lo, most - sum(len(h[0]) for h in held))
                    held.append((node[lo : lo + n], copies[lo : lo + n], x[:n].copy()))
                    lo, x = lo + n, x[n:]
                    if sum(len(h[0]) for h in held) >= most:
                        yield flush()
        if held:
            yield flush()

    return rows


BLOCK_SCHEMA = "block long, label long, dim int, lo array<double>, hi array<double>, ids array<long>, copies array<long>, vectors binary"


def _apart(lo_a, hi_a, lo_b, hi_b) -> bool:
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap) > EPS * EPS


def join_intervals(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, same: bool):
    """(i, j) index arrays of rows of unit vectors x and y with cosine >= COSINE; each pair i < j once if ``same``.

    px and py are projections; a pair of intervals is dropped when their boxes lie more than EPS apart.
    """
    found_i, found_j = [], []
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and c < a:
            continue
        if _apart(px[a:b].min(axis=0), px[a:b].max(axis=0), py[c:d].min(axis=0), py[c:d].max(axis=0)):
            continue
        if b - a <= LEAF and d - c <= LEAF:
            i, j = np.nonzero(x[a:b] @ y[c:d].T >= COSINE - 1e-9)
            i, j = i + a, j + c
            exact = np.einsum("nd,nd->n", x[i], y[j]) >= COSINE
            i, j = i[exact], j[exact]
            if same:
                i, j = i[i < j], j[i < j]
            found_i.append(i)
            found_j.append(j)
            continue
        # halve on multiples of the leaf, both sides alike, so that i < j stays a matter of intervals
        half = lambda lo, hi: lo + max(LEAF, ((hi - lo) // 2 + LEAF - 1) // LEAF * LEAF) if hi - lo > LEAF else hi
        m, n = half(a, b), half(c, d)
        todo += [(p, q, r, s) for p, q in ((a, m), (m, b)) if q > p for r, s in ((c, n), (n, d)) if s > r]
    none = np.zeros(0, np.int64)
    return np.concatenate(found_i or [none]), np.concatenate(found_j or [none])


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node it reaches over links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if (label == before).all():
            return label


def _pairs(axes: np.ndarray, dtype: str):
    """Of a task's blocks and pairs of blocks: each vector's partners (copies counted) and the least node it reaches in a pair."""

    def join(blocks: pa.Table, pairs: pa.Table) -> pa.Table:
        held = {}
        for r in blocks.to_pylist():
            x = _unit(np.frombuffer(r["vectors"], dtype).reshape(-1, r["dim"]).astype(np.float64))
            held[r["block"]] = np.array(r["ids"], np.int64), np.array(r["copies"], np.int64), x, x @ axes if r["dim"] == len(axes) else np.zeros((len(x), 1))
        out = []
        for a, b in zip(pairs.column("block").to_pylist(), pairs.column("block2").to_pylist()):
            (ids, copies, x, px), (ids2, copies2, y, py) = held[a], held[b]
            i, j = join_intervals(x, y, px, py, a == b)
            if not len(i):
                continue
            if a != b:
                ids, copies, j = np.concatenate([ids, ids2]), np.concatenate([copies, copies2]), j + len(x)
            links = np.zeros(len(ids), np.int64)
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            own = links > 0
            out.append((ids[own], links[own], ids[_forest(i, j, len(ids))[own]]))
        cols = [np.concatenate(c) for c in zip(*out)] or [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("node", "links", "root"), map(pa.array, cols))))

    return join


def embedding_components(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Rows link when their labels are equal and not null and the cosine in double precision
    is at least COSINE.  Null, empty and zero vectors, and vectors with null or non-finite
    components link with nothing.  Equal vectors of a label are one node with a count, so copies
    make no pairs; vectors of different lengths never link.  Repeated and null vec_ids are rows of their own.
    Vectors move in the type they are stored in and are compared in double precision.
    """
    spark = vectors.sparkSession
    emb = F.col("embedding")
    good = F.coalesce(F.size(emb) > 0, F.lit(False)) & F.coalesce(F.forall(emb, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False)) & F.coalesce(F.exists(emb, lambda v: v != 0), F.lit(False)) & F.col("label").isNotNull()
    kind = "float" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "double"
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(emb, lambda v: v.cast(kind) + F.lit(0.0).cast(kind)).alias("embedding"), F.col("label").cast("long").alias("label"), good.alias("good"))
    # 128 bits name a vector of a label; nodes have numbers of their own
    base = base.withColumns({"h": F.xxhash64("embedding", "label"), "g": F.xxhash64(F.lit("second"), "label", "embedding")})
    nodes = base.where("good").groupBy("h", "g", "label", "embedding").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("vec_id"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    axes = principal_axes(nodes)
    cells = [f"c{d}" for d in range(ORDER_DIMS)]
    brief = nodes.select("node", "label", "copies", "embedding")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in brief.schema.fields) + "".join(f", {c} int" for c in cells)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = brief.mapInArrow(_projected(axes), schema).repartitionByRange(n, "label", *cells, "node").sortWithinPartitions("label", *cells, "node")
    blocks = written(ordered.drop(*cells).mapInArrow(_blocks(axes), BLOCK_SCHEMA), "blocks")
    # pairs of blocks: cells of side EPS of the first axis, each block over the cells its box (widened by half EPS) touches
    touched = lambda: F.sequence(F.floor((F.col("lo")[0] - EPS / 2) / EPS), F.floor((F.col("hi")[0] + EPS / 2) / EPS))
    boxes = blocks.select("block", "label", "dim", "lo", "hi", F.element_at(touched(), 1).alias("first"), F.explode(touched()).alias("cell"))
    other = boxes.select(F.col("block").alias("block2"), "label", "dim", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("first").alias("first2"), "cell", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    gaps = F.zip_with(F.zip_with("lo", "hi2", lambda a, b: a - b), F.zip_with("lo2", "hi", lambda a, b: a - b), lambda a, b: F.greatest(F.lit(0.0), a, b))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)
    boxes = boxes.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int"))
    pairs = boxes.join(other, ["label", "dim", "cell", "salt"]).where((F.col("block") <= F.col("block2")) & (F.col("cell") == F.greatest("first", "first2")) & (apart <= EPS * EPS)).select("block", "block2")
    pairs = written(pairs, "block-pairs")
    # a task joins the pairs between two runs of RUN blocks, and gets each of their blocks once
    run = blocks.select("block", F.floor((F.row_number().over(Window.partitionBy("label", "dim").orderBy("block")) - 1) / RUN).alias("k"), "label", "dim")
    run = written(run.select("block", F.struct("label", "dim", "k").alias("run")), "runs")
    dealt = pairs.join(run, "block").join(run.select(F.col("block").alias("block2"), F.col("run").alias("run2")), "block2")
    dealt = written(dealt.select(F.xxhash64("run", "run2").alias("task"), "block", "block2"), "dealt")
    needed = dealt.select("task", F.explode(F.array("block", "block2")).alias("block")).distinct()
    sent = needed.join(blocks.select("block", "dim", "ids", "copies", "vectors"), "block")
    of_task = dealt.select(F.col("task").alias("pairs_task"), "block", F.col("block2"))
    found = sent.groupBy("task").cogroup(of_task.groupBy("pairs_task")).applyInArrow(_pairs(axes, "<f4" if kind == "float" else "<f8"), "node long, links long, root long")
    found = written(found, "found")
    small = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    each = nodes.select("h", "g", "copies", "vec_id", "node").join(small, "node", "left").join(comp, "node", "left").withColumn("root", F.coalesce("component", "node"))
    each = written(each.select("h", "g", "copies", "vec_id", "root", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked")
    roots = written(each.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "roots")
    named = written(join_counted(each, roots, ["root"], "n").select("h", "g", "copies", "n_links", "component_id"), "named")
    out = join_counted(base.where("good").select("vec_id", "h", "g"), named, ["h", "g"], "copies").select("vec_id", "n_links", "component_id")
    out = out.unionByName(base.where(~F.col("good")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
    AND len(list_filter(embedding, lambda v: v <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), counted AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT v.vec_id, coalesce(c.n, 0) AS n_links, l.component_id, v.vec_id = l.component_id AS kept
FROM embeddings v LEFT JOIN counted c ON c.a = v.vec_id LEFT JOIN least l ON l.a = v.vec_id
"""
