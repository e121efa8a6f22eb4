"""Centroid clustering by dual-tree Lloyd rounds (operator 12).

Vectors are dealt into blocks of neighbours, and each block gets a cover tree once.  Every round builds the same tree
over the centroids and goes down both: a node of vectors keeps the centroid nodes that may hold the nearest centroid
of any of its vectors.  With q and p the centres and r, s the radii of two nodes, no vector is nearer to a centroid below p than
|q - p| - r - s, and every vector has a centroid within |q - p| + r, since a node's centre is one of its points.  What is left at
a leaf is compared exactly, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import written

DIM, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
#: Vectors of a block and of a leaf, centroids of a leaf.
BLOCK, LEAF, CENTROID_LEAF = 1024, 16, 1
#: Largest component for which every squared distance fits in 63 bits.
LARGEST = 1 << 27
#: Vectors that the axes of the blocks' order are fitted on, and number of axes; any axes give right results.
FIT_ROWS, AXES = 4096, 8


class CoverTree:
    """Nodes over the rows of ``points`` (n, d), each with a centre that is one of its points, a radius, and children or a leaf's rows.

    Children's centres cover their node within half of its radius and lie further apart than that; a node's own centre is its first child's.
    ``order`` lists the rows so that a node's are ``order[lo:hi]``.
    """

    def __init__(self, points: np.ndarray, leaf: int):
        self.points = points
        self.centre, self.radius, self.children, self.span = [], [], [], []
        self.order = np.arange(len(points))
        todo = [(0, len(points), None)] if len(points) else []
        while todo:
            lo, hi, parent = todo.pop()
            own = self.order[lo:hi]
            d = _distances(points[own], points[own[0]])
            node, radius = len(self.centre), float(d.max())
            self.centre.append(int(own[0]))
            self.radius.append(radius)
            self.children.append([])
            self.span.append((lo, hi))
            if parent is not None:
                self.children[parent].append(node)
            if hi - lo <= leaf or radius == 0:
                continue
            groups, left = [], own
            while len(left):
                near = d <= radius / 2
                groups.append(left[near])
                left = left[~near]
                if len(left):
                    d = _distances(points[left], points[left[0]])
            self.order[lo:hi] = np.concatenate(groups)
            ends = lo + np.cumsum([len(g) for g in groups])
            todo += [(int(end) - len(g), int(end), node) for g, end in zip(groups, ends)]


    def packed(self) -> tuple[bytes, bytes, bytes]:
        """The tree without its points: a row (centre, parent, lo, hi) for each node, radii, and the order of rows."""
        parent = np.full(len(self.centre), -1, np.int32)
        for node, children in enumerate(self.children):
            parent[children] = node
        nodes = np.column_stack([self.centre, parent, np.array(self.span).reshape(-1, 2)]).astype(np.int32)
        return nodes.tobytes(), np.array(self.radius).tobytes(), self.order.astype(np.int32).tobytes()

    @classmethod
    def unpacked(cls, points: np.ndarray, nodes: bytes, radius: bytes, order: bytes) -> CoverTree:
        """The tree of ``packed`` over the same points."""
        tree = cls.__new__(cls)
        rows = np.frombuffer(nodes, np.int32).reshape(-1, 4)
        tree.points, tree.order = points, np.frombuffer(order, np.int32)
        tree.centre, tree.radius, tree.span = rows[:, 0].tolist(), np.frombuffer(radius).tolist(), list(map(tuple, rows[:, 2:].tolist()))
        tree.children = [[] for _ in tree.centre]
        for node, parent in enumerate(rows[:, 1].tolist()):
            if parent >= 0:
                tree.children[parent].append(node)
        return tree


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x.astype(np.float64) - y
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def nearest(tree: CoverTree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller one) and squared distance of each of the tree's points, and exact comparisons made."""
    cluster, distance, compared = np.zeros(len(tree.points), np.int64), np.zeros(len(tree.points), np.int64), 0
    over = CoverTree(centroids, CENTROID_LEAF)
    centre, radius = np.array(over.centre), np.array(over.radius)
    inner = np.array([bool(c) for c in over.children])
    todo = [(0, np.zeros(1, np.int64))] if len(tree.points) else []
    while todo:
        node, held = todo.pop()
        q, r = tree.points[tree.centre[node]], tree.radius[node]
        while True:
            d = _distances(centroids[centre[held]], q)
            most = (d + r).min()
            stays = d - r - radius[held] <= most + 1e-9 * (most + 1)
            held = held[stays]
            wide = inner[held] & ((radius[held] > r) | (not tree.children[node]))
            if not wide.any():
                break
            held = np.concatenate([held[~wide], *(np.array(over.children[p]) for p in held[wide])])
        if tree.children[node]:
            todo += [(child, held) for child in tree.children[node]]
            continue
        numbers = np.sort(np.concatenate([over.order[slice(*over.span[p])] for p in held]))
        rows = tree.order[slice(*tree.span[node])]
        exact = np.square(tree.points[rows][:, None, :] - centroids[numbers]).sum(axis=2)
        best = exact.argmin(axis=1)
        cluster[rows], distance[rows] = numbers[best], exact[np.arange(len(rows)), best]
        compared += exact.size
    return cluster, distance, compared


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id long, v array<long>) of the rows of (vec_id, embedding) with DIM components, none null or non-finite."""
    emb = F.col("embedding")
    good = (F.size(emb) == DIM) & F.forall(emb, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    scaled = F.transform(emb, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))


def first_centroids(kept: DataFrame) -> np.ndarray:
    """The CENTROIDS vectors with the least SHA-256 of ``2:<vec_id>``; ties by the vectors, null ids last; all where there are fewer."""
    key = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(key.asc_nulls_last(), "v").limit(CENTROIDS).select("v").collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, DIM)


def _axes(kept: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal axes of the FIT_ROWS vectors with the least hash."""
    rows = kept.orderBy(F.xxhash64("vec_id", "v"), "v").limit(FIT_ROWS).select("v").collect()
    x = np.array([r.v for r in rows], np.float64).reshape(-1, DIM)
    if not len(x):
        return np.zeros(DIM), np.zeros((DIM, AXES))
    return x.mean(axis=0), np.linalg.eigh(np.cov(x.T, bias=True))[1][:, ::-1][:, :AXES].copy()


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)


def _celled(mean: np.ndarray, axes: np.ndarray):
    """Each vector with the signs of its leading coordinates as a cell."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component exceeds {LARGEST} / {SCALE}: its squared distances are no longs")
            cell = ((x - mean) @ axes > 0) @ (1 << np.arange(AXES)[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["vec_id", "v", "cell"])

    return rows


BLOCK_SCHEMA = "ids array<long>, vectors binary, nodes binary, radius binary, place binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of BLOCK vectors, each with its cover tree."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            x = _matrix(part.column("v"))
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
            parts = [x.tobytes(), *CoverTree(x, LEAF).packed()]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([p], pa.binary()) for p in parts)], names=["ids", "vectors", "nodes", "radius", "place"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, CoverTree]]:
    for batch in batches:
        for k in range(batch.num_rows):
            vectors, *tree = (batch.column(c)[k].as_py() for c in ("vectors", "nodes", "radius", "place"))
            yield batch.column("ids")[k].values, CoverTree.unpacked(np.frombuffer(vectors, np.int64).reshape(-1, DIM), *tree)


def _sums(centroids: np.ndarray):
    """(cluster, dim, n, total) of a task's vectors; the last dim, DIM, carries their number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), DIM + 1), np.int64)
        for _, tree in _trees(batches):
            cluster, _, _ = nearest(tree, centroids)
            np.add.at(total[:, :DIM], cluster, tree.points)
            total[:, DIM] += np.bincount(cluster, minlength=len(centroids))
        cluster, dim = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(total[cluster, dim])], names=["cluster", "dim", "total"])

    return rows


def _assigned(centroids: np.ndarray):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches):
            cluster, distance, _ = nearest(tree, centroids)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return rows


def moved(centroids: np.ndarray, sums: dict[tuple[int, int], int]) -> np.ndarray:
    """Floors of the means of all non-empty clusters; empty ones stay.  Sums are exact integers of any size."""
    out = centroids.copy()
    for k in range(len(centroids)):
        if n := sums.get((k, DIM), 0):
            out[k] = [sums.get((k, d), 0) // n for d in range(DIM)]
    return out


def cluster_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of ``vectors`` (vec_id, embedding).

    Rows with another number of components than DIM, or with a null or non-finite one, are not kept; null and repeated
    vec_ids and repeated rows are rows of their own; an empty table gives none.  Components beyond LARGEST / SCALE in size
    are an error, since their distances are no longs.  Blocks are stored once with their trees, a round reads them and sends CENTROIDS * (DIM + 1) sums to
    the driver, whatever the number of vectors; copies of one vector lie under one node of radius 0.
    """
    spark = vectors.sparkSession
    kept = written(integer_vectors(vectors), "integers")
    centroids = first_centroids(kept)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    celled = kept.mapInArrow(_celled(*_axes(kept)), "vec_id long, v array<long>, cell int")
    dealt = celled.repartitionByRange(n, "cell", F.xxhash64("v"), F.xxhash64("vec_id")).sortWithinPartitions("cell", "v")
    blocks = written(dealt.drop("cell").mapInArrow(_blocks, BLOCK_SCHEMA), "blocks")
    for _ in range(ROUNDS if len(centroids) else 0):
        sums = blocks.mapInArrow(_sums(centroids), "cluster int, dim int, total long").groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        new = moved(centroids, {(r.cluster, r.dim): int(r.total) for r in sums.collect()})
        if (new == centroids).all():
            break
        centroids = new
    each = written(blocks.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned")
    names = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    per = each.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(F.broadcast(named), "cluster")
    per = per.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))  # over one row for each centroid
    return each.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds spelled out one after another, in exact integers."""
    dist = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    parts = [
        f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, x) - 1 AS k, x FROM (SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, x FROM kept ORDER BY h NULLS LAST, x LIMIT {CENTROIDS})
)"""
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, any_value(x) AS x, min(s).d AS distance, min(s).k AS k FROM (SELECT v.r, v.vec_id, v.x, {{'d': {dist}, 'k': c.k}} AS s FROM kept v, c{i} c) GROUP BY r, vec_id)")
        if i < ROUNDS:
            parts.append(f"m{i} AS (SELECT k, list(m ORDER BY d) AS x FROM (SELECT k, d, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (SELECT k, unnest(x) AS e, unnest(range(1, 65)) AS d FROM a{i}) GROUP BY k, d) GROUP BY k)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k)")
    n = ROUNDS
    return "WITH " + ", ".join(parts) + f"""
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{n} a JOIN c{n} c ON a.k = c.k
"""


ORACLE = _oracle()
