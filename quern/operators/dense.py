"""A stored index of vectors: k-means cells as folders, and cosine search over the cells that can hold a query's best k.

Cells are those of unit vectors, so each has a centre and a radius as angles.  No vector of a cell is nearer to a query than the
query's angle to the centre less the radius.  The nearest cells are searched first; what the k-th best scores there
is a threshold, and only cells whose bound reaches it are read.  With ``probe`` only so many cells are read, whatever their bounds.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import vectors
from quern.operators.retrieval import best, one_by_one

#: Vectors that the cells are fitted on, those with the least hash of their id; cells at most.
FIT_ROWS, MOST_CELLS = 20_000, 4096
#: Cells of a query that are searched first, for its threshold.
FIRST = 2
#: Scores are to 6 digits, so bounds this much below a threshold may still tie with it.
ROOM = 2e-6
#: Cell of vectors that have no direction: empty, zero or not finite ones.
NOWHERE = -1


def _unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: x.cast("double") / norm)


def _angle(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))


class CellIndex:
    """The index under ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.cells = spark.read.parquet(f"{self.path}/cells")

    @classmethod
    def create(cls, rows: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> CellIndex:
        """Index ``rows`` (vec_id, embedding, ...), all columns, under a new ``path``.

        Cells are fitted on at most FIT_ROWS vectors, about as many cells as the root of the number of rows; every row is stored in its cell.  Null
        vectors are left out; those without a direction, or of another length than most, lie in a cell of their own that every exact search reads.
        """
        spark, path = rows.sparkSession, path.rstrip("/")
        emb = F.col("embedding")
        rows = rows.where("embedding IS NOT NULL")
        n, dim = rows.agg(F.count(F.lit(1)), F.mode(F.size(emb))).first()
        good = (F.size(emb) == F.lit(dim or 0)) & F.forall(emb, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(emb, lambda x: x != 0)
        good = F.coalesce(good, F.lit(False))
        placed = rows.where(good).withColumn("unit", _unit(emb)).withColumn("features", array_to_vector("unit"))
        sample = placed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("features")
        k = min(cells or max(2, round(n**0.5)), MOST_CELLS)
        if n and sample.take(1):
            model = KMeans(k=k, distanceMeasure="cosine", seed=seed, maxIter=10, featuresCol="features", predictionCol="cell").fit(sample)
            centres = spark.createDataFrame([(i, list(map(float, c))) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>").withColumn("centre", _unit(F.col("centre")))
            placed = model.transform(placed).drop("features", "unit")
        else:
            centres = spark.createDataFrame([], "cell int, centre array<double>")
            placed = placed.drop("features", "unit").withColumn("cell", F.lit(NOWHERE))
        everything = placed.unionByName(rows.where(~good).withColumn("cell", F.lit(NOWHERE)))
        everything.repartition("cell").write.partitionBy("cell").parquet(f"{path}/vectors")
        stored = spark.read.parquet(f"{path}/vectors") if n else everything
        radii = stored.join(F.broadcast(centres), "cell").groupBy("cell").agg(F.max(_angle(_unit(emb), F.col("centre"))).alias("radius"), F.count(F.lit(1)).alias("n"))
        centres.join(radii, "cell").coalesce(1).write.parquet(f"{path}/cells")
        return cls(spark, path)

    def search(self, queries: DataFrame, k: int, where: Column | str | None = None, probe: int | None = None) -> DataFrame:
        """(query_id, vec_id, score, rank): the k rows nearest to each of ``queries`` (query_id, q), a stated set, among those that ``where`` lets through.

        Exact, unless ``probe`` bounds the cells that are read.  Scores to 6 digits, ties by vec_id, as in ``retrieval.nearest``.  Queries are told to all tasks in blocks, with the cells that each
        is to meet as bits; no pair of a query and a cell is a row.
        """
        rows = self.spark.read.parquet(f"{self.path}/vectors")
        rows = rows if where is None else rows.where(where)
        cells = self.cells.orderBy("cell").toArrow()
        number = cells["cell"].to_numpy()
        dim = len(cells["centre"][0]) if len(number) else 0
        centres, radius = vectors.matrix(cells["centre"].combine_chunks(), dim), cells["radius"].to_numpy()
        asks = vectors.plain(F.col("q"), dim) & F.exists("q", lambda x: x != 0)
        placed = rows.where(F.col("cell") != NOWHERE)
        out = one_by_one(rows, queries.where(~F.coalesce(asks, F.lit(False))).select("query_id", "q"))
        if not probe:
            out += one_by_one(rows.where(F.col("cell") == NOWHERE), queries.where(asks).select("query_id", "q"))
        for told in vectors.blocks(queries.where(asks).select("query_id", "q")):
            q = vectors.matrix(told["q"].combine_chunks(), dim)
            first, bound = _reach(q, centres, radius, min(probe or FIRST, len(number)))
            met = vectors.near(placed, told, dim, k, _bits(first, number))
            if not probe and len(q):
                least = best(met, ["query_id"], k, F.desc("score"), F.col("vec_id")).where(F.col("rank") == k).select("query_id", "score").toArrow()
                at = pc.index_in(told["query_id"], value_set=least["query_id"].combine_chunks())
                least = pc.fill_null(least["score"].combine_chunks().take(at.combine_chunks()), -np.inf).to_numpy(zero_copy_only=False)
                met = vectors.near(placed, told, dim, k, _bits(bound >= least[:, None].astype(np.float32) - ROOM, number), least)
            out.append(met)
        return best(functools.reduce(DataFrame.unionByName, out), ["query_id"], k, F.desc("score"), F.col("vec_id"))


def _reach(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray]:
    """By query and cell: whether it is one of the ``nearest`` cells, and the most that a vector of the cell may score."""
    unit = q / np.sqrt((q * q).sum(axis=1))[:, None]
    first, bound = np.zeros((len(q), len(centres)), bool), np.zeros((len(q), len(centres)), np.float32)
    for at in range(0, len(q), 1024):
        angle = np.arccos(np.clip(unit[at : at + 1024] @ centres.T, -1, 1))
        by = np.argsort(angle, axis=1, kind="stable")[:, :nearest]
        np.put_along_axis(first[at : at + 1024], by, True, axis=1)
        bound[at : at + 1024] = np.cos(np.maximum(0, angle - radius))
    return first, bound


def _bits(chosen: np.ndarray, number: np.ndarray) -> np.ndarray:
    """``chosen`` columns as bits at their cells' numbers."""
    whole = np.zeros((len(chosen), int(number.max(initial=-1)) + 1), bool)
    whole[:, number] = chosen
    return np.packbits(whole, axis=1)


def hybrid(dense: DataFrame, sparse: DataFrame, store: DataFrame, k: int, k_rrf: int = 60) -> DataFrame:
    """(query_id, id, score, rank, dense_rank, sparse_rank, columns of ``store``) of two ranked lists (query_id, id, rank), fused by reciprocal ranks.

    A full outer join keeps hits of one list alone; what is known of a document comes from ``store`` (id, ...), so
    hits of the sparse list alone are whole rows too.  A query without sparse hits keeps its dense order.
    Hits that the store does not hold are dropped after the ranking, as nothing can be shown of them.
    """
    d, s = dense.select("query_id", "id", F.col("rank").alias("dense_rank")), sparse.select("query_id", "id", F.col("rank").alias("sparse_rank"))
    part = lambda r: F.coalesce(1 / (F.lit(k_rrf) + F.col(r)), F.lit(0.0))
    both = d.join(s, ["query_id", "id"], "full_outer").withColumn("score", F.round(part("dense_rank") + part("sparse_rank"), 9))
    return best(both, ["query_id"], k, F.desc("score"), F.col("id")).join(store, "id")
