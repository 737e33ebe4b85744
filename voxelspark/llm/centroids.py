"""Exact k-means on integer vectors; each vector finds its centroid in a vantage-point tree.

Every round builds the tree of the centroids anew (bounded: k centroids of d numbers) and broadcasts it. A node holds a vantage
point, itself a centroid, and for both of its children the least and the largest distance from there to the centroids below
them; a leaf holds up to `LEAF` centroids. A vector searches best-first: of the nodes that it has reached it takes the one with
the least lower bound, measures the exact integer distances there, and is done once no bound is within its best distance. The
pruning radius is inclusive, with room for rounding, so that a centroid as near as the best is still met; ties go to the smaller
number. All vectors of a batch take their steps together, as rows of one array.

Tasks sum their own vectors by cluster, so a round shuffles at most k rows of d sums for each task, and k * d sums reach the
driver. Sums are exact (decimals across tasks), and so are means: floor(sum / count).

Nulls: a vector that is null, of another dimension, or has a component that is null or not finite is not kept and gets no row. A
null id sorts after all others when centroids are started. Rows that repeat an id are vectors of their own; in the choice of
first centroids they are told apart by their components. Fewer vectors than k: as many centroids. An empty table gives none.
Other columns are not read. A component times `scale` must stay within 2^27, so that sums of squares fit a long, else the job
fails with that message. Jobs run when `cluster` is called, one for each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.shared import stored

LEAF = 2
_MOST = 1 << 27


def is_kept(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector has `dims` components (any number if None), none of them null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & (F.size(vector) == dims if dims is not None else F.lit(True)), F.lit(False))


def as_integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The int64 rows of an Arrow column of lists that all have `dims` numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


class VantageTree:
    """Nodes by number: vantage (index of a centroid, -1 in a leaf), children, their distance ranges, and the leaves' centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.vantage: list[int] = []
        self.inner: list[tuple[int, float, float]] = []  # child or -1, least and largest distance from the vantage point
        self.outer: list[tuple[int, float, float]] = []
        self.bucket: list[list[int]] = []
        self._build(list(range(len(centroids))))

    def _build(self, members: list[int]) -> int:
        node = len(self.vantage)
        leaf = len(members) <= LEAF
        self.vantage.append(-1 if leaf else members[0])
        self.inner.append((-1, 0.0, 0.0))
        self.outer.append((-1, 0.0, 0.0))
        self.bucket.append(members if leaf else [members[0]])
        if not leaf:
            rest = np.array(members[1:])
            away = np.sqrt(((self.centroids[rest] - self.centroids[members[0]]) ** 2).sum(1).astype(float))
            order = np.argsort(away, kind="stable")
            half = (len(rest) + 1) // 2
            for side, part in ((self.inner, order[:half]), (self.outer, order[half:])):
                if len(part):
                    side[node] = (self._build(rest[part].tolist()), float(away[part].min()), float(away[part].max()))
        return node

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, squared distance, distances measured) of every row."""
        n, nodes = len(vectors), len(self.vantage)
        best, square = np.full(n, len(self.centroids)), np.full(n, np.iinfo(np.int64).max)
        bounds = np.full((n, nodes), np.inf)  # of nodes that are reached and not yet opened
        bounds[:, 0] = 0.0
        alive, measured = np.arange(n), 0
        while len(alive):
            node = bounds[alive].argmin(1)
            bound = bounds[alive, node]
            # a centroid as near as the best must be met too; 1e-9 covers the rounding of roots
            go = bound * (1 - 1e-9) - 1e-6 <= np.sqrt(square[alive].astype(float))
            alive, node = alive[go & np.isfinite(bound)], node[go & np.isfinite(bound)]
            bounds[alive, node] = np.inf
            for k in np.unique(node).tolist():
                rows = alive[node == k]
                for c in self.bucket[k]:
                    apart = vectors[rows] - self.centroids[c]
                    d = np.einsum("ij,ij->i", apart, apart)
                    measured += len(rows)
                    better = (d < square[rows]) | ((d == square[rows]) & (c < best[rows]))
                    best[rows[better]], square[rows[better]] = c, d[better]
                if self.vantage[k] >= 0:
                    away = np.sqrt(d.astype(float))  # the bucket of an inner node is its vantage point alone
                    for child, low, high in (self.inner[k], self.outer[k]):
                        if child >= 0:
                            bounds[rows, child] = np.maximum(0.0, np.maximum(away - high, low - away))
        return best, square, measured


def _assigned(vectors: DataFrame, centroids: np.ndarray, dims: int, totals: bool) -> DataFrame:
    """cluster and distance of every row of (id, v); or, with `totals`, each task's counts and sums by cluster."""
    shared = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))
    k, rows_at_once = len(centroids), max(1, (1 << 20) // max(64, len(centroids)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                rows = matrix(batch.column(batch.num_columns - 1), dims)
                best, square, _ = shared.value.nearest(rows)
                yield batch, rows, best, square

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, best, square in found(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32()), pa.array(square, pa.int64())], names=["id", "cluster", "distance"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, done = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        partial = lambda: pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(count), pa.array(list(sums), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])
        for _, rows, best, _ in found(batches):
            order = np.argsort(best, kind="stable")
            kinds, first = np.unique(best[order], return_index=True)
            count += np.bincount(best, minlength=k)
            sums[kinds] += np.add.reduceat(rows[order], first, axis=0) if len(order) else 0
            done += len(rows)
            if done > 1 << 34:  # 2^34 components within 2^27 still fit
                yield partial()
                count, sums, done = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), 0
        if done:
            yield partial()

    if totals:
        return vectors.select("v").mapInArrow(add, "cluster int, n long, sums array<long>")
    return vectors.mapInArrow(assign, "id long, cluster int, distance long")


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every kept vector, after `rounds` rounds.

    The first centroids are the k kept vectors with the least sha256 of `<seed>:<id>`.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(is_kept(F.col("v"), dims))
    whole = kept.select("id", as_integers(F.col("v"), scale).alias("v"))
    fits = F.forall("v", lambda x: F.abs(x) <= _MOST)
    rows = stored(whole.select("id", F.when(fits, F.col("v")).otherwise(F.raise_error(F.lit("a component times the scale is beyond 2^27"))).alias("v")))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    if not first:
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").withColumnRenamed("id", id_col)
    centroids = np.array([r["v"] for r in first], np.int64)
    exact = F.col("x").cast("decimal(38,0)")
    for _ in range(rounds):
        sums = _assigned(rows, centroids, dims, True).where("n > 0").select("cluster", "n", F.posexplode("sums").alias("pos", "x"))
        # k * dims rows
        for r in sums.groupBy("cluster", "pos").agg(F.sum(exact).alias("total"), F.sum("n").alias("n")).collect():
            centroids[r["cluster"], r["pos"]] = int(r["total"]) // r["n"]
    final = stored(_assigned(rows, centroids, dims, False))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = {r[0]: r[1] for r in final.groupBy("cluster").agg(F.sum("distance")).collect()}  # k rows
    facts = [(c, inertia.get(c, 0), sum(inertia.values()), names[c]) for c in range(len(centroids))]
    out = final.join(F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster")
    return out.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
