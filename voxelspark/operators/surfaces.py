"""Shortest ways on the surface of a body, cube by cube.

The edges of the surface come from a join of cell masks with a table of each mask's edges, and stay dealt to cubes of `side` cells. A
cube finds the shortest ways inside itself, from what is known about its vertices so far; vertices on the faces of cubes carry the
distances across. A round works on the cubes that hold a vertex whose distance fell in the round before; so there are about as many rounds
as cubes on the longest way, each one stored, and no task holds more than a cube.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.geometry import AXES
from voxelspark.operators import meshes
from voxelspark.sources.checkpoints import drop_stored, stored

_CUBE = [f"c{n}" for n in AXES]
_SHIFT = 4  # half steps, so that no place is negative


def edge_table() -> list[tuple[int, int, int, int, int, int, int]]:
    """(mask, place of one end, place of the other) in half steps within the cell: sides of loops, and the fan from a loop's first point."""
    out = []
    for mask in range(1, 255):
        for loop in meshes.cell_loops(mask):
            p = [tuple(int(2 * v) for v in q) for q in loop]
            pairs = {tuple(sorted((p[i], p[(i + 1) % len(p)]))) for i in range(len(p))} | {tuple(sorted((p[0], p[i]))) for i in range(2, len(p) - 1)}
            out += [(mask, *a, *b) for a, b in sorted(pairs)]
    return out


def _code(prefix: str) -> Column:
    at = [2 * F.col(n).cast("long") + F.col(f"{prefix}{n}") + _SHIFT for n in AXES]
    return at[0] * (1 << 42) + at[1] * (1 << 21) + at[2]


def place(vertex: Column) -> list[Column]:
    """z, y, x of a vertex in voxels, from its code; codes are in raster order."""
    parts = [F.shiftright(vertex, 42), F.shiftright(vertex, 21).bitwiseAND((1 << 21) - 1), vertex.bitwiseAND((1 << 21) - 1)]
    return [(p - _SHIFT) / 2 for p in parts]


def surface_edges(masks: DataFrame, *, side: int = 32, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """cz, cy, cx (cube), a, b (vertex codes), w (length in voxels) of cells (z, y, x, mask).

    With `shape` only cells within the volume count: where a body touches the border, its surface is open there.
    """
    if shape is not None:
        masks = masks.where(" and ".join(f"{n} between 0 and {s - 2}" for n, s in zip(AXES, shape, strict=True)))
    table = masks.sparkSession.createDataFrame(edge_table(), ", ".join(["mask int", *(f"{e}{n} int" for e in "ab" for n in AXES)]))
    met = masks.join(F.broadcast(table), "mask")  # a fixed table
    square = sum(((F.col(f"a{n}") - F.col(f"b{n}")) * (F.col(f"a{n}") - F.col(f"b{n}")) for n in AXES), F.lit(0))
    return met.select(*(F.floor(F.col(n) / side).cast("int").alias(f"c{n}") for n in AXES), _code("a").alias("a"), _code("b").alias("b"), (F.sqrt(square.cast("double")) / 2).alias("w")).distinct()


def _inside(edges: pa.Table, known: pa.Table) -> pa.Table:
    """Vertices of a cube that get nearer by ways within it."""
    a, b, w = (edges.column(c).to_numpy() for c in ("a", "b", "w"))
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    near: list[list[tuple[int, float]]] = [[] for _ in names]
    for i, j, d in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), w.tolist(), strict=True):
        near[i].append((j, d))
        near[j].append((i, d))
    best = np.full(len(names), np.inf)
    at = np.searchsorted(names, known.column("v").to_numpy())
    best[at] = known.column("d").to_numpy()
    before, heap = best.copy(), [(float(best[k]), int(k)) for k in np.flatnonzero(np.isfinite(best))]
    heapq.heapify(heap)
    while heap:
        d, k = heapq.heappop(heap)
        if d > best[k]:
            continue
        for j, step in near[k]:
            if d + step < best[j]:
                best[j] = d + step
                heapq.heappush(heap, (d + step, j))
    fell = best < before
    return pa.table({"v": pa.array(names[fell]), "d": pa.array(best[fell])})


def shortest_ways(edges: DataFrame, source: int) -> DataFrame:
    """v, d: the length of the shortest way from the vertex `source` to every vertex that it reaches."""
    edges = stored(edges)
    of = stored(edges.select(*_CUBE, F.col("a").alias("v")).union(edges.select(*_CUBE, "b")).distinct())
    ways = stored(edges.sparkSession.createDataFrame([(source, 0.0, None)], "v long, d double, was double"))
    while True:
        cubes = ways.where("was is null or d < was").join(of, "v").select(*_CUBE).distinct()
        known = ways.select("v", "d").join(of, "v").join(cubes, _CUBE)
        found = edges.join(cubes, _CUBE).groupBy(*_CUBE).cogroup(known.groupBy(*_CUBE)).applyInArrow(_inside, "v long, d double")
        both = ways.select("v", "d", F.col("d").alias("was")).unionByName(found.withColumn("was", F.lit(None).cast("double")))
        before, ways = ways, stored(both.groupBy("v").agg(F.min("d").alias("d"), F.min("was").alias("was")))
        drop_stored(before)
        if not ways.where("was is null or d < was").limit(1).count():
            drop_stored(edges, of)
            return ways.select("v", "d")
