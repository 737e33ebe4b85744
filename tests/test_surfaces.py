"""Shortest ways over surfaces, cube by cube, against one mesh and one search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import meshes, surfaces
from voxelspark.operators.quantify import cell_masks


def edges_of(spark, points, **options):
    cells = spark.createDataFrame([(*map(int, p), 1) for p in points], "z int, y int, x int, g int")
    return surfaces.surface_edges(cell_masks(cells, ["g"]).drop("g"), **options)


def code(v):
    z, y, x = (int(2 * c) + 4 for c in v)
    return z << 42 | y << 21 | x


@pytest.mark.parametrize("side", [2, 64])
def test_ways_are_those_of_one_search(spark, side):
    r = np.random.default_rng(3)
    points = np.unique(np.cumsum(r.integers(-1, 2, (60, 3)), axis=0) + 20, axis=0)  # a crooked body with ambiguous cells
    v, e = meshes.mesh(points)
    source = len(v) // 3
    got = {x["v"]: x["d"] for x in surfaces.shortest_ways(edges_of(spark, points, side=side), code(v[source])).collect()}
    expected = {code(p): d for p, d in zip(v, meshes.geodesic(v, e, source), strict=True) if np.isfinite(d)}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)


def test_places_and_open_borders(spark):
    points = [(z, y, x) for z in range(3) for y in range(3) for x in range(4)]
    closed, opened = edges_of(spark, points), edges_of(spark, points, shape=(5, 5, 5))
    v, e = meshes.mesh(np.array(points))
    assert closed.select("a", "b").distinct().count() == len(e)
    at = closed.select(F.col("a").alias("v")).union(closed.select("b")).distinct().select(*surfaces.place(F.col("v"))).collect()
    assert sorted(tuple(x) for x in at) == sorted(map(tuple, v.tolist()))
    # where the body meets the border of the volume nothing closes it
    low = opened.select(F.col("a").alias("v")).union(opened.select("b")).distinct().select(*surfaces.place(F.col("v"))).collect()
    assert low and min(min(x) for x in low) == 0.0 and {tuple(x) for x in low} < {tuple(x) for x in at}
