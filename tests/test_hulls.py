"""Hulls against all planes through three points, on bodies that span several blocks and slabs."""

import time
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import hulls

STEPS = np.concatenate((np.eye(3, dtype=int), -np.eye(3, dtype=int)))


def half_spaces(points):
    """Every plane through three points with all others on one side."""
    p, out = np.unique(points, axis=0), set()
    for a, b, c in combinations(range(len(p)), 3):
        n = np.cross(p[b] - p[a], p[c] - p[a])
        if n.any():
            above = (p - p[a]) @ n
            for s in (1, -1):
                if (s * above <= 0).all():
                    m = np.append(s * n, s * (n @ p[a]))
                    out.add(tuple((m // np.gcd.reduce(m)).tolist()))
    return out


def span(points):
    return max(((p - q) ** 2).sum() for p in points for q in points) ** 0.5


def plain_shape(body):
    """(Feret diameter, solidity) with the hull image voxel by voxel."""
    body = np.unique(body, axis=0)
    sides = half_spaces(body)
    flat = np.linalg.matrix_rank(body - body[0]) < 3
    if flat:
        corners = np.unique((2 * body[:, None] + np.array(list(product((-1, 1), repeat=3)))).reshape(-1, 3), axis=0)
        return span(corners) / 2, None
    core = [p for p in body if any(np.dot(n[:3], p) == n[3] for n in sides)]
    middles = np.unique((2 * np.array(core)[:, None] + STEPS).reshape(-1, 3), axis=0)
    planes = np.array(sorted(half_spaces(middles)))
    lo, hi = body.min(0), body.max(0)
    cells = np.array(list(product(*(range(a, b + 1) for a, b in zip(lo, hi, strict=True)))))
    image = cells[(2 * cells @ planes[:, :3].T <= planes[:, 3]).all(1)]
    inside = set(map(tuple, image))
    rim = [2 * p + s for p in image for s in STEPS if tuple(p + s) not in inside]
    return span(rim) / 2, len(body) / len(image)


@pytest.mark.parametrize("seed", range(6))
def test_hull_is_exact(seed):
    r = np.random.default_rng(seed)
    for _ in range(20):
        pts = r.integers(-3, 4, (int(r.integers(4, 20)), 3))
        hull, plain = hulls.convex_hull(pts), half_spaces(pts)
        if hull is None:
            assert np.linalg.matrix_rank(pts - pts[0]) < 3
        else:
            assert {tuple(p) for p in hull.planes.tolist()} == plain
    cube = hulls.convex_hull(np.array(list(product((0, 3), (0, 5), (0, 7)))))
    assert cube.volume() == 105 and len(cube.corners) == 8 and len(cube.planes) == 6


def test_shapes_of_irregular_bodies(spark, monkeypatch):
    monkeypatch.setattr(hulls, "SLAB", 12)
    r = np.random.default_rng(9)
    bodies = {k: np.unique(r.integers(0, (9, 12, 8), (int(r.integers(6, 14)), 3)) + [10, 58, 0], axis=0) for k in range(12)}  # over blocks of 16 x 64
    bodies[20] = np.array([[3, 3, 3]])
    bodies[21] = np.array([[0, 0, i] for i in range(9)])
    bodies[22] = np.array([[i, i, j] for i in range(5) for j in range(4)])  # an oblique plane
    bodies[23] = np.array([[4, i, j] for i in range(40) for j in range(40) if (i - 20) ** 2 + (j - 20) ** 2 < 300])
    rows = [(k, *map(int, p)) for k, b in bodies.items() for p in b]
    got = {x["component"]: x for x in hulls.hull_shapes(spark.createDataFrame(rows, "component long, z int, y int, x int"), voxel_um=2.0).collect()}
    assert set(got) == set(bodies)
    for k, b in bodies.items():
        feret, solid = plain_shape(b) if k != 23 else (None, None)
        if feret is not None:
            assert got[k]["feret_diameter_max_um"] == pytest.approx(2 * feret), k
        if solid is not None:
            assert got[k]["solidity"] == pytest.approx(solid), k
    assert got[20]["solidity"] == got[21]["solidity"] == 1.0 and got[21]["feret_diameter_max_um"] == pytest.approx(2 * 83**0.5)
    assert 0.9 < got[23]["solidity"] <= 1.0 and 0.5 < got[22]["solidity"] < 1.0


def test_a_large_ball_takes_seconds(spark):
    """A million voxels: reduced to hulls block by block, no task holds them all."""
    n, size = 62, 125
    cell = spark.range(size**3, numPartitions=8).select(F.lit(1).cast("long").alias("component"), *((F.expr(f"id div {size ** k} % {size}") - n).cast("int").alias(a) for k, a in ((2, "z"), (1, "y"), (0, "x"))))
    ball = cell.where(F.col("z") ** 2 + F.col("y") ** 2 + F.col("x") ** 2 <= n * n)
    began = time.time()
    got = hulls.hull_shapes(ball, voxel_um=1.0).collect()
    assert len(got) == 1 and got[0]["solidity"] > 0.97 and 125.0 <= got[0]["feret_diameter_max_um"] < 126.5
    assert time.time() - began < 60


def test_no_bodies(spark):
    assert hulls.hull_shapes(spark.createDataFrame([], "component long, z int, y int, x int"), voxel_um=1.0).count() == 0
