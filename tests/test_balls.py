"""Counts within balls against all pairs: dense blocks, many chunks, places on the boundary, empty inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import balls


def frame(spark, at, cls):
    return spark.createDataFrame([(i, *map(float, p), int(c)) for i, (p, c) in enumerate(zip(at, cls, strict=True))], "id long, z double, y double, x double, cls int")


def plain(p, q, cls, radii, classes):
    d2 = ((p[:, None] - q[None]) ** 2).sum(2)
    return [[int(((d2[i] <= r * r) & ((cls == c) | (c is None))).sum()) for r in radii for c in (None, *classes)] for i in range(len(p))]


@pytest.mark.parametrize(("chunk", "spread"), [(4096, 40), (16, 40), (16, 3)])
def test_counts(spark, monkeypatch, chunk, spread):
    monkeypatch.setattr(balls, "CHUNK", chunk)
    r = np.random.default_rng(chunk + spread)
    q = np.concatenate((r.integers(0, spread, (300, 3)), r.normal(spread / 2, 1, (120, 3)), np.full((40, 3), 2.5)))
    p = np.concatenate((q[::7], [[500.0, 0, 0], [-9, -9, -9]]))
    cls = r.integers(0, 3, len(q))
    got = {x["id"]: list(x["counts"]) for x in balls.ball_counts(frame(spark, p, np.zeros(len(p))), frame(spark, q, cls), (1.0, 5.0, 9.0), [0, 2]).collect()}
    expected = plain(p, q, cls, (1.0, 5.0, 9.0), [0, 2])
    assert [got[i] for i in range(len(p))] == expected


def test_only_the_rim_meets_points():
    """The denser the points, the smaller the share of them that probes are compared with; the rest is counted by sub-blocks."""
    r = np.random.default_rng(3)

    class Seen(np.ndarray):
        def __getitem__(self, k):
            out = np.asarray(self)[k]
            compared.append(len(out))
            return out

    shares = []
    for n in (20_000, 320_000):
        compared = []
        points = balls.Parts(r.uniform(0, 100, (n, 3)), np.ones((n, 1), np.int64))
        probes = balls.Parts(r.uniform(49, 51, (40, 3)), np.ones((40, 1), np.int64))
        at, points.at = points.at, points.at.view(Seen)
        got = balls.count_within(probes, points, (40.0,))
        assert got[:, 0, 0].tolist() == [int((((at - c) ** 2).sum(1) <= 1600).sum()) for c in probes.at]
        shares.append(max(compared) / n)
    assert shares[1] < 0.5 * shares[0], shares


def test_composition(spark):
    r = np.random.default_rng(4)
    cells = {tuple(c): int(r.integers(0, 4)) for c in r.integers(0, (9, 20, 200), (6000, 3))}
    voxels = spark.createDataFrame([(*map(int, c), k) for c, k in cells.items()], "z int, y int, x int, label int")
    at = r.uniform(0, 1600, (12, 3)) / (20, 10, 1)
    centres = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(at)], "id long, z_um double, y_um double, x_um double")
    got = {x["id"]: x for x in balls.ball_composition(centres, voxels, [1, 2], voxel_um=8.0, radius_um=60.0).collect()}
    for i, c in enumerate(at):
        near = [k for v, k in cells.items() if sum((a - b) ** 2 for a, b in zip(v, np.rint(c / 8), strict=True)) <= 7.5**2]
        n = sum(k in (1, 2) for k in near)
        for k in (1, 2):
            assert got[i][f"composition_frac_{k}"] == pytest.approx(near.count(k) / n if n else 0.0)


def test_empty(spark):
    none = frame(spark, np.zeros((0, 3)), [])
    one = frame(spark, np.zeros((1, 3)), [1])
    assert balls.ball_counts(one, none, (2.0,), [1]).first()["counts"] == [0, 0]
    assert balls.ball_counts(none, one, (2.0,), [1]).count() == 0
    assert balls.ball_counts(one, one.withColumn("cls", F.lit(None).cast("int")), (2.0,), [1]).first()["counts"] == [1, 0]
