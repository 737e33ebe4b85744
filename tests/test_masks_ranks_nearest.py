"""Openings by bitmaps, exact percentiles by refinement, nearest points of each class, against plain versions."""

import numpy as np
import pytest

from voxelspark.operators import morphology, ranks, spatial, tiles


def shifted(mask, n, every):
    """Erosion (every) or dilation by a diamond of n steps; what is outside is empty."""
    pad = np.pad(mask, n)
    h, w = mask.shape
    parts = [pad[n + a : n + a + h, n + b : n + b + w] for a in range(-n, n + 1) for b in range(-n, n + 1) if abs(a) + abs(b) <= n]
    return np.all(parts, 0) if every else np.any(parts, 0)


def rows_of(spark, masks):
    return spark.createDataFrame([(s, int(y), int(x)) for s, m in enumerate(masks) for y, x in np.argwhere(m)], "section_index int, y int, x int")


@pytest.mark.parametrize("n", [1, 2, 3])
def test_opening(spark, n):
    r = np.random.default_rng(n)
    masks = [r.random((30, 200)) < 0.93, shifted(r.random((20, 140)) < 0.02, n, False)]
    got = {tuple(x) for x in morphology.opening(rows_of(spark, masks), n).collect()}
    assert got == {(s, int(y), int(x)) for s, m in enumerate(masks) for y, x in np.argwhere(shifted(shifted(m, n, True), n, False))} and got


def rectangles(*boxes):
    m = np.zeros((100, 100), bool)
    for y0, y1, x0, x1 in boxes:
        m[y0:y1, x0:x1] = True
    return m


def test_tissue_boxes_without_specks(spark):
    speck = (2, 5, 2, 4)  # in two sections, but opened away
    box = lambda *masks: tuple(tiles.tissue_bbox(rows_of(spark, masks), height=100, width=100, open_steps=2).first())
    assert box(rectangles((20, 40, 30, 50), speck), rectangles((20, 40, 30, 50), speck)) == (16, 26, 44, 54)
    assert box(rectangles((20, 40, 30, 50)), rectangles((20, 40, 30, 50), (70, 90, 70, 90))) == (16, 26, 44, 54)
    assert box(rectangles(speck), rectangles(speck)) == (0, 0, 100, 100)
    assert box(rectangles((10, 30, 10, 30)), rectangles((10, 30, 10, 30), (60, 80, 60, 80)), rectangles((60, 80, 60, 80))) == (6, 6, 84, 84)


def test_percentiles(spark):
    r = np.random.default_rng(7)
    groups = {1: r.lognormal(3, 4, 500), 2: np.full(300, 2.5), 3: np.concatenate((r.normal(size=200), [1e300, -1e300, 0, 0, 0])), 4: np.array([5.0]), 5: 1e15 + np.arange(50) / 8}
    rows = [(g, float(v)) for g, own in groups.items() for v in own] + [(1, None), (3, float("nan")), (6, None)]
    got = {x["g"]: x for x in ranks.percentiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", {"a": 0.0, "b": 0.37, "m": 0.5, "z": 1.0}).collect()}
    for g, own in groups.items():
        assert [got[g][c] for c in "abmz"] == pytest.approx(np.percentile(own, [0, 37, 50, 100]).tolist()), g
    assert got[6]["m"] is None and len(got) == 6


def test_values_at_ranks_count_what_is_below(spark):
    rows = spark.createDataFrame([(v,) for v in (3.0, 1.0, 2.0, 2.0, 2.0, 9.0)], "v double")
    from pyspark.sql import functions as F

    got = {x["name"]: (x["value"], x["below"]) for x in ranks.at_ranks(rows, [], "v", {"x": F.lit(3), "y": F.lit(0), "z": F.col("n") - 1, "none": F.col("n")}).collect()}
    assert got == {"x": (2.0, 1), "y": (1.0, 0), "z": (9.0, 5)}


@pytest.mark.parametrize("cell", [256, 4])
def test_nearest(spark, monkeypatch, cell):
    monkeypatch.setattr(spatial, "_CELL", cell)
    monkeypatch.setattr(spatial, "_CHUNK", 16)
    r = np.random.default_rng(11)
    at = np.concatenate((r.normal(size=(150, 3)) * 20, r.normal(size=(60, 3)) + 300, np.full((50, 3), 7.0), [[1e5, -1e5, 3.0], [40.0, 40.0, 40.0]]))
    cls = np.concatenate((r.integers(1, 3, 260), [3, 4]))  # one nucleus far away in class 3, one alone in class 4
    rows = [(i, *map(float, p), int(c)) for i, (p, c) in enumerate(zip(at, cls, strict=True))]
    got = {(x["id"], x["cls"]): x["d2"] for x in spatial.nearest_by_class(spark.createDataFrame(rows, "id long, z double, y double, x double, label int"), [1, 2, 3, 4, 5]).collect()}
    d2 = ((at[:, None] - at) ** 2).sum(2)
    np.fill_diagonal(d2, np.inf)
    expected = {(i, c): float(d2[i][cls == c].min()) for i in range(len(at)) for c in (1, 2, 3, 4) if np.isfinite(d2[i][cls == c]).any()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(v) for k, v in expected.items())
    assert (260, 3) not in got and (261, 4) not in got
    empty = spark.createDataFrame([], "id long, z double, y double, x double, label int")
    assert spatial.nearest_by_class(empty, [1]).count() == 0
