"""Analytic cases and the expectations of the assembly rules."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from voxelspark.config import class_table, tissue_classes
from voxelspark.operators import meshes, tiles, volume
from voxelspark.operators.cells import sums_of_cells
from voxelspark.operators import quantify as Q
from voxelspark.operators.components import CHUNK, connected_components
from voxelspark.operators.spatial import distance_join, distance_transform
from voxelspark.plans import extended
from voxelspark.sources import manifest
from voxelspark.streaming.incremental import ingest_sections


def cells(spark, points, label=1):
    return spark.createDataFrame([(int(z), int(y), int(x), label) for z, y, x in points], "z int, y int, x int, label int")


def cube(n, hollow=False):
    pts = [(z, y, x) for z in range(n) for y in range(n) for x in range(n)]
    return [p for p in pts if not hollow or any(v in (0, n - 1) for v in p)]


@pytest.mark.parametrize(("gap", "found"), [((0, 0, 1), (1, 1, 1)), ((0, 1, 1), (2, 1, 1)), ((1, 1, 1), (2, 2, 1)), ((0, 0, 2), (2, 2, 2))])
def test_connectivity(spark, gap, found):
    two = cells(spark, [(5, 5, 5), tuple(5 + g for g in gap)])
    assert tuple(connected_components(two, connectivity=k, side=6).select("component").distinct().count() for k in (1, 2, 3)) == found
    with pytest.raises(ValueError):
        connected_components(two, connectivity=4)


def test_components_cross_cubes_like_one(spark):
    rng = np.random.default_rng(3)
    pts = np.unique(rng.integers(0, 12, (500, 3)), axis=0)
    df = spark.createDataFrame(pd.DataFrame(pts, columns=list("zyx")).assign(label=1).astype("int32"))
    small, large = (connected_components(df, side=s).toPandas().sort_values(["z", "y", "x"])["component"].tolist() for s in (3, 64))
    assert small == large
    assert connected_components(df.limit(0)).count() == 0


@pytest.mark.parametrize(("points", "euler"), [(cube(2), 1), (cube(3, hollow=True), 2), ([(0, y, x) for y in range(3) for x in range(3) if (y, x) != (1, 1)], 0)])
def test_euler(spark, points, euler):
    assert Q.euler_number(cells(spark, points), ["label"]).first()["euler_number"] == euler


def test_sums_over_cells_meet_at_borders_of_blocks(spark):
    r = np.random.default_rng(11)
    pts = np.unique(np.column_stack((r.integers(61, 67, 900), r.integers(-3, 3, 900), r.integers(60, 66, 900))), axis=0)
    rows = spark.createDataFrame([(*map(int, p), k % 2) for k, p in enumerate(pts)], "z int, y int, x int, label int")
    masks = Q.cell_masks(rows, ["label"]).toPandas()
    for label in (0, 1):
        own = pts[label::2]
        parts = {tuple(2 * p + (i, j, k)) for p in own for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)}
        euler = sum(1 if sum(v % 2 for v in p) % 2 else -1 for p in parts)
        area = sum(meshes.cell_area(m) for m in masks[masks["label"] == label]["mask"])
        assert Q.euler_number(rows, ["label"]).where(f"label = {label}").first()["euler_number"] == euler
        assert Q.surface_area(rows, ["label"], voxel_um=1.0).where(f"label = {label}").first()["surface_area_um2"] == pytest.approx(area)


@pytest.mark.parametrize("f", [lambda c: Q.euler_number(c, ["label"]), lambda c: Q.surface_area(c, ["label"], voxel_um=1.0)])
def test_no_voxel_is_repeated_for_its_cells(spark, f):
    """A solid block of 30 x 30 x 30 voxels: what is shuffled are rows of voxels, not 8 or 27 parts of each."""
    block = spark.range(27000).selectExpr("cast(id div 900 as int) z", "cast(id div 30 % 30 as int) y", "cast(id % 30 as int) x", "1 label")
    plan = f(block)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "bit_or" in plan


def test_shapes_of_cubes_and_rods(spark):
    parts = connected_components(cells(spark, cube(4)))
    row = Q.lesions(parts, class_table(spark), voxel_um=2.0, min_volume_um3=0, size_threshold_um3=512).first()
    assert (row["volume_um3"], row["extent"], row["size_class"], row["seed_z_voxel"]) == (512.0, 1.0, "large", 0)
    hull = Q.hull_shapes(parts, voxel_um=1.0).first()
    assert hull["solidity"] == 1.0 and hull["feret_diameter_max_um"] == pytest.approx(math.sqrt(16 + 9 + 9))
    rod = connected_components(cells(spark, [(0, 0, x) for x in range(5)]))
    one = Q.lesions(rod, class_table(spark), voxel_um=1.0, min_volume_um3=0).first()
    assert one["axis_minor_length_um"] == pytest.approx(0, abs=1e-6) and one["axis_major_length_um"] == pytest.approx(math.sqrt(40))
    assert Q.hull_shapes(rod, voxel_um=1.0).first()["feret_diameter_max_um"] == pytest.approx(math.sqrt(27))
    with pytest.raises(ValueError):
        Q.lesions(rod, class_table(spark), voxel_um=1.0, min_volume_um3=-1)
    assert Q.lesions(rod.limit(0), class_table(spark), voxel_um=1.0).count() == 0


def test_concave_solidity_is_below_one(spark):
    bent = [p for p in cube(4) if p[1] < 2 or p[2] < 2]
    s = Q.hull_shapes(connected_components(cells(spark, bent)), voxel_um=1.0).first()["solidity"]
    assert 0.5 < s < 1


def test_single_voxel_surface():
    assert sum(meshes.cell_area(1 << i) for i in range(8)) == pytest.approx(math.sqrt(3))
    v, e = meshes.mesh(np.array([[0, 0, 0]]))
    assert (len(v), len(e)) == (6, 12)
    assert meshes.geodesic(v, e, 0).max() == pytest.approx(math.sqrt(2))


def test_volumetrics_and_density_of_halves(spark):
    half = [(z, y, x, 1 if x < 30 else 2) for z in range(4) for y in range(40) for x in range(20, 40)]
    vox = spark.createDataFrame(half, "z int, y int, x int, label int")
    nuc = spark.createDataFrame([(i, float(z * 8), float(y), float(x), 8.0) for i, (z, y, x) in enumerate((z, y, x) for z in range(4) for y in range(4, 320, 16) for x in range(4, 320, 16))], "instance_id long, z_um double, y_um double, x_um double, feret_diameter_um double")
    vol = Q.volumetrics(vox, class_table(spark), voxel_um=8.0, components=connected_components(vox))
    got = {r["class_name"]: r for r in vol.collect()}
    assert "space" not in got and got["Epithelium"]["volume_um3"] == got["Stroma"]["volume_um3"] == 819_200
    assert got["Epithelium"]["volume_fraction"] == 0.5 and got["rbc"]["n_components"] == 0 and got["rbc"]["component_sizes_um3"] == []
    classed = Q.nucleus_classes(nuc, vox, voxel_um=8.0, shape=(4, 40, 40))
    assert {r["class_index"]: r["count"] for r in classed.groupBy("class_index").count().collect()} == {0: 800, 1: 400, 2: 400}
    feats = Q.neighborhood_features(classed, [1, 2, 3, 4], radii_um=(20,)).toPandas()
    assert (feats["n_neighbors_r20"] > 0).all() and (feats["shannon_entropy_r20"] >= 0).all()
    shares = feats[[f"composition_frac_{c}_r20" for c in (1, 2, 3, 4)]].sum(axis=1, min_count=1).dropna()
    assert np.allclose(shares, 1)


@pytest.mark.parametrize("partitions", [1, 4])
def test_sizes_of_components_are_listed_or_summed(spark, partitions):
    """Lists are in order of seed; without them no row and no aggregate holds all sizes of a class."""
    rows = [(label, 100 * k - label, k * label % 7 + 1) for label in (1, 2, 4) for k in range(40)]
    parts = spark.createDataFrame(rows, "label int, component long, n int").repartition(partitions, "n").select("label", "component", F.explode(F.sequence(F.lit(1), "n")).alias("x"))
    vox = spark.createDataFrame([(0, 0, 0, 1)], "z int, y int, x int, label int")
    listed = {r["class_index"]: r["component_sizes_um3"] for r in Q.volumetrics(vox, class_table(spark), voxel_um=2.0, components=parts).collect()}
    assert listed == {c: [8.0 * n for label, _, n in sorted(rows) if label == c] for c in listed} and len(listed[2]) == 40 and listed[3] == []
    short = Q.volumetrics(vox, class_table(spark), voxel_um=2.0, components=parts, lists=False)
    assert {r["class_index"]: (r["n_components"], r["largest_um3"]) for r in short.collect()} == {c: (len(v), max(v, default=None)) for c, v in listed.items()}
    assert "collect_list(struct(component" not in short._jdf.queryExecution().toString()


def test_growing_volumetrics_lists_no_sizes(spark):
    plan = extended.growing_volumetrics(spark, SF)._jdf.queryExecution().toString()
    assert "component_sizes_um3" not in plan and "largest_um3" in plan


def test_cells_are_measured_by_so_many_voxels_at_once(spark):
    """24 solid blocks have 23,040 rows, which are few, but 1,428,480 voxels."""
    n = 16 * 60 * 62
    at = spark.range(24 * n).select((F.col("id") % n).alias("k"), F.floor(F.col("id") / n).alias("g")).select("g", (F.floor(F.col("k") / 3720) + 1).alias("z"), (F.floor(F.col("k") / 62) % 60 + 1).alias("y"), (F.col("k") % 62 + 1).alias("x"))
    at_once = lambda words, group, groups: [np.full(groups, np.bitwise_count(words[:, 0]).sum())]
    most = sums_of_cells(at, ["g"], ["n"], at_once).agg(F.max("n"), F.count("*")).first()
    assert n <= most[0] <= CHUNK and most[1] == 24


def test_distances(spark):
    p = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(20)], "id int, z double, y double, x double")
    assert distance_join(p, p, 2.0).count() == 20 + 2 * 19 + 2 * 18
    grid = cells(spark, cube(5)).drop("label")
    d = {(r["z"], r["y"], r["x"]): r["d2"] for r in distance_transform(grid, cells(spark, [(1, 2, 3), (4, 4, 0)]).drop("label")).collect()}
    assert all(v == min((z - 1) ** 2 + (y - 2) ** 2 + (x - 3) ** 2, (z - 4) ** 2 + (y - 4) ** 2 + x * x) for (z, y, x), v in d.items()) and len(d) == 125


def sections(spark, numbers):
    return spark.createDataFrame(list(enumerate(numbers)), "section_index int, section_number int")


def test_voxel_rules():
    assert volume.resolve_voxel(None, 4.0, 2) == (8.0, 8.0) and volume.resolve_voxel() == (12.0, None)
    for bad in ((None, 4.0, None), (None, None, 2), (None, 0.0, 2), (None, 4.0, 0), (None, 4.0, 1.5), (12.0, 4.0, 2)):
        with pytest.raises(ValueError):
            volume.resolve_voxel(*bad)


def test_planes_with_gaps(spark):
    placed = volume.section_z(sections(spark, [10, 11, 14, 15]), spacing_um=8.0)
    rows = volume.plane_sources(placed, voxel_um=8.0).orderBy("plane").collect()
    assert [r["section_index"] for r in rows] == [0, 1, -1, -1, 2, 3] and [r["z_um"] for r in rows] == [0, 8, 16, 24, 32, 40]
    thick = spark.createDataFrame(list(enumerate([8.0, 16.0, 8.0, 8.0])), "section_index int, t double")
    assert [r["section_index"] for r in volume.plane_sources(volume.section_z(thick, thickness_col="t"), voxel_um=8.0).orderBy("plane").collect()] == [0, 1, -1, 2, 3]


def test_missing_sections_are_named(spark):
    labels = spark.createDataFrame([(0, 0, 0, 1)], "section_index int, y int, x int, label int")
    with pytest.raises(KeyError, match=r"\[1, 2\]"):
        volume.require_sections(sections(spark, [1, 2, 3]), labels)
    with pytest.raises(NotImplementedError):
        volume.fill_missing("linear")
    with pytest.raises(ValueError):
        volume.fill_missing("magic")


def test_manifest_rules(spark):
    files = spark.createDataFrame([(f"/a/{n}",) for n in ("Section_10.svs", "section_9.svs", "Section_1.svs", "notes.txt")], "path string")
    assert [r["filename"] for r in manifest.manifest_of(files).orderBy("section_index").collect()] == ["Section_1.svs", "section_9.svs", "Section_10.svs"]
    bad = spark.createDataFrame([(0, "-1")], "section_index int, thickness_um string")
    with pytest.raises(Exception, match="must be positive"):
        manifest.thickness(bad).collect()
    n = spark.range(10).select(F.col("id").cast("int").alias("section_index"))
    assert sorted(r[0] for r in manifest.task_sections(n, 1, 3).collect()) == [1, 4, 7]
    with pytest.raises(ValueError):
        manifest.task_sections(n, 3, 3)
    with pytest.raises(KeyError):
        tissue_classes("nothing")


def test_tiles(spark):
    assert tiles.matched_tile(0.5) == 394 and tiles.canvas(1654, 8, 0.5) == 26464
    size = spark.createDataFrame([(0, 10, 10)], "section_index int, height int, width int")
    assert tiles.tile_grid(size, tile=4, overlap=2, stride_is_tile=False).count() == 25
    with pytest.raises(ValueError):
        tiles.tile_grid(size, tile=4, overlap=4)
    empty = spark.createDataFrame([], "section_index int, y int, x int")
    assert tuple(tiles.tissue_bbox(empty, height=30, width=40).first()) == (0, 0, 30, 40)


def test_stream_resumes(spark, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    for k in (0, 1):
        spark.createDataFrame([(k, 0, 0, 1), (k, 0, 1, 0), (k, 0, 0, 1)], "section_index int, y int, x int, label int").write.mode("append").parquet(source)
        ingest_sections(spark, source, target, check).awaitTermination(120)
    assert sorted((r["section_index"], r["label"]) for r in spark.read.parquet(target).collect()) == [(0, 1), (1, 1)]


def test_whole_run_records_steps(spark, tmp_path):
    from voxelspark.plans.run import run_quantification

    vox = spark.createDataFrame([(z, y, x, 1 if x < 4 else 2) for z in range(3) for y in range(6) for x in range(8)], "z int, y int, x int, label int")
    nuc = spark.createDataFrame([(i, float(i % 3 * 8), float(i * 7 % 48), float(i * 11 % 64), 6.0) for i in range(30)], "instance_id long, z_um double, y_um double, x_um double, feret_diameter_um double")
    steps = run_quantification(vox, nuc, str(tmp_path / "run"), voxel_um=8.0, shape=(3, 6, 8), radii_um=(16, 32))
    assert [s.status for s in steps] == ["ok"] * len(steps), [(s.name, s.note) for s in steps]
    assert "# Quantification report" in "\n".join(r[0] for r in spark.read.text(str(tmp_path / "run/report")).collect())
    without = run_quantification(vox, None, str(tmp_path / "bare"), voxel_um=8.0, shape=(3, 6, 8))
    assert {s.status for s in without} == {"ok", "skipped"}
