"""Files, manifests, volume builds, staged runs and pixel operators on small cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelspark.operators import quantify as Q
from voxelspark.operators import tiles, volume
from voxelspark.plans import stages
from voxelspark.sources import manifest, sinks


def sections(spark, numbers, thickness=None):
    rows = [(i, n, None if thickness is None else float(thickness[i])) for i, n in enumerate(numbers)]
    return spark.createDataFrame(rows, "section_index int, section_number int, thickness_um double")


def labels(spark, n, side=4, of=lambda k: k % 5):
    return spark.createDataFrame([(k, y, x, of(k)) for k in range(n) for y in range(side) for x in range(side)], "section_index int, y int, x int, label int")


def test_gaps_by_number(spark):
    with pytest.warns(UserWarning, match=r"2 planes .*\[2, 3\]"):
        v = volume.build_volume(sections(spark, [10, 11, 14, 15]), labels(spark, 4, of=lambda k: k + 1), size=(4, 4), section_mpp=8.0, thickness_um=4.0, interval=2)
    assert [tuple(r) for r in v.planes.orderBy("plane").select("z_um", "section_index").collect()] == [(0, 0), (8, 1), (16, -1), (24, -1), (32, 2), (40, 3)]
    assert {(r["z"], r["label"]) for r in v.voxels.select("z", "label").distinct().collect()} == {(0, 1), (1, 2), (4, 3), (5, 4)} and v.gaps == [2, 3]


def test_gaps_by_thickness(spark):
    with pytest.warns(UserWarning, match="1 planes"):
        v = volume.build_volume(sections(spark, [None] * 4, [8, 16, 8, 8]), labels(spark, 4), size=(4, 4), section_mpp=8.0, target_um=8.0)
    assert [r[0] for r in v.planes.orderBy("plane").select("section_index").collect()] == [0, 1, -1, 2, 3]


def test_build_refuses(spark):
    three = labels(spark, 3)
    with pytest.raises(KeyError, match=r"2 sections have no label map: \[3, 4\]"):
        volume.build_volume(sections(spark, [None] * 5), three, size=(4, 4), section_mpp=8.0)
    with pytest.raises(ValueError, match="rise"):
        volume.build_volume(sections(spark, [1, 1, 2]), three, size=(4, 4), section_mpp=8.0)
    with pytest.raises(ValueError, match="spacing"):
        volume.build_volume(sections(spark, [1, 2, 3], [8, 8, 4]), three, size=(4, 4), section_mpp=8.0, thickness_um=4.0, interval=2)
    with pytest.raises(ValueError, match="go together"):
        volume.build_volume(sections(spark, [1, 2, 3]), three, size=(4, 4), section_mpp=8.0, interval=2)
    with pytest.warns(UserWarning, match="no thickness"):
        assert volume.build_volume(sections(spark, [None] * 3), three, size=(4, 4), section_mpp=12.0).voxel_um == 12.0


def test_registered_coordinates_win(spark):
    placed = spark.createDataFrame([(0, 0.0), (1, 8.0)], "section_index int, z_um double")
    affine = spark.createDataFrame([(k, 1.0, 0.0, 0.0, 0.0, 1.0, 100.0) for k in (0, 1)], "section_index int, a00 double, a01 double, a02 double, a10 double, a11 double, a12 double")
    nuclei = spark.createDataFrame([(0, 64.0, 32.0, 5.0, 6.0), (1, 64.0, 32.0, None, None)], "section_index int, centroid_y double, centroid_x double, reg_y_um double, reg_x_um double")
    got = volume.place_nuclei(nuclei, placed, affine, level0_mpp=0.25, registration_mpp=8.0).orderBy("section_index").select("z_um", "y_um", "x_um").collect()
    assert [tuple(r) for r in got] == [(0.0, 5.0, 6.0), (8.0, 2.0, 101.0)]
    with pytest.raises(ValueError, match="transforms"):
        volume.place_nuclei(nuclei.drop("reg_y_um", "reg_x_um"), placed)
    m = volume.section_affines(affine, placed, mpp=8.0).orderBy("section_index").collect()[1]["matrix"]
    assert m == [[1, 0, 0, 8], [0, 8, 0, 0], [0, 0, 8, 800], [0, 0, 0, 1]]


def test_manifest_files(spark, tmp_path):
    path = str(tmp_path / "m")
    listed = spark.createDataFrame([(k, f"s{k}.tif", f"/d/s{k}.tif") for k in (5, 2, 9)], "section_index int, filename string, path string")
    manifest.write_manifest(listed, path, section_number=spark.createDataFrame([(2, 3), (5, 4), (9, 7)], "section_index int, section_number int"), thickness_um=spark.createDataFrame([(2, 4.0)], "section_index int, thickness_um double"))
    back = manifest.load_manifest(spark, path)
    assert [tuple(r)[:2] for r in back.orderBy("section_index").collect()] == [(0, "s2.tif"), (1, "s5.tif"), (2, "s9.tif")]
    assert [r[1] for r in manifest.section_numbers(back).orderBy("section_index").collect()] == [3, 4, 7]
    assert [r[1] for r in manifest.thickness(back).orderBy("section_index").collect()] == [4.0, None, None]
    assert manifest.middle_slide(back).collect()[0]["path"] == "/d/s5.tif"
    for bad in ("", "x", "2.5", "3"):
        with pytest.raises(Exception, match="section_number must"):
            manifest.section_numbers(spark.createDataFrame([(0, "3"), (1, bad)], "section_index int, section_number string")).collect()
    spark.createDataFrame([("a", " ")], "filename string, path string").write.option("header", True).csv(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="no path"):
        manifest.load_manifest(spark, str(tmp_path / "bad")).collect()
    with pytest.raises(KeyError):
        manifest.load_manifest(spark, str(tmp_path / "m")).drop("path").write.option("header", True).csv(str(tmp_path / "none")) or manifest.load_manifest(spark, str(tmp_path / "none"))


def test_source_level(spark):
    levels = spark.createDataFrame([(0, k, 0.5 * 2**k, "um") for k in range(4)] + [(1, 0, 1.0, " Microns "), (1, 1, 2.001, "um")], "section_index int, level int, mpp double, unit string")
    assert dict(map(tuple, manifest.source_level(levels, 2.0).collect())) == {0: 2, 1: 1}
    with pytest.raises(Exception, match="too coarse"):
        manifest.source_level(levels, 0.4).collect()
    with pytest.raises(Exception, match="micrometres"):
        manifest.source_level(levels.withColumn("unit", F.lit("mm")), 2.0).collect()


def test_sinks(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([(1, [1.0, 2.0]), (2, [])], "section_index int, sizes array<double>")
    sinks.write_csv(df, path)
    assert {r["sizes"] for r in spark.read.csv(path, header=True).collect()} == {"[1.0,2.0]", "[]"}
    table = str(tmp_path / "r")
    df.write.parquet(table)
    again = sinks.replace(spark.read.parquet(table).where("section_index = 1"), table)  # made from what it replaces
    assert again.count() == 1 == spark.read.parquet(table).count()
    part = str(tmp_path / "p")
    sinks.write_sections(df, part)
    sinks.write_sections(spark.createDataFrame([(2, [9.0])], df.schema), part)
    assert {r["section_index"]: r["sizes"] for r in spark.read.parquet(part).collect()} == {1: [1.0, 2.0], 2: [9.0]}
    assert sinks.sections_written(spark, part).count() == 2 and sinks.sections_written(spark, part + "x").count() == 0
    sinks.write_metadata(spark, str(tmp_path), seg_mpp=0.5, sampling_interval=2)
    assert sinks.read_metadata(spark, str(tmp_path)) == {"seg_mpp": 0.5, "sampling_interval": 2} and sinks.read_metadata(spark, path) == {}
    with pytest.raises(KeyError):
        sinks.write_metadata(spark, str(tmp_path), other=1)


def _segment(todo):
    grid = todo.select("section_index", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("x"))
    return grid.withColumn("label", F.when(F.col("x") < 4, 1).otherwise(2))


def _detect(todo):
    at = todo.select("section_index", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    return at.select("section_index", F.col("i").cast("double").alias("centroid_y"), (F.col("i") * 2).cast("double").alias("centroid_x"), (F.col("i") * 8.0).alias("reg_y_um"), (F.col("i") * 9.0).alias("reg_x_um"), F.lit(6.0).alias("feret_diameter_um"))


def test_staged_run(spark, tmp_path):
    folder, path = str(tmp_path / "run"), str(tmp_path / "manifest")
    manifest.write_manifest(spark.createDataFrame([(k, f"s{k}.tif", f"/d/s{k}.tif") for k in range(4)], "section_index int, filename string, path string"), path)
    stages.register_stage(spark, folder, path, seg_mpp=8.0, registration_mpp=8.0)
    assert stages.sections_stage(spark, folder, _segment, _detect, task=1, n_tasks=3) == 1
    with pytest.raises(ValueError, match=r"3 sections have no labels .*\[0, 2, 3\]"):
        stages.volume_stage(spark, folder, size=(8, 8))
    assert stages.sections_stage(spark, folder, _segment, _detect) == 3 and stages.sections_stage(spark, folder, _segment, _detect) == 0
    assert stages.sections_stage(spark, folder, _segment, _detect, task=0, n_tasks=1) == 0
    steps = stages.main(["--stage", "volume", "--output", folder, "--height", "8", "--width", "8"], spark)
    assert {s.status for s in steps} == {"ok"}, [(s.name, s.note) for s in steps if s.status != "ok"]
    assert spark.read.parquet(f"{folder}/volume/voxels").count() == 4 * 64 and spark.read.parquet(f"{folder}/quantification/volumes").count() == 4
    assert spark.read.csv(f"{folder}/quantification/csv/lesion_density", header=True).columns[-4:] == [f"composition_frac_{c}" for c in (1, 2, 3, 4)]
    with pytest.raises(FileExistsError):
        stages.volume_stage(spark, folder, size=(8, 8))
    with pytest.raises(FileExistsError):
        stages.run_pipeline(spark, folder, path, _segment, size=(8, 8))
    with pytest.raises(ValueError, match="go together"):
        stages.run_pipeline(spark, str(tmp_path / "new"), path, _segment, size=(8, 8), facts={"sampling_interval": 2})
    assert not sinks.exists(spark, str(tmp_path / "new"))


def _sparse(todo):
    """Nuclei in section 1 only."""
    return _detect(todo).where("section_index = 1")


def test_sections_where_nothing_is_found_are_finished(spark, tmp_path):
    folder, path = str(tmp_path / "run"), str(tmp_path / "manifest")
    with pytest.raises(FileNotFoundError, match="register"):
        stages.sections_stage(spark, folder, _segment, _sparse)
    with pytest.raises(FileNotFoundError, match="register"):
        stages.volume_stage(spark, folder, size=(8, 8))
    manifest.write_manifest(spark.createDataFrame([(k, f"s{k}.tif", f"/d/s{k}.tif") for k in range(3)], "section_index int, filename string, path string"), path)
    stages.register_stage(spark, folder, path, seg_mpp=8.0, registration_mpp=8.0, non_rigid=True)
    assert sinks.read_metadata(spark, folder)["non_rigid"] is True
    assert stages.sections_stage(spark, folder, _segment, _sparse) == 3 and stages.sections_stage(spark, folder, _segment, _sparse) == 0
    built = volume.build_from_run(spark, folder, size=(8, 8), target_um=8.0)
    assert built.nuclei.select("section_index").distinct().collect() == [(1,)] and built.voxels.count() == 3 * 64
    # nothing anywhere: an empty table with the columns that the model gave
    sinks.write_sections(_detect(spark.range(0).select(F.col("id").cast("int").alias("section_index"))), f"{folder}/none", sections=spark.range(3).select(F.col("id").cast("int").alias("section_index")))
    none = sinks.read_sections(spark, f"{folder}/none")
    assert none.count() == 0 and {"section_index", "feret_diameter_um"} <= set(none.columns)
    assert sinks.sections_written(spark, f"{folder}/none").count() == 3
    spark.range(1).write.parquet(f"{folder}/volume/voxels")
    with pytest.raises(FileExistsError):
        stages.register_stage(spark, folder, path)


def test_replacing_survives_a_stop(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    assert sinks.replace(spark.read.parquet(path).where("id > 0"), path).count() == 2 and not sinks.exists(spark, f"{path}.old")
    sinks._rename(spark, path, f"{path}.old")  # stopped between the two renames
    assert sinks.heal(spark, path) and spark.read.parquet(path).count() == 2 and not sinks.heal(spark, path)


def test_manifests_with_wrong_columns_are_refused(spark, tmp_path):
    listed = spark.createDataFrame([(k, f"s{k}.tif", f"/d/s{k}.tif") for k in range(3)], "section_index int, filename string, path string")
    table = lambda name, *values: spark.createDataFrame(list(enumerate(values)), f"section_index int, {name} int")
    with pytest.raises(ValueError, match="2 of 3 sections"):
        manifest.write_manifest(listed, str(tmp_path / "a"), section_number=table("section_number", 4, 5))
    with pytest.raises(ValueError, match="2 rows"):
        manifest.write_manifest(listed, str(tmp_path / "a"), thickness_um=spark.createDataFrame([(1, 4), (1, 5)], "section_index int, thickness_um int"))
    with pytest.raises(ValueError, match="1 of no section"):
        manifest.write_manifest(listed, str(tmp_path / "a"), thickness_um=table("thickness_um", 4, 4, 4, 4))
    assert not sinks.exists(spark, str(tmp_path / "a"))
    with pytest.raises(Exception, match="section_number"):
        manifest.write_manifest(listed, str(tmp_path / "b"), section_number=table("section_number", 1, 5, 3))
    with pytest.raises(ValueError, match="needs sections"):
        manifest.write_manifest(listed.limit(0), str(tmp_path / "c"))
    slides = spark.createDataFrame([("0001",), ("x/0002.png",), ("0009",), ("2",), ("s0001.png",), (None,)], "name string")
    assert sorted(tuple(r) for r in manifest.slides_by_section(slides, listed).collect()) == [(1, "0001"), (2, "x/0002.png")]


def test_counts_without_nuclei_are_refused(spark):
    one = spark.createDataFrame([(8.0,)], "feret_diameter_um double")
    assert Q.corrected_count(one, thickness_um=4.0, interval=2) == pytest.approx(8 / 12)
    for bad in (one.limit(0), one.withColumnRenamed("feret_diameter_um", "d")):
        with pytest.raises(ValueError):
            Q.corrected_count(bad)
    with pytest.raises(ValueError, match="at least 1"):
        Q.corrected_count(one, interval=0)


def test_command_line(monkeypatch):
    monkeypatch.setenv("VOXELSPARK_VOXEL_UM", "  ")
    assert stages.parser().parse_args([]).voxel_um is None
    monkeypatch.setenv("VOXELSPARK_VOXEL_UM", "10")
    assert stages.parser().parse_args([]).voxel_um == 10.0
    with pytest.raises(SystemExit):
        stages.main(["--stage", "register", "--output", "x"])


def test_valleys(spark):
    x = np.arange(256)
    hump, spike = 1000 * np.exp(-0.5 * ((x - 90) / 30) ** 2), 5000 * np.exp(-0.5 * ((x - 200) / 2) ** 2)
    flat = 1000 * np.exp(-0.5 * ((x - 90) / 1) ** 2)
    rows = [(k, int(b), int(n)) for k, h in enumerate((hump + spike, flat + spike, hump)) for b, n in enumerate(h)]
    got = {r[0]: r[1] for r in tiles.gray_valleys(spark.createDataFrame(rows, "section_index int, bin int, n long")).collect()}
    assert 0.6 < got[0] < 0.78 and got[1] is None and got[2] is None


def test_stains_and_overview(spark):
    df = spark.createDataFrame([(0, y, x, 200, 120, 160) if x < 20 else (0, y, x, 0, 0, 0) for y in range(40) for x in range(40)], "section_index int, y int, x int, r int, g int, b int")
    out = tiles.overview(df, mpp=8.0, height=40, width=40).toPandas()
    assert len(out) == 16 and out[out["x"] < 2]["tissue"].all() and not out[out["x"] > 1]["tissue"].any() and set(out[out["x"] > 1]["r"]) == {255}
    h, e, d = df.limit(1).select(*tiles.stains(F.col("r"), F.col("g"), F.col("b"))).first()
    od = [np.log(max(v / 255, 1e-6)) / np.log(1e-6) for v in (200, 120, 160)]
    assert np.allclose([h, e, d], np.maximum(np.linalg.solve(np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11], [0.27, 0.57, 0.78]]).T, od), 0))


def test_instance_shapes(spark):
    square = [(0, 1, y, x) for y in range(4) for x in range(6)]
    ell = [(0, 2, y, x) for y in range(10, 16) for x in range(6) if y < 12 or x < 2]
    got = {r["label"]: r for r in tiles.instance_shapes(spark.createDataFrame(square + ell, "section_index int, label int, y int, x int"), mpp=0.5).collect()}
    assert got[1]["solidity"] == 1 and abs(got[1]["feret_diameter_um"] - 0.5 * np.hypot(3, 6)) < 1e-9
    assert got[2]["solidity"] == 20 / 26  # of the pixels in its hull


def test_warped_points_and_scale(spark):
    pts = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "section_index int, centroid_y double, centroid_x double")
    got = tiles.warp_points(pts, lambda k, yx: yx * 10 + k).orderBy("section_index").collect()
    assert [tuple(r)[3:] for r in got] == [(10.0, 20.0), (31.0, 41.0)]
    called = tiles.warp_points(pts.limit(0), lambda k, yx: 1 / 0)
    assert called.count() == 0
    assert tiles.off_scale(tiles.matched_tile(0.5), 0.5) is None
    with pytest.warns(UserWarning, match="um per pixel"):
        assert abs(tiles.off_scale(1024, 0.5) - 1.142857) < 1e-5


def test_surface_metric_and_source(spark):
    vox = spark.createDataFrame([(z, y, x, 1) for z in range(3) for y in range(3) for x in range(5)], "z int, y int, x int, label int")
    from voxelspark.config import class_table
    from voxelspark.operators.components import connected_components

    parts = connected_components(vox)
    found = Q.lesions(parts, class_table(spark), voxel_um=8.0)
    nuc = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "instance_id long, z_um double, y_um double, x_um double")
    by_x = lambda v: v.select("id", (100 - F.col("x_um")).alias("m"))
    rows = Q.surface_decorrelation(parts, found, nuc, 1, voxel_um=8.0, metric=by_x, thresholds=(0.1, 0.2)).toPandas().sort_values("threshold")
    assert rows["metric_at_source"].iloc[0] == 104 and rows["decorrelation_um"].is_monotonic_increasing
    other = Q.surface_decorrelation(parts, found, nuc, 1, voxel_um=8.0, metric=by_x, thresholds=(0.1,), source_vertex=5).first()
    assert other["source_vertex_index"] == 5
    wide = Q.surface_summary(spark.createDataFrame(pd.DataFrame(rows)), (0.1, 0.2)).first()
    assert wide["change_10_um"] == rows["decorrelation_um"].iloc[0] and wide["change_20_um"] == rows["decorrelation_um"].iloc[1]
    with pytest.raises(ValueError):
        Q.surface_decorrelation(parts, found, nuc, 1, voxel_um=8.0, thresholds=(0.0,))
