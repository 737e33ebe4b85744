"""The registered queries: every operator over the fixtures drawn from the driver's tables. Their SQL is in `oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.config import class_table, tissue_classes
from voxelspark.functions.geometry import AXES, entropy, share
from voxelspark.operators import quantify as Q
from voxelspark.operators import spatial, tiles, volume
from voxelspark.operators.components import connected_components
from voxelspark.sources import fixtures as fx
from voxelspark.sources import manifest

Query = Callable[[SparkSession, str], DataFrame]
V, SHAPE, CLASSES = fx.VOXEL_UM, fx.GRID, sorted(tissue_classes())
LARGE_UM3 = 5e4
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _lesions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    parts = connected_components(fx.blocks(spark, sf))
    return parts, Q.lesions(parts, class_table(spark), voxel_um=V, size_threshold_um3=LARGE_UM3)


def _classed(spark: SparkSession, sf: str) -> DataFrame:
    return Q.nucleus_classes(fx.nuclei(spark, sf), fx.voxels(spark, sf), voxel_um=V, shape=SHAPE)


# Volumes and components


@query
def volumetrics_basic(spark, sf):
    return rounded(Q.volumetrics(fx.voxels(spark, sf), class_table(spark), voxel_um=V), 9)


@query
def volumetrics_full(spark, sf):
    cells = fx.voxels(spark, sf)
    out = Q.volumetrics(cells, class_table(spark), voxel_um=V, components=connected_components(cells))
    sizes = F.col("component_sizes_um3")
    return rounded(out.select("class_index", "class_name", "n_voxels", "volume_um3", "n_components", F.coalesce(F.array_max(sizes), F.lit(0.0)).alias("largest_um3"), F.coalesce(F.get(sizes, F.lit(0)), F.lit(0.0)).alias("first_um3")), 9)


@query
def connected_components_6(spark, sf):
    return connected_components(fx.voxels(spark, sf))


@query
def connected_components_18(spark, sf):
    return connected_components(fx.blocks(spark, sf), connectivity=2, side=16)


@query
def connected_components_26(spark, sf):
    return connected_components(fx.blocks(spark, sf), connectivity=3, side=16)


@query
def lesion_features_basic(spark, sf):
    return rounded(_lesions(spark, sf)[1].drop("axis_major_length_um", "axis_minor_length_um", "component"))


@query
def lesion_axes(spark, sf):
    return rounded(_lesions(spark, sf)[1].select("instance_id", "axis_major_length_um", "axis_minor_length_um"), 4)


@query
def lesion_euler(spark, sf):
    parts, found = _lesions(spark, sf)
    return found.select("instance_id", "component").join(Q.euler_number(parts, ["component"]), "component").drop("component")


@query
def lesion_surface(spark, sf):
    parts, found = _lesions(spark, sf)
    return rounded(found.select("instance_id", "component").join(Q.surface_area(parts, ["component"], voxel_um=V), "component").drop("component"), 4)


@query
def lesion_hull(spark, sf):
    parts, found = _lesions(spark, sf)
    return rounded(found.select("instance_id", "component").join(Q.hull_shapes(parts, voxel_um=V), "component").drop("component"), 4)


# Nuclei, densities, neighbourhoods


@query
def nucleus_class(spark, sf):
    return _classed(spark, sf).select("instance_id", "class_index")


@query
def nuclei_to_lesions(spark, sf):
    parts, found = _lesions(spark, sf)
    return Q.nuclei_to_lesions(fx.nuclei(spark, sf), parts, found, voxel_um=V, shape=SHAPE).select("instance_id", "lesion_id")


@query
def lesion_cell_density(spark, sf):
    parts, found = _lesions(spark, sf)
    own = Q.nuclei_to_lesions(fx.nuclei(spark, sf), parts, found, voxel_um=V, shape=SHAPE)
    out = Q.lesion_cell_density(found, own, thickness_um=4.0, interval=2)
    return rounded(out.select("instance_id", "n_nuclei", "n_nuclei_corrected", "density_cells_per_mm3", "density_corrected_cells_per_mm3"), 4)


@query
def lesion_composition(spark, sf):
    _, found = _lesions(spark, sf)
    centres = found.select(F.col("instance_id").alias("id"), *(F.col(f"centroid_{n}_um").alias(f"{n}_um") for n in AXES))
    return rounded(Q.local_composition(centres, fx.blocks(spark, sf), CLASSES, voxel_um=V, radius_um=40.0), 9)


@query
def stereological_count(spark, sf):
    return rounded(fx.nuclei(spark, sf).groupBy("section_index").agg(F.sum(Q.stereological(F.col("feret_diameter_um"), 4.0, 2)).alias("n_corrected"), F.count("*").alias("n_profiles")))


@query
def class_density(spark, sf):
    volumes = Q.volumetrics(fx.voxels(spark, sf), class_table(spark), voxel_um=V)
    return rounded(Q.class_density(volumes, _classed(spark, sf)), 4)


@query
def sphere_density(spark, sf):
    n = fx.nuclei(spark, sf)
    return rounded(Q.sphere_density(n.withColumnRenamed("instance_id", "id"), n, radius_um=32.0), 4)


@query
def local_composition(spark, sf):
    centres = fx.nuclei(spark, sf).select(F.col("instance_id").alias("id"), "z_um", "y_um", "x_um")
    return rounded(Q.local_composition(centres, fx.voxels(spark, sf), CLASSES, voxel_um=V, radius_um=24.0), 9)


@query
def point_pairs(spark, sf):
    p = fx.points(spark, sf)
    pairs = spatial.distance_join(p, p, 50.0).groupBy(F.col("p.label").alias("label"), F.col("q.label").alias("other"))
    return pairs.agg(F.count("*").alias("n_pairs"), F.round(F.sum("d2"), 3).alias("sum_d2"))


@query
def neighborhood_features(spark, sf):
    return rounded(Q.neighborhood_features(_classed(spark, sf), CLASSES, radii_um=(16, 32, 50)))


@query
def nn_distance(spark, sf):
    return rounded(Q.nearest_class_distances(_classed(spark, sf), CLASSES))


@query
def density_histogram(spark, sf):
    return Q.density_histogram(fx.nuclei(spark, sf), voxel_um=V, shape=SHAPE)


@query
def density_kde(spark, sf):
    out = Q.density_grid(fx.nuclei(spark, sf), voxel_um=V, shape=SHAPE, bandwidth_um=8.0)
    return out.select(*AXES, F.round(F.col("value") * 1e6, 4).alias("value"))


@query
def density_gradient(spark, sf):
    field = Q.density_grid(fx.nuclei(spark, sf), voxel_um=V, shape=SHAPE, bandwidth_um=8.0)
    out = spatial.gradient_magnitude(field, SHAPE, V)
    return out.groupBy("z").agg(F.round(F.sum("gradient") * 1e6, 3).alias("sum_gradient"), F.round(F.max("gradient") * 1e6, 3).alias("max_gradient"))


@query
def radial_profile(spark, sf):
    parts, found = _lesions(spark, sf)
    return rounded(Q.radial_profile(parts, found, fx.blocks(spark, sf), _classed(spark, sf), 1, CLASSES, voxel_um=V, shape=SHAPE, ring_width_um=10, max_radius_um=120, proximal_um=50, distal_um=80), 4)


@query
def surface_decorrelation(spark, sf):
    parts, found = _lesions(spark, sf)
    return rounded(Q.surface_decorrelation(parts, found, fx.nuclei(spark, sf), 1, voxel_um=V, metric_radius_um=60.0), 6)


# Report tables


@query
def profile_lesions(spark, sf):
    return Q.profile_lesions(_lesions(spark, sf)[1])


@query
def top10_lesions(spark, sf):
    return _lesions(spark, sf)[1].select("instance_id", "class_name", "volume_um3").orderBy(F.desc("volume_um3"), "instance_id").limit(10)


@query
def lesion_class_summary(spark, sf):
    return rounded(Q.lesion_summary(_lesions(spark, sf)[1]))


@query
def neighborhood_class_summary(spark, sf):
    own = _classed(spark, sf)
    return rounded(Q.neighborhood_summary(Q.neighborhood_features(own, CLASSES, radii_um=(16, 32)), own, 32))


# Sources and assembly


@query
def manifest_natural_order(spark, sf):
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 3 == 0, "section_").otherwise("Section_"), k.cast("string"), F.when(k % 7 == 0, ".txt").when(k % 2 == 0, ".SVS").otherwise(".tif"))
    files = fx.table(spark, sf, "supplier").select(F.concat(F.lit("/slides/"), name).alias("path"))
    return manifest.manifest_of(files).select("section_index", "filename")


@query
def manifest_thickness(spark, sf):
    q = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("int").alias("section_index"), F.when(F.col("s_suppkey") % 4 == 0, " ").otherwise((F.col("s_suppkey") % 5 + 1).cast("string")).alias("thickness_um"))
    return volume.section_z(manifest.thickness(q), thickness_col="thickness_um").join(manifest.thickness(q), "section_index")


@query
def section_number_check(spark, sf):
    n = fx.sections(spark, sf)
    broken = n.withColumn("section_number", F.when(F.col("section_index") == 5, 3).otherwise(F.col("section_number")))
    return volume.check_numbers(broken)


@query
def section_z(spark, sf):
    return volume.section_z(fx.sections(spark, sf), spacing_um=8.0)


@query
def plane_sources(spark, sf):
    return volume.plane_sources(volume.section_z(fx.sections(spark, sf), spacing_um=8.0), voxel_um=8.0)


@query
def plane_sources_12um(spark, sf):
    return volume.plane_sources(volume.section_z(fx.sections(spark, sf), thickness_col=None, default_um=8.0), voxel_um=12.0)


@query
def missing_sections(spark, sf):
    labels = fx.voxels(spark, sf).withColumnRenamed("z", "section_index").where(F.pmod("section_index", F.lit(3)) != 1)
    return volume.missing_sections(fx.sections(spark, sf), labels).select("section_index")


@query
def volume_build(spark, sf):
    labels = fx.voxels(spark, sf).withColumnRenamed("z", "section_index")
    built = volume.build_voxels(labels, plane_sources(spark, sf))
    return built.groupBy("z", "label").agg(F.count("*").alias("n"))


@query
def global_instance_ids(spark, sf):
    return volume.global_ids(fx.nuclei(spark, sf).withColumnRenamed("instance_id", "ordinal"), order_col="ordinal").select("ordinal", "section_index", "instance_id")


def _transforms(spark, sf):
    i = F.col("section_index")
    return fx.sections(spark, sf).select("section_index", (1 + i * 0.01).alias("a00"), (i * 0.02).alias("a01"), (i * 100.0).alias("a02"), (i * -0.02).alias("a10"), (1 - i * 0.01).alias("a11"), (i * 10.0).alias("a12"))


@query
def affine_centroids(spark, sf):
    found = fx.nuclei(spark, sf).select("instance_id", "section_index", F.col("y_um").alias("centroid_y"), F.col("x_um").alias("centroid_x"))
    return rounded(volume.affine_centroids(found, _transforms(spark, sf), level0_mpp=0.25, registration_mpp=8.0).select("instance_id", "y_um", "x_um"), 9)


@query
def nuclei_section_z(spark, sf):
    placed = volume.section_z(fx.sections(spark, sf), spacing_um=8.0)
    return volume.place_nuclei(fx.nuclei(spark, sf), placed).groupBy("section_index", "z_um").agg(F.count("*").alias("n"))


@query
def smooth_transforms(spark, sf):
    return rounded(volume.smooth_transforms(_transforms(spark, sf), sigma=1.0, columns=["a00", "a02"]))


@query
def resample_labels(spark, sf):
    labels = fx.voxels(spark, sf).withColumnRenamed("z", "section_index")
    return volume.resample_labels(labels, size=(40, 40), new_size=(25, 16))


# Tiles and pixels


def _sizes(spark, sf):
    return fx.sections(spark, sf).select("section_index", (F.col("section_number") * 300 + 100).cast("int").alias("height"), (F.col("section_number") * 200 + 64).cast("int").alias("width"))


@query
def tile_grid_core(spark, sf):
    return tiles.tile_grid(_sizes(spark, sf), tile=512, overlap=64)


@query
def tile_grid_overlap(spark, sf):
    return tiles.tile_grid(_sizes(spark, sf), tile=448, overlap=90, stride_is_tile=False)


@query
def core_window_dedup(spark, sf):
    seen = fx.nuclei(spark, sf).select("instance_id", F.col("y_um").alias("y"), F.col("x_um").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("row")).select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("col"))
    wide = seen.where((F.col("y") >= F.col("row") * 64 - 16) & (F.col("y") < F.col("row") * 64 + 80) & (F.col("x") >= F.col("col") * 64 - 16) & (F.col("x") < F.col("col") * 64 + 80))
    return tiles.owned(wide, tile=64).select("instance_id", "row", "col")


@query
def overlap_argmax(spark, sf):
    p = fx.table(spark, sf, "lineitem").select((F.col("l_linenumber") - 1).cast("int").alias("section_index"), (F.col("l_partkey") % 40).cast("int").alias("y"), (F.col("l_suppkey") % 40).cast("int").alias("x"), (F.col("l_orderkey") % 5).cast("int").alias("class_index"), F.col("l_quantity").cast("long").alias("prob"))
    return tiles.overlap_argmax(p, fx.voxels(spark, sf).where("label <> 0").withColumnRenamed("z", "section_index"))


@query
def block_mean(spark, sf):
    pixels = fx.voxels(spark, sf).select(F.col("z").alias("section_index"), "y", "x", (F.col("label") * 50).alias("value"))
    return tiles.block_mean(pixels, factor=6, height=40, width=40)


@query
def tissue_mask(spark, sf):
    at = fx.voxels(spark, sf)
    r, g, b = F.col("label") * 60 + F.col("y") % 16, F.col("label") * 55, F.col("label") * 62
    return at.select("z", "y", "x", tiles.background(r, g, b).alias("background"))


@query
def tissue_bbox(spark, sf):
    tissue = fx.voxels(spark, sf).where("label = 4 and y between 10 and 30 and x between 5 and 20").withColumnRenamed("z", "section_index")
    return tiles.tissue_bbox(tissue, height=40, width=40, min_sections=2)


@query
def affine_fit(spark, sf):
    u, v = F.col("y_um"), F.col("x_um")
    i = F.col("section_index")
    pairs = fx.nuclei(spark, sf).select("section_index", u.alias("u"), v.alias("v"), (u * (1 + i * 0.01) + v * 0.02 + i + F.col("feret_diameter_um")).alias("y"), (u * -0.02 + v * (1 - i * 0.01) - i).alias("x"))
    return rounded(tiles.affine_fit(pairs))


@query
def instance_features(spark, sf):
    return rounded(tiles.instance_features(fx.blocks(spark, sf).withColumnRenamed("z", "section_index"), mpp=0.5))


@query
def label_overlay(spark, sf):
    at = fx.voxels(spark, sf).select(F.col("z").alias("section_index"), "y", "x", "label", (F.col("x") * 5).alias("r"), (F.col("y") * 5).alias("g"), F.lit(200).alias("b"))
    colours = class_table(spark).select(F.col("class_index").alias("label"), (F.col("class_index") * 60).alias("cr"), (255 - F.col("class_index") * 60).alias("cg"), (F.col("class_index") * 30).alias("cb"))
    return tiles.overlay(at, colours)


@query
def pyramid_levels(spark, sf):
    found = manifest.levels(_sizes(spark, sf))
    return found.join(manifest.best_level(found, 11.0).withColumnRenamed("level", "best"), "section_index")


# Orchestration


@query
def task_sections(spark, sf):
    n = fx.nuclei(spark, sf).select(F.col("instance_id").cast("int").alias("section_index"))
    return manifest.task_sections(n, 1, 3)


@query
def resume_todo(spark, sf):
    k = F.col("o_orderkey")
    done = fx.table(spark, sf, "orders").select((k % 400).cast("int").alias("section_index"), F.when(F.col("o_orderstatus") == "F", "labels").otherwise("nuclei").alias("output"))
    sections = fx.table(spark, sf, "customer").select((F.col("c_custkey") % 500).cast("int").alias("section_index")).distinct()
    return manifest.resume_todo(sections, done, ["labels", "nuclei"])


@query
def cache_merge(spark, sf):
    p = fx.table(spark, sf, "part")
    k = F.col("p_partkey")
    old = p.where(k % 3 != 0).select(k.alias("section_index"), F.col("p_size").alias("size"), (k * 10).alias("mtime"), F.lit(8.0).alias("mpp"))
    new = p.where(k % 4 != 0).select(k.alias("section_index"), F.col("p_size").alias("size"), F.when(k % 5 == 0, k * 10 + 1).otherwise(k * 10).alias("mtime"), F.lit(8.0).alias("mpp"))
    return manifest.merge_cache(old, new)


@query
def class_entropy(spark, sf):
    n = fx.voxels(spark, sf).where("label <> 0").groupBy("z").agg(F.count("*").alias("t"), *(F.count_if(F.col("label") == c).alias(f"n{c}") for c in CLASSES))
    return n.select("z", F.round(entropy([share(F.col(f"n{c}"), F.col("t")) for c in CLASSES]), 9).alias("entropy"))
