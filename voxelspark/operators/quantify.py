"""Quantification of labelled volumes and nuclei: volumes, lesions, densities, neighbourhoods, profiles, report tables.

Volumes are sparse voxel tables (z, y, x, label; missing cells are space), nuclei have z_um, y_um, x_um and instance_id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.config import check_voxel
from voxelspark.functions.geometry import AXES, decode, eigenvalues, entropy, nearest_voxel, share, sphere, voxel_index
from voxelspark.operators import meshes
from voxelspark.operators.balls import ball_composition as local_composition
from voxelspark.operators.balls import ball_counts
from voxelspark.operators.cells import AREA_NAMES, area, area_of, euler, sums_of_cells
from voxelspark.operators.hulls import hull_shapes
from voxelspark.operators.ranks import at_ranks, percentiles
from voxelspark.operators.surfaces import place, shortest_ways, surface_edges
from voxelspark.operators.spatial import distance_transform, nearest_by_class, smooth_grid
from voxelspark.sources.checkpoints import stored

MM3 = 1e9


def _listed(sizes: DataFrame) -> DataFrame:
    """class_index, component_sizes_um3: the sizes of each class in order of seed, eight bytes each. Sorted by Spark, which spills, and put together as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = None, []

        def row() -> pa.RecordBatch:
            values = pa.concat_arrays(held)
            return pa.RecordBatch.from_arrays([pa.array([own], kind), pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)], names=["class_index", "component_sizes_um3"])

        for batch in batches:
            if not batch.num_rows:
                continue
            kind, keys = batch.column(0).type, batch.column(0).to_numpy()
            for k, first in enumerate(start := [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1)]):
                if held and keys[first] != own:
                    yield row()
                    held = []
                own = keys[first]
                held.append(batch.column(1).slice(first, (start[k + 1] if k + 1 < len(start) else len(keys)) - first))
        if held:
            yield row()

    ordered = sizes.repartition("class_index").sortWithinPartitions("class_index", "component").select("class_index", "size")
    return ordered.mapInArrow(run, f"class_index {sizes.schema['class_index'].dataType.simpleString()}, component_sizes_um3 array<double>")


def volumetrics(voxels: DataFrame, classes: DataFrame, *, voxel_um: float, components: DataFrame | None = None, lists: bool = True) -> DataFrame:
    """One row for each tissue class, with or without voxels; with components also the surface of the class, their number and sizes in order of seed.

    Without `lists` the largest size (null without any) is there in place of all, and no row grows with the components.
    """
    v3 = check_voxel(voxel_um) ** 3
    counts = voxels.groupBy(F.col("label").alias("class_index")).agg(F.count("*").alias("n"))
    out = classes.join(counts, "class_index", "left").withColumn("n_voxels", F.coalesce("n", F.lit(0))).drop("n")
    total = F.sum("n_voxels").over(Window.partitionBy())  # one row for each class
    out = out.select("class_index", "class_name", "n_voxels", (F.col("n_voxels") * v3).alias("volume_um3"), (F.col("n_voxels") * v3 / MM3).alias("volume_mm3"), share(F.col("n_voxels"), total, 0.0).alias("volume_fraction"))
    if components is None:
        return out
    sizes = components.groupBy(F.col("label").alias("class_index"), "component").agg((F.count("*") * v3).alias("size"))
    of = sizes.groupBy("class_index").agg(F.count("*").alias("n_components"), F.max("size").alias("largest_um3"))
    areas = surface_area(voxels.select(F.col("label").alias("class_index"), *AXES), ["class_index"], voxel_um=voxel_um)
    out = out.join(areas, "class_index", "left").na.fill({"surface_area_um2": 0.0})
    out = out.join(of, "class_index", "left").withColumn("n_components", F.coalesce("n_components", F.lit(0)))
    if not lists:
        return out
    return out.drop("largest_um3").join(_listed(sizes), "class_index", "left").withColumn("component_sizes_um3", F.coalesce("component_sizes_um3", F.array().cast("array<double>")))


def cell_masks(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, mask: the occupied corners of every 2 x 2 x 2 cell that touches a voxel of the group."""
    corners = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(c, AXES, strict=True)), F.lit(1 << i).alias("bit")) for i, c in enumerate(meshes.CORNERS)))
    spread = cells.select(*by, *AXES, F.explode(corners).alias("c")).select(*by, *((F.col(n) - F.col(f"c.{n}")).alias(n) for n in AXES), F.col("c.bit").alias("bit"))
    return spread.groupBy(*by, *AXES).agg(F.bit_or("bit").alias("mask"))


def surface_area(cells: DataFrame, by: list[str], *, voxel_um: float) -> DataFrame:
    """by, surface_area_um2: the area of the surface at the middle between voxels and their surroundings."""
    return area_of(sums_of_cells(cells, by, AREA_NAMES, area), by, voxel_um**2)


def euler_number(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, euler_number: vertices - edges + faces - cubes of the closed voxels."""
    return sums_of_cells(cells, by, ["euler_number"], euler)


def lesions(components: DataFrame, classes: DataFrame, *, voxel_um: float, min_volume_um3: float = 1e4, size_threshold_um3: float = 1e6) -> DataFrame:
    """One row for each component of at least min_volume_um3, numbered by class, then seed."""
    v = check_voxel(voxel_um)
    if min_volume_um3 < 0 or size_threshold_um3 < 0:
        raise ValueError("thresholds must not be negative")
    moments = [F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in (("z", "z"), ("y", "y"), ("x", "x"), ("z", "y"), ("z", "x"), ("y", "x"))]
    of = components.groupBy(F.col("label").alias("class_index"), "component").agg(F.count("*").alias("n"), *(F.avg(n).alias(f"m{n}") for n in AXES), *(F.min(n).alias(f"lo{n}") for n in AXES), *((F.max(n) + 1).alias(f"hi{n}") for n in AXES), *moments)
    kept = of.withColumn("volume_um3", F.col("n") * v**3).where(F.col("volume_um3") >= min_volume_um3).join(F.broadcast(classes), "class_index")
    # numbered over all classes: the order is kept by counting before each class, not by one sorted task
    per_class = Window.partitionBy("class_index").orderBy("component")
    sizes = kept.groupBy("class_index").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy().orderBy("class_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = kept.withColumn("r", F.row_number().over(per_class)).join(F.broadcast(sizes.select("class_index", "before")), "class_index")
    big, small = eigenvalues(*(F.col(f"c{a}") for a in ("zz", "yy", "xx", "zy", "zx", "yx")))
    seed = decode(F.col("component"))
    box = (F.col("hiz") - F.col("loz")) * (F.col("hiy") - F.col("loy")) * (F.col("hix") - F.col("lox"))
    return kept.select((F.col("before") + F.col("r")).cast("long").alias("instance_id"), "component", "class_index", "class_name", F.col("n").alias("n_voxels"), "volume_um3", (F.col("volume_um3") / MM3).alias("volume_mm3"), *((F.col(f"m{n}") * v).alias(f"centroid_{n}_um") for n in AXES), *((F.col(f"lo{n}") * v).alias(f"bbox_min_{n}_um") for n in AXES), *((F.col(f"hi{n}") * v).alias(f"bbox_max_{n}_um") for n in AXES), F.pow(F.col("volume_um3") * 6 / math.pi, F.lit(1 / 3)).alias("equivalent_diameter_um"), (F.col("n") / box).alias("extent"), (F.sqrt(F.greatest(20 * big, F.lit(0.0))) * v).alias("axis_major_length_um"), (F.sqrt(F.greatest(20 * small, F.lit(0.0))) * v).alias("axis_minor_length_um"), F.when(F.col("volume_um3") >= size_threshold_um3, "large").otherwise("small").alias("size_class"), *(s.alias(f"seed_{n}_voxel") for s, n in zip(seed, AXES, strict=True)))


def nucleus_voxels(nuclei: DataFrame, *, voxel_um: float, shape: tuple[int, int, int]) -> DataFrame:
    return nuclei.withColumns({n: voxel_index(F.col(f"{n}_um"), voxel_um, s) for n, s in zip(AXES, shape, strict=True)})


def nucleus_classes(nuclei: DataFrame, voxels: DataFrame, *, voxel_um: float, shape: tuple[int, int, int]) -> DataFrame:
    """nuclei with class_index, that of their voxel (0: space)."""
    at = nucleus_voxels(nuclei, voxel_um=voxel_um, shape=shape)
    return at.join(voxels.select(*AXES, F.col("label").alias("class_index")), list(AXES), "left").drop(*AXES).withColumn("class_index", F.coalesce("class_index", F.lit(0)))


def nuclei_to_lesions(nuclei: DataFrame, components: DataFrame, found: DataFrame, *, voxel_um: float, shape: tuple[int, int, int]) -> DataFrame:
    """nuclei with lesion_id (0: in none that was kept)."""
    at = nucleus_voxels(nuclei, voxel_um=voxel_um, shape=shape)
    ids = components.select(*AXES, "component").join(found.select("component", F.col("instance_id").alias("lesion_id")), "component").drop("component")
    return at.join(ids, list(AXES), "left").drop(*AXES).withColumn("lesion_id", F.coalesce("lesion_id", F.lit(0)))


def stereological(diameter: Column, thickness_um: float, interval: int = 1) -> Column:
    """Each nucleus counts for what of it a section of this thickness and interval misses or sees twice."""
    if interval < 1:
        raise ValueError("sampling_interval must be at least 1")
    return F.lit(float(thickness_um * interval)) / (F.lit(float(thickness_um)) + diameter)


def corrected_count(nuclei: DataFrame, *, thickness_um: float = 4.0, interval: int = 1) -> float:
    """The corrected number of nuclei; without any, or without their diameters, there is none to correct and this raises."""
    if "feret_diameter_um" not in nuclei.columns:
        raise ValueError(f"nuclei need a feret_diameter_um, not only {nuclei.columns}")
    n, total = nuclei.agg(F.count("feret_diameter_um"), F.sum(stereological(F.col("feret_diameter_um").cast("double"), thickness_um, interval))).first()
    if not n:
        raise ValueError("no nuclei to count")
    return float(total)


def lesion_cell_density(found: DataFrame, assigned: DataFrame, *, thickness_um: float, interval: int = 1, voxels: DataFrame | None = None, classes: list[int] | None = None, voxel_um: float | None = None, composition_um: float = 150.0) -> DataFrame:
    """found (lesions) with n_nuclei, the stereologically corrected number, and both per mm3. assigned: nuclei with lesion_id.

    With voxels, classes and their scale also composition_frac_{c}: the tissue within composition_um of the lesion's centroid.
    """
    of = assigned.where("lesion_id > 0").groupBy(F.col("lesion_id").alias("instance_id")).agg(F.count("*").alias("n_nuclei"), F.sum(stereological(F.col("feret_diameter_um"), thickness_um, interval)).alias("n_nuclei_corrected"))
    out = found.join(of, "instance_id", "left").na.fill({"n_nuclei": 0, "n_nuclei_corrected": 0.0})
    out = out.withColumns({"density_cells_per_mm3": F.col("n_nuclei") / F.col("volume_mm3"), "density_corrected_cells_per_mm3": F.col("n_nuclei_corrected") / F.col("volume_mm3")})
    if voxels is None:
        return out
    centres = found.select("instance_id", *(F.col(f"centroid_{n}_um").alias(f"{n}_um") for n in AXES))
    return out.join(local_composition(centres, voxels, classes, voxel_um=voxel_um, radius_um=composition_um, id_col="instance_id"), "instance_id")


def class_density(volumes: DataFrame, classed: DataFrame) -> DataFrame:
    """class_index, class_name, n_nuclei, class_volume_mm3, density_cells_per_mm3 (0 for an empty class)."""
    of = classed.groupBy("class_index").agg(F.count("*").alias("n_nuclei"))
    out = volumes.select("class_index", "class_name", F.col("volume_mm3").alias("class_volume_mm3")).join(of, "class_index", "left").na.fill({"n_nuclei": 0})
    return out.withColumn("density_cells_per_mm3", share(F.col("n_nuclei"), F.col("class_volume_mm3"), 0.0))


def _points(nuclei: DataFrame, *more: str) -> DataFrame:
    return nuclei.select(F.col("instance_id").alias("id"), *(F.col(f"{n}_um").alias(n) for n in AXES), *more)


def sphere_mm3(radius_um: float) -> float:
    return 4 / 3 * math.pi * (radius_um / 1000) ** 3


def sphere_density(centres: DataFrame, nuclei: DataFrame, *, radius_um: float, voxels: DataFrame | None = None, classes: list[int] | None = None, voxel_um: float | None = None) -> DataFrame:
    """id, n_nuclei, density_cells_per_mm3: all nuclei within the radius of each centre (id, z_um, y_um, x_um).

    With voxels, classes and their scale also sphere_volume_mm3 and composition_frac_{c}: the tissue in the same sphere.
    """
    p = centres.select("id", *(F.col(f"{n}_um").alias(n) for n in AXES))
    of = ball_counts(p, _points(nuclei, F.lit(0).alias("cls")), (radius_um,), []).select("id", F.col("counts")[0].alias("n_nuclei"))
    out = centres.select("id").join(of, "id", "left").na.fill({"n_nuclei": 0}).withColumn("density_cells_per_mm3", F.col("n_nuclei") / sphere_mm3(radius_um))
    if voxels is None:
        return out
    return out.withColumn("sphere_volume_mm3", F.lit(sphere_mm3(radius_um))).join(local_composition(centres, voxels, classes, voxel_um=voxel_um, radius_um=radius_um), "id")


def neighborhood_features(classed: DataFrame, classes: list[int], *, radii_um: tuple[float, ...] = (50, 100, 200)) -> DataFrame:
    """Per nucleus and radius: neighbours (itself not counted), density, shares by class (itself included), entropy.

    All radii are counted at once, by blocks (see `balls`).
    """
    q = stored(_points(classed, F.col("class_index").alias("cls")))
    counts = ball_counts(q, q, radii_um, classes)
    names = [f"{c}_{int(r)}" for r in radii_um for c in ("all", *(f"c{c}" for c in classes))]
    of = counts.select(F.col("id").alias("instance_id"), *(F.col("counts")[i].alias(n) for i, n in enumerate(names)))
    cols = []
    for r in radii_um:
        k = int(r)
        tissue = sum((F.col(f"c{c}_{k}") for c in classes), F.lit(0))
        shares = [share(F.col(f"c{c}_{k}"), tissue) for c in classes]
        cols += [(F.col(f"all_{k}") - 1).alias(f"n_neighbors_r{k}"), ((F.col(f"all_{k}") - 1) / sphere_mm3(r)).alias(f"density_cells_per_mm3_r{k}"), *(s.alias(f"composition_frac_{c}_r{k}") for s, c in zip(shares, classes, strict=True)), entropy(shares).alias(f"shannon_entropy_r{k}")]
    return of.select("instance_id", *cols)


def nearest_class_distances(classed: DataFrame, classes: list[int]) -> DataFrame:
    """instance_id, nn_dist_um_class_{c}: to the nearest other nucleus of each class, null if there is none."""
    pts = _points(classed, F.col("class_index").alias("label"))
    found = nearest_by_class(pts, classes)
    of = found.groupBy("id").agg(*(F.sqrt(F.min(F.when(F.col("cls") == c, F.col("d2")))).alias(f"nn_dist_um_class_{c}") for c in classes))
    return classed.select("instance_id").join(of.withColumnRenamed("id", "instance_id"), "instance_id", "left")


def density_histogram(nuclei: DataFrame, *, voxel_um: float, shape: tuple[int, int, int]) -> DataFrame:
    """z, y, x, n: nuclei in each voxel; those outside the grid are dropped, the far border belongs to the last voxel."""
    own = nuclei.select(*(F.col(f"{n}_um").alias(n) for n in AXES))
    inside = own.where(" and ".join(f"{n} between 0 and {s * voxel_um}" for n, s in zip(AXES, shape, strict=True)))
    return inside.groupBy(*(F.least(F.floor(F.col(n) / voxel_um), F.lit(s - 1)).cast("int").alias(n) for n, s in zip(AXES, shape, strict=True))).agg(F.count("*").alias("n"))


def density_grid(nuclei: DataFrame, *, voxel_um: float, shape: tuple[int, int, int], bandwidth_um: float = 50.0) -> DataFrame:
    """z, y, x, value: cells per cubic micrometre, smoothed; cells out of reach of any nucleus are left out (0)."""
    if not bandwidth_um > 0:
        raise ValueError("bandwidth_um must be positive")
    counts = density_histogram(nuclei, voxel_um=voxel_um, shape=shape)
    return smooth_grid(counts, shape, bandwidth_um / voxel_um, "n").withColumn("value", F.col("value") / voxel_um**3)


def radial_profile(components: DataFrame, found: DataFrame, voxels: DataFrame, classed: DataFrame, lesion_id: int, classes: list[int], *, voxel_um: float, shape: tuple[int, int, int], ring_width_um: float = 10.0, max_radius_um: float = 500.0, proximal_um: float = 50.0, distal_um: float = 200.0) -> DataFrame:
    """Shells around a lesion, (lo, hi] of exact distance, then the bands proximal and distal (shell_index -1) from their sums.

    n_voxels, n_nuclei, shares of tissue classes by nuclei (null without any), nuclei per mm3 (null for an empty shell).
    """
    one = found.where(F.col("instance_id") == lesion_id)
    row = one.first()
    if row is None:
        raise KeyError(f"no lesion {lesion_id}")
    spark = found.sparkSession
    n_shells = math.ceil(max_radius_um / ring_width_um - 1e-9)
    pad = math.ceil(max_radius_um / voxel_um)
    box = [(max(0, round(row[f"bbox_min_{n}_um"] / voxel_um) - pad), min(s, round(row[f"bbox_max_{n}_um"] / voxel_um) + pad)) for n, s in zip(AXES, shape, strict=True)]
    axis = [spark.range(lo, hi).select(F.col("id").cast("int").alias(n)) for n, (lo, hi) in zip(AXES, box, strict=True)]
    cells = axis[0].join(axis[1], F.lit(True)).join(axis[2], F.lit(True))  # the box around one lesion
    inside = components.join(one.select("component"), "component").select(*AXES)
    dist = distance_transform(cells, inside).where("d2 > 0")
    # squared distances are whole, so a distance on an edge falls into the shell that ends there
    ratio2 = F.col("d2") * (voxel_um / ring_width_um) ** 2
    shell = dist.withColumn("shell_index", (F.ceil(F.sqrt(ratio2) - 1e-9) - 1).cast("int")).where(F.col("shell_index") < n_shells)
    around = nucleus_voxels(classed, voxel_um=voxel_um, shape=shape).groupBy(*AXES).agg(F.count("*").alias("all"), *(F.count_if(F.col("class_index") == c).alias(f"n{c}") for c in classes))
    labelled = shell.join(around, list(AXES), "left")
    sums = labelled.groupBy("shell_index").agg(F.count("*").alias("n_voxels"), F.coalesce(F.sum("all"), F.lit(0)).alias("n_nuclei"), *(F.coalesce(F.sum(f"n{c}"), F.lit(0)).alias(f"n{c}") for c in classes))
    shells = spark.range(n_shells).select(F.col("id").cast("int").alias("shell_index")).join(sums, "shell_index", "left").na.fill(0)
    lo, hi = F.col("shell_index") * float(ring_width_um), (F.col("shell_index") + 1) * float(ring_width_um)
    shells = shells.select("shell_index", lo.alias("r_lo_um"), hi.alias("r_hi_um"), F.lit("shell").alias("band"), "n_voxels", "n_nuclei", *(f"n{c}" for c in classes))
    total = lambda where, name, a, b: shells.where(where).agg(F.lit(-1).alias("shell_index"), F.lit(float(a)).alias("r_lo_um"), F.lit(float(b)).alias("r_hi_um"), F.lit(name).alias("band"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_voxels", "n_nuclei", *(f"n{c}" for c in classes))))
    rows = shells.unionByName(total(F.col("r_hi_um") <= proximal_um, "proximal", 0, proximal_um)).unionByName(total(F.col("r_lo_um") >= distal_um, "distal", distal_um, max_radius_um))
    tissue = sum((F.col(f"n{c}") for c in classes), F.lit(0))
    return rows.select("shell_index", "r_lo_um", "r_hi_um", "band", "n_voxels", "n_nuclei", *(share(F.col(f"n{c}"), tissue).alias(f"composition_frac_{c}") for c in classes), share(F.col("n_nuclei"), F.col("n_voxels") * (voxel_um**3 / MM3)).alias("density_cells_per_mm3"))


def surface_decorrelation(components: DataFrame, found: DataFrame, nuclei: DataFrame, lesion_id: int, *, voxel_um: float, metric_radius_um: float = 100.0, thresholds: tuple[float, ...] = (0.25, 0.5, 1.0), metric: Callable[[DataFrame], DataFrame] | None = None, source_vertex: int | None = None, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """threshold, decorrelation_um, lesion_id, n_surface_vertices, source_vertex_index, metric_at_source.

    The shortest way over the surface from the source, by default the vertex with the highest value, to one whose value has
    changed by the threshold; null if none has. The value is the cell density within metric_radius_um, or what `metric` makes of
    the vertices (id, z_um, y_um, x_um): id, m. Vertices count in raster order. With the volume's `shape` the surface is open where the
    lesion touches the border. See `surfaces` for how ways are found.
    """
    if not thresholds or min(thresholds) <= 0:
        raise ValueError("thresholds must be positive")
    one = components.join(found.where(F.col("instance_id") == lesion_id).select("component"), "component").select(F.lit(1).alias("g"), *AXES)
    edges = stored(surface_edges(cell_masks(one, ["g"]).drop("g"), shape=shape))
    vertices = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    vertices = stored(vertices.select("id", *((v * voxel_um).alias(f"{n}_um") for n, v in zip(AXES, place(F.col("id")), strict=True))))
    valued = metric(vertices) if metric else sphere_density(vertices, nuclei, radius_um=metric_radius_um).select("id", F.col("density_cells_per_mm3").alias("m"))
    valued = stored(valued.select("id", F.col("m").cast("double").alias("m")))
    n, low, high, first = valued.agg(F.count("*"), F.min("m"), F.max("m"), F.max_by("id", F.struct("m", -F.col("id")))).first()
    source = first
    if source_vertex is not None:
        at = at_ranks(valued, [], "id", {"source": F.lit(source_vertex)}).first() if 0 <= source_vertex < n else None
        if at is None:
            raise ValueError(f"no vertex {source_vertex} among {n}")
        source = at["value"]
    if source is None:
        raise KeyError(f"lesion {lesion_id} has no surface")
    m0, index = valued.agg(F.max(F.when(F.col("id") == source, F.col("m"))), F.count_if(F.col("id") < source)).first()
    change = F.abs(F.col("m") - m0) / abs(m0) if m0 else (F.abs(F.col("m") - m0) / (high - low) if high > low else F.lit(1.0))
    ways = shortest_ways(edges, source).join(valued, F.col("v") == F.col("id")).select((F.col("d") * voxel_um).alias("d"), change.alias("change"))
    least = ways.agg(*(F.min(F.when(F.col("change") >= t, F.col("d"))).alias(f"t{i}") for i, t in enumerate(thresholds)))
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("decorrelation_um")) for i, t in enumerate(thresholds)))
    facts = {"lesion_id": lesion_id, "n_surface_vertices": n, "source_vertex_index": index}
    return least.select(F.explode(rows).alias("r")).select("r.*", *(F.lit(v).cast("long").alias(k) for k, v in facts.items()), F.lit(float(m0)).alias("metric_at_source"))


def profile_lesions(found: DataFrame, wanted: tuple[float, ...] = (50, 90, 99)) -> DataFrame:
    """percentile, instance_id: the lesions at these ranks of volume, each once.

    Ranks are closed in on by counts (see `ranks`); nothing is sorted.
    """
    n = found.count()
    # several percentiles at one rank count once, by the least of them
    ranks = {min(int(n * p / 100), n - 1): float(p) for p in reversed(wanted)} if n else {}
    if not ranks:
        return found.select(F.lit(0.0).alias("percentile"), "instance_id", "volume_um3").limit(0)
    at = at_ranks(found, [], "volume_um3", {str(p): F.lit(r) for r, p in ranks.items()})
    ties = at.select(F.col("value").alias("volume_um3"), F.col("name").alias("percentile"), (F.col("rank") - F.col("below")).alias("r"))
    # of lesions alike in volume the r-th by id
    rows = found.select("instance_id", "volume_um3").join(F.broadcast(ties), "volume_um3")
    picked = at_ranks(rows, ["percentile", "volume_um3", "r"], "instance_id", {"id": F.col("r")})
    return picked.select(F.col("percentile").cast("double").alias("percentile"), F.col("value").alias("instance_id"), "volume_um3")


def lesion_summary(found: DataFrame) -> DataFrame:
    """Per class: lesions, large ones, median, largest and total volume, and the median corrected density if there is one."""
    by = ["class_index", "class_name"]
    out = found.groupBy(*by).agg(F.count("*").alias("n_lesions"), F.count_if(F.col("size_class") == "large").alias("n_large"), F.max("volume_um3").alias("max_um3"), F.sum("volume_um3").alias("total_um3"))
    out = out.join(percentiles(found, by, "volume_um3", {"median_um3": 0.5}), by)
    columns = [*by, "n_lesions", "n_large", "median_um3", "max_um3", "total_um3"]
    if "density_corrected_cells_per_mm3" in found.columns:
        out = out.join(percentiles(found, by, "density_corrected_cells_per_mm3", {"median_density": 0.5}), by)
        columns.append("median_density")
    return out.select(*columns)


def surface_summary(profiles: DataFrame, thresholds: tuple[float, ...] = (0.25, 0.5, 1.0)) -> DataFrame:
    """One row for each lesion: its vertices, the value at the source and the way to each threshold (change_{percent}_um)."""
    return profiles.groupBy("lesion_id").agg(F.first("n_surface_vertices").alias("n_surface_vertices"), F.first("metric_at_source").alias("metric_at_source"), *(F.max(F.when(F.col("threshold") == t, F.col("decorrelation_um"))).alias(f"change_{t * 100:g}_um") for t in thresholds))


def neighborhood_summary(features: DataFrame, classed: DataFrame, radius: int) -> DataFrame:
    """Per class of the nucleus: median neighbours and mean entropy."""
    own = stored(features.select("instance_id", f"n_neighbors_r{radius}", f"shannon_entropy_r{radius}").join(classed.select("instance_id", "class_index"), "instance_id"))
    out = own.groupBy("class_index").agg(F.count("*").alias("n_nuclei"), F.avg(f"shannon_entropy_r{radius}").alias("mean_entropy"))
    return out.join(percentiles(own, ["class_index"], f"n_neighbors_r{radius}", {"median_neighbors": 0.5}), "class_index").select("class_index", "n_nuclei", "median_neighbors", "mean_entropy")
