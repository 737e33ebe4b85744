"""Assembly of sections: z placement, planes with gaps, resampling, transforms, global ids."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelspark.config import VOLUME_VOXEL_UM
from voxelspark.operators.spatial import gaussian_weights
from voxelspark.sources import label_png, manifest, sinks


def _all():
    """Over small tables only: one row for each section."""
    return Window.partitionBy()


def resolve_voxel(target_um: float | None = None, thickness_um: float | None = None, interval: int | None = None) -> tuple[float, float | None]:
    """(voxel_um, section spacing): spacing = thickness * interval is the voxel; without both, the target or 12 and no spacing."""
    if thickness_um is None and interval is None:
        return float(VOLUME_VOXEL_UM if target_um is None else target_um), None
    if thickness_um is None or interval is None:
        raise ValueError("section_thickness_um and sampling_interval go together")
    if thickness_um <= 0 or interval != int(interval) or interval < 1:
        raise ValueError("section_thickness_um must be positive and sampling_interval a whole number from 1")
    spacing = float(thickness_um) * int(interval)
    if target_um is not None and abs(target_um - spacing) > 1e-9:
        raise ValueError(f"voxel_um {target_um} is not the section spacing {spacing}")
    return spacing, spacing


def section_z(sections: DataFrame, *, spacing_um: float | None = None, thickness_col: str | None = None, default_um: float = VOLUME_VOXEL_UM) -> DataFrame:
    """section_index, z_um: by section number times spacing from the first, or the thicknesses of the sections before."""
    order = _all().orderBy("section_index")  # one row for each section
    if spacing_um is not None:
        z = (F.col("section_number") - F.first("section_number").over(order)) * float(spacing_um)
    else:
        t = F.coalesce(F.col(thickness_col), F.lit(float(default_um))) if thickness_col else F.lit(float(default_um))
        z = F.coalesce(F.sum(t).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return sections.select("section_index", z.cast("double").alias("z_um"))


def check_numbers(sections: DataFrame) -> DataFrame:
    """The sections whose number does not follow the one before; empty if numbers rise strictly."""
    was = F.lag("section_number").over(_all().orderBy("section_index"))
    return sections.withColumn("previous", was).where(F.col("previous") >= F.col("section_number"))


def plane_sources(placed: DataFrame, *, voxel_um: float) -> DataFrame:
    """plane, z_um, section_index: the nearest section of each plane (the first of equals), -1 if it is over half a pitch away.

    The pitch is the voxel or the least step between sections, whichever is larger. Planes and sections are small tables.
    """
    facts = placed.withColumn("step", F.col("z_um") - F.lag("z_um").over(_all().orderBy("section_index"))).agg(F.max("z_um").alias("last"), F.greatest(F.lit(float(voxel_um)), F.coalesce(F.min("step"), F.lit(0.0))).alias("pitch"))
    planes = facts.select("pitch", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / voxel_um + 1e-6).cast("int"))).alias("plane"))
    both = planes.join(F.broadcast(placed), F.lit(True)).withColumn("dz", F.abs(F.col("plane") * voxel_um - F.col("z_um")))
    best = both.groupBy("plane", "pitch").agg(F.min(F.struct("dz", "section_index")).alias("b"))
    return best.select("plane", (F.col("plane") * float(voxel_um)).alias("z_um"), F.when(F.col("b.dz") > F.col("pitch") / 2 + 1e-6, -1).otherwise(F.col("b.section_index")).alias("section_index"))


def resample_labels(labels: DataFrame, *, size: tuple[int, int], new_size: tuple[int, int]) -> DataFrame:
    """(section_index, y, x, label) on a grid of another size, each cell from the nearest one."""
    spark = labels.sparkSession

    def axis(name: str, n: int, m: int) -> DataFrame:
        d = spark.range(m).select(F.col("id").cast("int").alias(f"new_{name}"))
        source = F.rint((F.col(f"new_{name}") + 0.5) * n / m - 0.5)
        return d.withColumn(name, F.least(F.greatest(source, F.lit(0)), F.lit(n - 1)).cast("int"))

    # two lists as long as an axis
    return labels.join(F.broadcast(axis("y", size[0], new_size[0])), "y").join(F.broadcast(axis("x", size[1], new_size[1])), "x").select("section_index", F.col("new_y").alias("y"), F.col("new_x").alias("x"), "label")


def new_size(size: int, section_mpp: float, voxel_um: float) -> int:
    return max(1, round(size * section_mpp / voxel_um))


def build_voxels(labels: DataFrame, planes: DataFrame) -> DataFrame:
    """z, y, x, label of a volume: each plane shows its section; planes of gaps stay empty."""
    return labels.join(F.broadcast(planes.where("section_index >= 0").select(F.col("plane").alias("z"), "section_index")), "section_index").where("label <> 0").select("z", "y", "x", "label")


def missing_sections(sections: DataFrame, labels: DataFrame) -> DataFrame:
    """The sections without any label row."""
    return sections.join(labels.select("section_index").distinct(), "section_index", "left_anti")


def require_sections(sections: DataFrame, labels: DataFrame) -> None:
    gone = [r["section_index"] for r in missing_sections(sections, labels).select("section_index").orderBy("section_index").collect()]  # all, by name
    if gone:
        raise KeyError(f"{len(gone)} sections have no label map: {gone}")


def global_ids(nuclei: DataFrame, *, order_col: str) -> DataFrame:
    """nuclei with instance_id from 1: by section, then by order_col; numbered inside each section, then shifted."""
    sizes = nuclei.groupBy("section_index").count()
    shift = sizes.select("section_index", F.coalesce(F.sum("count").over(_all().orderBy("section_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = nuclei.withColumn("_r", F.row_number().over(Window.partitionBy("section_index").orderBy(order_col)))
    return ranked.join(shift, "section_index").withColumn("instance_id", F.col("before") + F.col("_r")).drop("_r", "before")


def affine_centroids(centroids: DataFrame, transforms: DataFrame, *, level0_mpp: float, registration_mpp: float) -> DataFrame:
    """centroids (section_index, centroid_y, centroid_x in level-0 pixels) with y_um, x_um by their section's affine (a00 ... a12)."""
    s = level0_mpp / registration_mpp
    y, x = F.col("centroid_y") * s, F.col("centroid_x") * s
    out = centroids.join(F.broadcast(transforms), "section_index")
    return out.withColumns({"y_um": F.col("a00") * y + F.col("a01") * x + F.col("a02"), "x_um": F.col("a10") * y + F.col("a11") * x + F.col("a12")}).drop("a00", "a01", "a02", "a10", "a11", "a12")


def place_nuclei(nuclei: DataFrame, placed: DataFrame, transforms: DataFrame | None = None, *, level0_mpp: float | None = None, registration_mpp: float | None = None) -> DataFrame:
    """nuclei with z_um of their section, y_um and x_um.

    Registered coordinates (reg_y_um, reg_x_um) stand where a nucleus has them; the others go by their section's affine, which must
    then be given with both resolutions. Nuclei that have y_um and x_um already keep them.
    """
    if {"y_um", "x_um"} <= set(nuclei.columns):
        found = nuclei
    elif {"reg_y_um", "reg_x_um"} <= set(nuclei.columns) and transforms is None:
        found = nuclei.withColumns({"y_um": F.col("reg_y_um"), "x_um": F.col("reg_x_um")})
    else:
        if transforms is None or level0_mpp is None or registration_mpp is None:
            raise ValueError("nuclei without registered coordinates need transforms, level0_mpp and registration_mpp")
        found = affine_centroids(nuclei, transforms, level0_mpp=level0_mpp, registration_mpp=registration_mpp)
        if {"reg_y_um", "reg_x_um"} <= set(nuclei.columns):
            known = F.col("reg_y_um").isNotNull() & F.col("reg_x_um").isNotNull()
            found = found.withColumns({f"{n}_um": F.when(known, F.col(f"reg_{n}_um")).otherwise(F.col(f"{n}_um")) for n in "yx"})
    return found.drop("z_um").join(F.broadcast(placed.select("section_index", "z_um")), "section_index")


def section_affines(transforms: DataFrame, placed: DataFrame, *, mpp: float) -> DataFrame:
    """section_index, matrix: the rows of the 4 x 4 affine from a section's pixels (0, y, x at mpp) to micrometres (z, y, x)."""
    row = lambda *v: F.array(*(x.cast("double") if isinstance(x, Column) else F.lit(float(x)) for x in v))
    a = {k: F.col(k) for k in ("a00", "a01", "a02", "a10", "a11", "a12")}
    matrix = F.array(row(1, 0, 0, F.col("z_um")), row(0, a["a00"] * mpp, a["a01"] * mpp, a["a02"] * mpp), row(0, a["a10"] * mpp, a["a11"] * mpp, a["a12"] * mpp), row(0, 0, 0, 1))
    return transforms.join(F.broadcast(placed.select("section_index", "z_um")), "section_index").select("section_index", matrix.alias("matrix"))


@dataclass
class Volume:
    """A built volume: its voxels, the section of each plane (-1: a gap), nuclei if there are any, and its scale."""

    voxels: DataFrame
    planes: DataFrame
    nuclei: DataFrame | None
    voxel_um: float
    gaps: list[int]


def build_volume(sections: DataFrame, labels: DataFrame, *, size: tuple[int, int], section_mpp: float, nuclei: DataFrame | None = None, transforms: DataFrame | None = None, target_um: float | None = None, thickness_um: float | None = None, interval: int | None = None, level0_mpp: float | None = None, registration_mpp: float | None = None, smooth_sigma: float = 0.0, order_col: str = "centroid_y", present: DataFrame | None = None) -> Volume:
    """Stack the label rows (section_index, y, x, label; of `size` pixels at section_mpp) of all sections, nearest section for each plane.

    sections: section_index, section_number (null: no numbers), and optionally thickness_um. With thickness and interval the
    spacing is theirs; else by the thickness of each section, if all have one; else a voxel each, with a warning. Raises if a section
    has no labels, if section numbers do not rise, or if a section's own thickness is not the spacing. Gaps are named in a warning.
    present: the sections (section_index) that have a label map, if one without any label row (all space) is to count.
    """
    voxel_um, spacing = resolve_voxel(target_um, thickness_um, interval)
    require_sections(sections, labels if present is None else present)
    facts = sections if "thickness_um" in sections.columns else sections.withColumn("thickness_um", F.lit(None).cast("double"))
    n, own, odd, numbered = facts.agg(F.count("*"), F.count("thickness_um"), F.count_if(F.abs(F.col("thickness_um") - F.lit(spacing)) > 1e-9), F.count("section_number")).first()
    if numbered and (numbered < n or check_numbers(facts).limit(1).count()):
        raise ValueError("section_number must rise from section to section, without blanks")
    if spacing is not None:
        if odd:
            raise ValueError(f"{odd} sections have a thickness_um other than the section spacing {spacing}")
        number = "section_number" if numbered else "section_index"
        placed = section_z(facts.withColumn("section_number", F.col(number)), spacing_um=spacing)
    else:
        if own < n:
            warnings.warn(f"{n - own} of {n} sections have no thickness; they are placed {voxel_um} um apart", stacklevel=2)
        placed = section_z(facts, thickness_col="thickness_um", default_um=voxel_um)
    planes = plane_sources(placed, voxel_um=voxel_um)
    gaps = [r[0] for r in planes.where("section_index < 0").select("plane").orderBy("plane").collect()]  # bounded by the planes
    if gaps:
        warnings.warn(f"{len(gaps)} planes have no section within half a pitch and stay empty: {gaps}", stacklevel=2)
    shape = tuple(new_size(s, section_mpp, voxel_um) for s in size)
    cells = labels if shape == tuple(size) else resample_labels(labels, size=size, new_size=shape)
    merged = None
    if nuclei is not None:
        if transforms is not None and smooth_sigma > 0:
            transforms = smooth_transforms(transforms, sigma=smooth_sigma, columns=["a00", "a01", "a02", "a10", "a11", "a12"])
        merged = global_ids(place_nuclei(nuclei, placed, transforms, level0_mpp=level0_mpp, registration_mpp=registration_mpp), order_col=order_col)
    return Volume(build_voxels(cells, planes), planes, merged, voxel_um, gaps)


def build_from_run(spark: SparkSession, folder: str, *, size: tuple[int, int], manifest_path: str | None = None, target_um: float | None = None, thickness_um: float | None = None, interval: int | None = None, with_nuclei: bool = True, smooth_sigma: float = 0.0) -> Volume:
    """The volume of a run's folder: `labels` (or `label_maps` of PNG files) and `nuclei` by section, `transforms`, and its recorded metadata.

    A recorded thickness counts only with a recorded interval, and only if neither is given. Sections without labels or, unless
    with_nuclei is False, without nuclei are all named in one error.
    """
    if not sinks.exists(spark, folder):
        raise FileNotFoundError(folder)
    facts = sinks.read_metadata(spark, folder)
    path = manifest_path or facts.get("manifest_csv")
    if path is None:
        raise ValueError(f"no manifest given, and none recorded in {folder}")
    if thickness_um is None and interval is None and {"section_thickness_um", "sampling_interval"} <= set(facts):
        thickness_um, interval = facts["section_thickness_um"], facts["sampling_interval"]
    listed = manifest.load_manifest(spark, path)
    numbers = manifest.section_numbers(listed) if listed.where("section_number is not null").limit(1).count() else listed.select("section_index", F.lit(None).cast("int").alias("section_number"))
    sections = listed.select("section_index").join(numbers, "section_index").join(manifest.thickness(listed), "section_index")
    maps = f"{folder}/label_maps"
    present = None
    as_files = sinks.exists(spark, maps) and not sinks.exists(spark, f"{folder}/labels")
    for part in ("labels", "nuclei") if with_nuclei else ("labels",):
        there = label_png.sections_in(spark, maps) if as_files and part == "labels" else sinks.sections_written(spark, f"{folder}/{part}")
        present = there if part == "labels" else present
        gone = [r[0] for r in sections.join(there, "section_index", "left_anti").select("section_index").orderBy("section_index").collect()]
        if gone:
            raise ValueError(f"{len(gone)} sections have no {part} in {folder}: {gone}")
    read = lambda part: sinks.read_sections(spark, f"{folder}/{part}")
    transforms = spark.read.parquet(f"{folder}/transforms").withColumn("section_index", F.col("section_index").cast("int")) if sinks.exists(spark, f"{folder}/transforms") else None
    labels = label_png.pixels_of(label_png.read_runs(spark, maps)) if as_files else read("labels")
    return build_volume(sections, labels, size=size, section_mpp=facts.get("seg_mpp", 0.5), nuclei=read("nuclei") if with_nuclei else None, transforms=transforms, target_um=target_um, thickness_um=thickness_um, interval=interval, level0_mpp=facts.get("level0_mpp"), registration_mpp=facts.get("registration_mpp", 8.0), smooth_sigma=smooth_sigma, present=present)


def smooth_transforms(transforms: DataFrame, *, sigma: float, columns: list[str]) -> DataFrame:
    """Gaussian along the sections with the end values continued; sigma of 0 or less changes nothing."""
    if sigma <= 0:
        return transforms.select("section_index", *columns)
    w = gaussian_weights(sigma)
    r = len(w) // 2
    order = _all().orderBy("section_index")
    numbered = transforms.withColumn("i", (F.row_number().over(order) - 1).cast("int")).withColumn("last", (F.count("*").over(_all()) - 1).cast("int"))
    taps = numbered.select("section_index", F.posexplode(F.array(*(F.lit(v) for v in w))).alias("k", "w"), "i", "last").select("section_index", "w", F.least(F.greatest(F.col("i") + F.col("k") - r, F.lit(0)), F.col("last")).alias("j"))
    source = numbered.select(F.col("i").alias("j"), *columns)
    return taps.join(F.broadcast(source), "j").groupBy("section_index").agg(*(F.sum(F.col(c) * F.col("w")).alias(c) for c in columns))


def fill_missing(method: str = "nearest") -> None:
    """nearest is what plane_sources does; nothing else is there."""
    if method in ("linear", "optical_flow"):
        raise NotImplementedError(method)
    if method != "nearest":
        raise ValueError(f"unknown method {method!r}")
