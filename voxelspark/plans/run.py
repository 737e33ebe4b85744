"""A whole quantification over stored tables: every step by itself, results as Parquet, a report in Markdown."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.config import class_table, tissue_classes
from voxelspark.operators import quantify as Q
from voxelspark.operators.components import connected_components
from voxelspark.sources.checkpoints import stored
from voxelspark.sources.sinks import write_csv


@dataclass
class Step:
    name: str
    status: str  # ok, failed or skipped
    seconds: float
    note: str = ""


def run_quantification(voxels: DataFrame, nuclei: DataFrame | None, output: str, *, voxel_um: float, shape: tuple[int, int, int], organ: str = "HGSC", thickness_um: float | None = None, interval: int | None = None, min_volume_um3: float = 1e4, size_threshold_um3: float = 1e6, radii_um: tuple[float, ...] = (50, 100, 200), percentiles: tuple[float, ...] = (50, 90, 99)) -> list[Step]:
    """Volumes, densities, lesions, profiles of picked lesions, neighbourhoods. A step that fails does not stop the others."""
    if (thickness_um is None) != (interval is None):
        raise ValueError("section_thickness_um and sampling_interval go together")
    thickness_um, interval = (voxel_um, 1) if thickness_um is None else (thickness_um, interval)
    spark, codes = voxels.sparkSession, sorted(tissue_classes(organ))
    classes, made, steps = class_table(spark, organ), {}, []

    def step(name: str, make: Callable[[], DataFrame], needs_nuclei: bool = False) -> None:
        if needs_nuclei and nuclei is None:
            steps.append(Step(name, "skipped", 0.0, "no nuclei"))
            return
        began = time.time()
        try:
            df = make()
            df.write.mode("overwrite").parquet(f"{output}/{name}")
            write_csv(spark.read.schema(df.schema).parquet(f"{output}/{name}"), f"{output}/csv/{name}")
            made[name] = spark.read.schema(df.schema).parquet(f"{output}/{name}")
            steps.append(Step(name, "ok", time.time() - began))
        except Exception as e:  # recorded, and the next step goes on
            steps.append(Step(name, "failed", time.time() - began, f"{type(e).__name__}: {e}"[:500]))

    parts = stored(connected_components(voxels))  # every later step reads it
    step("volumes", lambda: Q.volumetrics(voxels, classes, voxel_um=voxel_um, components=parts))
    classed = stored(Q.nucleus_classes(nuclei, voxels, voxel_um=voxel_um, shape=shape)) if nuclei is not None else None
    step("density", lambda: Q.class_density(made["volumes"], classed), True)

    def lesion_table() -> DataFrame:
        kept = Q.lesions(parts, classes, voxel_um=voxel_um, min_volume_um3=min_volume_um3, size_threshold_um3=size_threshold_um3)
        cells = parts.join(kept.select("component"), "component")
        shapes = Q.surface_area(cells, ["component"], voxel_um=voxel_um).join(Q.euler_number(cells, ["component"]), "component").join(Q.hull_shapes(cells, voxel_um=voxel_um), "component")
        return kept.join(shapes, "component")

    step("lesions", lesion_table)
    step("lesion_density", lambda: Q.lesion_cell_density(made["lesions"], Q.nuclei_to_lesions(nuclei, parts, made["lesions"], voxel_um=voxel_um, shape=shape), thickness_um=thickness_um, interval=interval, voxels=voxels, classes=codes, voxel_um=voxel_um), True)
    picked = [r["instance_id"] for r in Q.profile_lesions(made["lesions"], percentiles).collect()] if "lesions" in made else []  # one for each percentile
    for k in picked:
        step(f"radial_{k}", lambda k=k: Q.radial_profile(parts, made["lesions"], voxels, classed, k, codes, voxel_um=voxel_um, shape=shape), True)
        step(f"surface_{k}", lambda k=k: Q.surface_decorrelation(parts, made["lesions"], nuclei, k, voxel_um=voxel_um), True)
    step("neighborhood", lambda: Q.neighborhood_features(classed, codes, radii_um=radii_um).join(Q.nearest_class_distances(classed, codes), "instance_id"), True)
    spark.createDataFrame([(s.name, s.status, s.seconds, s.note) for s in steps], "step string, status string, seconds double, note string").coalesce(1).write.mode("overwrite").parquet(f"{output}/steps")
    spark.createDataFrame([(report(made, classed, steps, int(radii_um[0])),), ], "text string").coalesce(1).write.mode("overwrite").text(f"{output}/report")
    return steps


def markdown(df: DataFrame, limit: int = 50) -> str:
    """A report table: at most `limit` rows, numbers short, bars escaped."""
    rows = df.limit(limit + 1).collect()
    more = f"\n\nThe first {limit} rows; all are in the stored table." if len(rows) > limit else ""
    rows = rows[:limit]
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)]) + more


def report(made: dict[str, DataFrame], classed: DataFrame | None, steps: list[Step], radius: int) -> str:
    parts = ["# Quantification report", "## Steps", "\n".join(f"- {s.name}: {s.status} ({s.seconds:.1f} s) {s.note}".rstrip() for s in steps)]
    if "volumes" in made:
        parts += ["## Volumes", markdown(made["volumes"].drop("component_sizes_um3").orderBy("class_index"))]
    if "density" in made:
        parts += ["## Density", markdown(made["density"].orderBy("class_index"))]
    if "lesions" in made:
        parts += ["## Lesions by class", markdown(Q.lesion_summary(made.get("lesion_density", made["lesions"])).orderBy("class_index")), "## Largest lesions", markdown(made["lesions"].select("instance_id", "class_name", "volume_um3", "size_class").orderBy(F.desc("volume_um3"), "instance_id"), 10)]
    for name in made:
        if name.startswith("radial_"):
            parts += [f"## Bands of lesion {name[7:]}", markdown(made[name].where("shell_index = -1"))]
    profiles = [made[name] for name in made if name.startswith("surface_")]
    if profiles:
        parts += ["## Surfaces", markdown(Q.surface_summary(reduce(DataFrame.unionByName, profiles)).orderBy("lesion_id"))]
    if "neighborhood" in made and classed is not None:
        parts += ["## Neighbourhood by class", markdown(Q.neighborhood_summary(made["neighborhood"], classed, radius).orderBy("class_index"))]
    return "\n\n".join(parts) + "\n"
