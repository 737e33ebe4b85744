"""A run in three stages over one folder: register, sections (in tasks, resumable), volume. And its command line.

Models are functions that a caller gives: `segment(sections) -> section_index, y, x, label` and `detect(sections) -> nuclei rows with a
section_index`. Each section is written as a whole, so a stage that was stopped does only what is missing.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from voxelspark.config import RUN_VOXEL_UM
from voxelspark.operators import volume
from voxelspark.plans.run import Step, run_quantification
from voxelspark.sources import manifest, sinks
from voxelspark.sources.checkpoints import drop_stored, stored

Model = Callable[[DataFrame], DataFrame]
STAGES = ("register", "sections", "volume")


def _no_volume(spark: SparkSession, folder: str) -> None:
    """Refuse a folder with a volume before any work: it would be in the way at the end."""
    if sinks.exists(spark, f"{folder}/volume"):
        raise FileExistsError(f"{folder}/volume is there already; move it or take another folder")


def _facts(spark: SparkSession, folder: str) -> dict:
    facts = sinks.read_metadata(spark, folder)
    if "manifest_csv" not in facts:
        raise FileNotFoundError(f"no record of a run in {folder}: run the register stage there first")
    return facts


def register_stage(spark: SparkSession, folder: str, manifest_path: str, transforms: DataFrame | None = None, *, overwrite: bool = False, **facts) -> None:
    """Check the manifest, store the sections' affines and what later stages need to know (see sinks.METADATA_SCHEMA).

    A folder that holds a volume is refused, unless it is to be overwritten.
    """
    volume.resolve_voxel(None, facts.get("section_thickness_um"), facts.get("sampling_interval"))
    if not overwrite:
        _no_volume(spark, folder)
    if not manifest.load_manifest(spark, manifest_path).limit(1).count():
        raise ValueError(f"no sections in {manifest_path}")
    if transforms is not None:
        transforms.write.mode("overwrite").parquet(f"{folder}/transforms")
    sinks.write_metadata(spark, folder, manifest_csv=manifest_path, **facts)


def sections_stage(spark: SparkSession, folder: str, segment: Model, detect: Model | None = None, *, task: int = 0, n_tasks: int = 1) -> int:
    """Segment the task's sections that have no labels yet, and detect nuclei in those that have none. Returns how many were done."""
    listed = manifest.load_manifest(spark, _facts(spark, folder)["manifest_csv"])
    mine, done = manifest.task_sections(listed, task, n_tasks), 0
    for part, model in (("labels", segment), ("nuclei", detect)):
        if model is None:
            continue
        todo = mine.join(sinks.sections_written(spark, f"{folder}/{part}"), "section_index", "left_anti")
        n = todo.count()
        if n:
            todo = stored(todo.select(*listed.columns))  # the same sections before and after the write
            sinks.write_sections(model(todo), f"{folder}/{part}", sections=todo)
            drop_stored(todo)
        done = max(done, n)
    return done


def volume_stage(spark: SparkSession, folder: str, *, size: tuple[int, int], shape: tuple[int, int, int] | None = None, voxel_um: float | None = None, with_nuclei: bool = True, overwrite: bool = False, **options) -> list[Step]:
    """Build the volume from the folder, store voxels, planes and nuclei, and quantify them.

    The voxel is that of the run (8 um) unless the section spacing or the caller says otherwise. An existing volume is not overwritten.
    """
    target = f"{folder}/volume"
    if not overwrite:
        _no_volume(spark, folder)
    facts = _facts(spark, folder)
    spaced = {"section_thickness_um", "sampling_interval"} <= set(facts)
    built = volume.build_from_run(spark, folder, size=size, target_um=voxel_um if voxel_um or spaced else RUN_VOXEL_UM, with_nuclei=with_nuclei)
    for name, df in (("voxels", built.voxels), ("planes", built.planes), ("nuclei", built.nuclei)):
        if df is not None:
            df.write.mode("overwrite").parquet(f"{target}/{name}")
    read = lambda name: spark.read.parquet(f"{target}/{name}")
    if shape is None:
        shape = (read("planes").count(), *(volume.new_size(s, facts.get("seg_mpp", 0.5), built.voxel_um) for s in size))
    if spaced:
        options |= {"thickness_um": facts["section_thickness_um"], "interval": facts["sampling_interval"]}
    return run_quantification(read("voxels"), read("nuclei") if with_nuclei else None, f"{folder}/quantification", voxel_um=built.voxel_um, shape=shape, **options)


def run_pipeline(spark: SparkSession, folder: str, manifest_path: str, segment: Model, detect: Model | None = None, *, size: tuple[int, int], transforms: DataFrame | None = None, voxel_um: float | None = None, overwrite: bool = False, facts: dict | None = None, **options) -> list[Step]:
    """All three stages. What can be refused is refused before any work."""
    facts = facts or {}
    volume.resolve_voxel(voxel_um, facts.get("section_thickness_um"), facts.get("sampling_interval"))
    if not overwrite:
        _no_volume(spark, folder)
    register_stage(spark, folder, manifest_path, transforms, overwrite=overwrite, **facts)
    sections_stage(spark, folder, segment, detect)
    return volume_stage(spark, folder, size=size, voxel_um=voxel_um, with_nuclei=detect is not None, overwrite=overwrite, **options)


#: Options that a variable of the environment sets where the command line does not.
VARIABLES = {"manifest": "VOXELSPARK_MANIFEST", "output": "VOXELSPARK_OUTPUT", "segment": "VOXELSPARK_SEGMENT", "detect": "VOXELSPARK_DETECT", "voxel_um": "VOXELSPARK_VOXEL_UM", "section_thickness_um": "VOXELSPARK_THICKNESS_UM", "sampling_interval": "VOXELSPARK_INTERVAL"}


def parser() -> argparse.ArgumentParser:
    """The command line; what VARIABLES hold, unless blank, are its defaults, read as if given there."""
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--stage", choices=("all", *STAGES), default="all")
    p.add_argument("--manifest")
    p.add_argument("--output")
    p.add_argument("--segment", help="module:function")
    p.add_argument("--detect", help="module:function")
    p.add_argument("--height", type=int)
    p.add_argument("--width", type=int)
    p.add_argument("--seg-mpp", type=float, default=0.5)
    p.add_argument("--level0-mpp", type=float)
    p.add_argument("--reg-mpp", type=float, default=8.0)
    p.add_argument("--voxel-um", type=float)
    p.add_argument("--section-thickness-um", type=float)
    p.add_argument("--sampling-interval", type=int)
    p.add_argument("--tissue-type", default="HGSC")
    p.add_argument("--task-index", type=int, default=0)
    p.add_argument("--n-tasks", type=int, default=1)
    p.add_argument("--overwrite", action="store_true")
    p.set_defaults(**{option: os.environ[name].strip() for option, name in VARIABLES.items() if os.environ.get(name, "").strip()})
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[Step] | None:
    p = parser()
    a = p.parse_args(argv)

    def need(*names: str) -> None:
        gone = [f"--{n}" for n in names if getattr(a, n.replace("-", "_")) is None]
        if gone:
            p.error(f"stage {a.stage} needs {', '.join(gone)}")

    def model(name: str | None) -> Model | None:
        return getattr(import_module(name.partition(":")[0]), name.partition(":")[2]) if name else None

    need("output", *(("manifest",) if a.stage in ("all", "register") else ()), *(("segment",) if a.stage in ("all", "sections") else ()), *(("height", "width") if a.stage in ("all", "volume") else ()))
    spark = spark or SparkSession.builder.getOrCreate()
    facts = {"seg_mpp": a.seg_mpp, "registration_mpp": a.reg_mpp, "level0_mpp": a.level0_mpp, "section_thickness_um": a.section_thickness_um, "sampling_interval": a.sampling_interval, "tissue_type": a.tissue_type}
    if a.stage == "register":
        return register_stage(spark, a.output, a.manifest, overwrite=a.overwrite, **facts)
    if a.stage == "sections":
        print(f"{sections_stage(spark, a.output, model(a.segment), model(a.detect), task=a.task_index, n_tasks=a.n_tasks)} sections")
        return None
    size, organ = (a.height, a.width), {"organ": a.tissue_type}
    if a.stage == "volume":
        steps = volume_stage(spark, a.output, size=size, voxel_um=a.voxel_um, with_nuclei=bool(sinks.sections_written(spark, f"{a.output}/nuclei").limit(1).count()), overwrite=a.overwrite, **organ)
    else:
        steps = run_pipeline(spark, a.output, a.manifest, model(a.segment), model(a.detect), size=size, voxel_um=a.voxel_um, overwrite=a.overwrite, facts=facts, **organ)
    for s in steps:
        print(f"{s.name}: {s.status} ({s.seconds:.1f} s) {s.note}".rstrip())
    return steps


if __name__ == "__main__":
    main()
