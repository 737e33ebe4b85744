"""The class maps of labelled volumes and the default scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Class names by organ and label. The class named `space` is no tissue.
CLASSES = {"HGSC": {0: "space", 1: "Epithelium", 2: "Stroma", 3: "rbc", 4: "Intraluminal secretion"}}
SPACE = "space"
#: Micrometres: of a run, and of a volume built without section thickness.
RUN_VOXEL_UM, VOLUME_VOXEL_UM = 8.0, 12.0


def tissue_classes(organ: str = "HGSC") -> dict[int, str]:
    if organ not in CLASSES:
        raise KeyError(f"no class map for {organ!r}, only for {', '.join(sorted(CLASSES))}")
    return {k: name for k, name in CLASSES[organ].items() if name != SPACE}


def class_table(spark: SparkSession, organ: str = "HGSC") -> DataFrame:
    """class_index, class_name of the tissue classes: a handful of rows."""
    return spark.createDataFrame(sorted(tissue_classes(organ).items()), "class_index int, class_name string")


def check_voxel(voxel_um: float) -> float:
    if not voxel_um > 0:
        raise ValueError(f"voxel_um must be positive, not {voxel_um}")
    return float(voxel_um)
