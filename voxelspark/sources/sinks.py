"""Where results go: CSV and Parquet, tables that are replaced as a whole or by section, and the facts of a run as JSON."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

METADATA = "run_metadata"
#: The settings that a run records, with their types.
METADATA_SCHEMA = "manifest_csv string, seg_mpp double, registration_mpp double, level0_mpp double, section_thickness_um double, sampling_interval int, tissue_type string, non_rigid boolean"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def write_csv(df: DataFrame, path: str) -> None:
    """df with a header, in as many files as it has partitions; lists become JSON text."""
    cols = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*cols).write.mode("overwrite").option("header", True).csv(path)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    p, fs = _fs(spark, old)
    if not fs.rename(p, _fs(spark, new)[0]):
        raise OSError(f"{old} could not become {new}")


def _delete(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def replace(df: DataFrame, path: str) -> DataFrame:
    """Write df in place of the table at path, which df may have been made from.

    The new table is written whole, the old one is renamed to `<path>.old`, the new one takes its place, and the old one is deleted last.
    So one of them is there at any time; `heal` brings back an old one that was left without a successor.
    """
    spark = df.sparkSession
    fresh, old = f"{path}.{uuid.uuid4().hex}", f"{path}.old"
    df.write.parquet(fresh)
    heal(spark, path)
    if exists(spark, path):
        _rename(spark, path, old)
    _rename(spark, fresh, path)
    _delete(spark, old)
    spark.catalog.refreshByPath(path)
    return spark.read.schema(df.schema).parquet(path)


def heal(spark: SparkSession, path: str) -> bool:
    """After a replace that was stopped: the old table comes back if there is no new one, else it goes. True if it came back."""
    old = f"{path}.old"
    if not exists(spark, old):
        return False
    if exists(spark, path):
        _delete(spark, old)
        return False
    _rename(spark, old, path)
    return True


def write_sections(df: DataFrame, path: str, sections: DataFrame | None = None) -> None:
    """Rows with a section_index, replacing the sections that df holds and no others.

    With `sections` (section_index), those are replaced, with or without rows, and recorded as finished once all rows are
    there, together with the table's columns: a section in which nothing was found is finished, too.
    """
    spark = df.sparkSession
    if sections is not None:
        for k in [r[0] for r in sections.select("section_index").distinct().collect()]:  # one for each section
            for folder in (_finished(path), path):
                _delete(spark, f"{folder}/section_index={k}")
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section_index").parquet(path)
    if sections is not None:
        columns = StructType([f for f in df.schema if f.name != "section_index"]).json()
        done = sections.select("section_index", F.lit(columns).alias("columns")).distinct()
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section_index").parquet(_finished(path))


def _finished(path: str) -> str:
    return f"{path}_finished"


def _partitioned(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, None if it has no section."""
    p, fs = _fs(spark, path)
    if not fs.exists(p) or not any(f.isDirectory() and f.getPath().getName().startswith("section_index=") for f in fs.listStatus(p)):
        return None
    return spark.read.parquet(path).withColumn("section_index", F.col("section_index").cast("int"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_sections; none, with the recorded columns, where all finished sections are empty."""
    found = _partitioned(spark, path)
    if found is not None:
        return found
    done = _partitioned(spark, _finished(path))
    if done is None:
        raise FileNotFoundError(path)
    columns = StructType.fromJson(json.loads(done.first()["columns"]))
    return spark.createDataFrame([], columns.add("section_index", IntegerType()))


def sections_written(spark: SparkSession, path: str) -> DataFrame:
    """section_index of the sections in a table of write_sections: those recorded as finished, or with rows where none is recorded."""
    found = _partitioned(spark, _finished(path))
    found = _partitioned(spark, path) if found is None else found
    if found is None:
        return spark.createDataFrame([], "section_index int")
    return found.select("section_index").distinct()


def write_metadata(spark: SparkSession, folder: str, **facts) -> None:
    """The facts of a run (names in METADATA_SCHEMA) as one line of JSON."""
    names = [f.split()[0] for f in METADATA_SCHEMA.split(", ")]
    unknown = set(facts) - set(names)
    if unknown:
        raise KeyError(f"no run records {sorted(unknown)}")
    row = spark.createDataFrame([tuple(facts.get(n) for n in names)], METADATA_SCHEMA)
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/{METADATA}")


def read_metadata(spark: SparkSession, folder: str) -> dict:
    """What write_metadata recorded; nothing where there is no record."""
    if not exists(spark, f"{folder}/{METADATA}"):
        return {}
    row = spark.read.schema(METADATA_SCHEMA).json(f"{folder}/{METADATA}").first()
    return {k: v for k, v in row.asDict().items() if v is not None} if row else {}
