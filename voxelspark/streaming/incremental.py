"""Sections as they arrive: each file of label rows becomes voxels once, and a run that stops goes on where it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelspark.sources import sinks

LABEL_ROWS = "section_index int, y int, x int, label int"


def ingest_sections(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Read what is new in source (Parquet of label rows) and replace those sections in target. Ends when all is read.

    A section is one partition. What a batch says about a pixel replaces what is there (label 0 clears it), the section's other pixels stay,
    so a section may come in several files, and a batch that runs twice leaves the same rows.
    """

    def write(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        said = batch.groupBy("section_index", "y", "x").agg(F.max("label").alias("label")).withColumn("new", F.lit(1))
        if sinks.exists(session, target):
            kept = session.read.schema(LABEL_ROWS).parquet(target).join(F.broadcast(batch.select("section_index").distinct()), "section_index", "left_semi")  # one row for each section
            said = said.unionByName(kept.select("section_index", "y", "x", "label", F.lit(0).alias("new")))
        rows = said.groupBy("section_index", "y", "x").agg(F.max_by("label", "new").alias("label")).where("label <> 0")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section_index").parquet(target)

    stream = spark.readStream.schema(LABEL_ROWS).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def section_counts(stream: DataFrame) -> DataFrame:
    """Running voxels by section and class of a stream of label rows."""
    return stream.where("label <> 0").groupBy("section_index", "label").agg(F.count("*").alias("n_voxels"))
