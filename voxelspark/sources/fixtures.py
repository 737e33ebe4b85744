"""The driver's star schema seen as sections, voxels, nuclei and points, so that every operator runs at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOXEL_UM = 8.0
GRID = (7, 40, 40)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """section_index, section_number: one for each line number, with a gap after the fourth."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select((n - 1).cast("int").alias("section_index"), (n + F.when(n > 4, 2).otherwise(0)).cast("int").alias("section_number")).distinct()


def voxels(spark: SparkSession, sf_dir: str, side: int = 40) -> DataFrame:
    """z, y, x, label: spatially random labels; cells without rows are space."""
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") - 1).cast("int").alias("z"), (F.col("l_partkey") % side).cast("int").alias("y"), (F.col("l_suppkey") % side).cast("int").alias("x"))
    return cells.agg((F.sum(F.col("l_quantity").cast("long")) % 5).cast("int").alias("label"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, y, x, label: solid boxes of 3 x 8 x 8 voxels over the sections and cells that the line items name."""
    items = table(spark, sf_dir, "lineitem")
    z = items.select((F.col("l_linenumber") - 1).cast("int").alias("z")).distinct()
    y = items.select((F.col("l_partkey") % 40).cast("int").alias("y")).distinct()
    x = items.select((F.col("l_suppkey") % 40).cast("int").alias("x")).distinct()
    x = x.union(items.select((F.col("l_partkey") % 40).cast("int").alias("x"))).distinct()
    # three lists of at most 7, 40 and 40 numbers
    grid = z.join(y, F.lit(True)).join(x, F.lit(True))
    return grid.select("z", "y", "x", F.expr("cast(((y div 8) * 2 + (x div 8) * 3 + z div 3) % 5 as int)").alias("label"))


def towers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z, y, x, label: irregular bodies on a field that grows with the orders.

    Each order has a place of 3 x 3 cells, 64 in a row; each of its lines fills part of it, from the corner, in one section.
    """
    o = F.col("l_orderkey")
    rects = table(spark, sf_dir, "lineitem").groupBy(o.alias("o"), (F.col("l_linenumber") - 1).cast("int").alias("z")).agg(F.max(F.col("l_quantity").cast("long") % 3).alias("h"), F.max(F.col("l_partkey") % 3).alias("w"))
    cells = rects.select("o", "z", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h"))).alias("dy")).select("o", "z", "dy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w"))).alias("dx"))
    return cells.select("z", F.expr("cast((o div 64) * 3 + dy as int)").alias("y"), F.expr("cast((o % 64) * 3 + dx as int)").alias("x"), F.expr("cast(1 + (o div 3) % 4 as int)").alias("label"))


def nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instance_id, section_index, z_um, y_um, x_um, feret_diameter_um."""
    k = F.col("c_custkey")
    cents = F.abs(F.rint(F.col("c_acctbal") * 100).cast("long"))
    return table(spark, sf_dir, "customer").select((k + 1).alias("instance_id"), (k % 7).cast("int").alias("section_index"), ((k % 7) * 8).cast("double").alias("z_um"), ((k * 7919 % 32000).cast("double") / 100).alias("y_um"), ((cents % 32000).cast("double") / 100).alias("x_um"), (4 + k % 9).cast("double").alias("feret_diameter_um"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, z, y, x, label: the first three numbers of each embedding, a thousandfold."""
    at = lambda i: (F.col("embedding")[i].cast("double") * 1000)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), at(0).alias("z"), at(1).alias("y"), at(2).alias("x"), (F.col("label") % 5).cast("int").alias("label"))
