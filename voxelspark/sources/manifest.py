"""Manifests of slides: natural order, checked columns, splits of work, caches of exported files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The file types of slides.
SUFFIXES = ("czi", "svs", "ndpi", "tif", "tiff", "scn", "mrxs")
#: The names of the micrometre.
MICRONS = ("µm", "μm", "um", "micron", "microns", "micrometer", "micrometers", "micrometre", "micrometres")


def natural_key(name: Column) -> Column:
    """Sorts numbers inside names by value."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda c: F.when(c.rlike(r"^\d+$"), F.lpad(c, 20, "0")).otherwise(c))


def is_slide(name: Column) -> Column:
    return F.lower(name).rlike(r"\.(" + "|".join(SUFFIXES) + ")$")


def manifest_of(files: DataFrame) -> DataFrame:
    """section_index, filename, path of slides among files (path), in natural order of their names."""
    named = files.withColumn("filename", F.element_at(F.split("path", "/"), -1)).where(is_slide(F.col("filename")))
    order = Window.partitionBy().orderBy(natural_key(F.col("filename")), "filename", "path")  # one row for each slide
    return named.select((F.row_number().over(order) - 1).cast("int").alias("section_index"), "filename", "path")


def list_slides(spark: SparkSession, folder: str) -> DataFrame:
    return manifest_of(spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path"))


def write_manifest(manifest: DataFrame, path: str, *, thickness_um: DataFrame | None = None, section_number: DataFrame | None = None) -> None:
    """The manifest as one CSV file, with the columns of tables by section_index that are given. One row for each section.

    A table with more than one row for a section, or with a section that is not listed, is refused before anything is written, and so
    are section numbers that leave a section out. Section numbers are read back and checked. No sections are refused as well.
    """
    n = manifest.count()
    if not n:
        raise ValueError("a manifest needs sections")
    for name, table in (("thickness_um", thickness_um), ("section_number", section_number)):
        if table is None:
            continue
        rows, known = table.count(), manifest.join(table.where(F.col(name).isNotNull()).select("section_index").distinct(), "section_index").count()
        strange = table.join(manifest, "section_index", "left_anti").count()
        if rows != table.select("section_index").distinct().count() or strange or (name == "section_number" and known < n):
            raise ValueError(f"{name} has {rows} rows, {strange} of no section, and values for {known} of {n} sections")
        manifest = manifest.join(table, "section_index", "left")
    manifest.coalesce(1).sortWithinPartitions("section_index").write.mode("overwrite").option("header", True).csv(path)
    if section_number is not None:
        section_numbers(load_manifest(manifest.sparkSession, path)).write.format("noop").mode("overwrite").save()


def slides_by_section(slides: DataFrame, sections: DataFrame) -> DataFrame:
    """slides (name, ...) with their section_index: those named as a section's four digits, with or without .png, folders aside.

    Names that belong to no section of `sections` are left out.
    """
    index = F.expr("try_cast(regexp_extract(name, '(?:^|/)([0-9]{4,})(?:[.]png)?$', 1) as int)")
    known = slides.withColumn("section_index", index).where(F.regexp_extract("name", "(?:^|/)([0-9]{4,})(?:[.]png)?$", 1) == F.format_string("%04d", index))
    return known.join(sections.select("section_index").distinct(), "section_index")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """section_index, filename, path, thickness_um, section_number (as text, null where there is no such column).

    The index counts the rows in the order of the recorded one. A row without a path raises.
    """
    raw = spark.read.csv(path, header=True)
    if "path" not in raw.columns:
        raise KeyError(f"the manifest {path} has no column path")
    text = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c)
    order = F.col("section_index").cast("int") if "section_index" in raw.columns else F.monotonically_increasing_id()
    ranked = raw.withColumn("_r", F.row_number().over(Window.partitionBy().orderBy(order)) - 1)  # one row for each section
    where = F.when(F.coalesce(F.trim("path"), F.lit("")) == "", F.raise_error(F.format_string("row %s of the manifest has no path", F.col("_r"))).cast("string")).otherwise(F.col("path"))
    return ranked.select(F.col("_r").cast("int").alias("section_index"), text("filename"), where.alias("path"), text("thickness_um"), text("section_number"))


def section_numbers(manifest: DataFrame) -> DataFrame:
    """section_index, section_number: a whole number that rises from row to row; raises at the first row where it does not."""
    value = F.expr("try_cast(nullif(trim(section_number), '') as int)")
    last = F.lag(value).over(Window.partitionBy().orderBy("section_index"))  # one row for each section
    said = lambda why: F.raise_error(F.format_string(f"section_number {why}, section %s has %s", F.col("section_index"), F.col("section_number"))).cast("int")
    checked = F.when(value.isNull(), said("must be a whole number")).when(F.col("last") >= F.col("value"), said("must rise")).otherwise(F.col("value"))
    return manifest.withColumn("last", last).withColumn("value", value).select("section_index", checked.alias("section_number"))


def middle_slide(manifest: DataFrame) -> DataFrame:
    """section_index, path of the slide in the middle of the stack (the later of two)."""
    n = manifest.agg(F.floor(F.count("*") / 2).cast("int").alias("middle"))
    return manifest.join(F.broadcast(n), F.col("section_index") == F.col("middle")).select("section_index", "path")


def source_level(found: DataFrame, target_mpp: float) -> DataFrame:
    """section_index, level: the coarsest level (section_index, level, mpp, unit) at most 0.1 % coarser than the target.

    Raises for other units than micrometres, and where even the finest level is too coarse: nothing is ever enlarged.
    """
    fits = F.col("mpp") <= target_mpp * 1.001
    best = found.groupBy("section_index").agg(F.max(F.when(fits, F.col("level"))).alias("level"), F.min("mpp").alias("finest"), F.max(~F.lower(F.trim("unit")).isin(*MICRONS)).alias("odd"))
    said = lambda text, *cols: F.raise_error(F.format_string(text, "section_index", *cols)).cast("int")
    level = F.when(F.col("odd"), said("section %s is not measured in micrometres")).when(F.col("level").isNull(), said(f"section %s has %s um per pixel at its finest, too coarse for {target_mpp}", "finest")).otherwise(F.col("level"))
    return best.select("section_index", level.alias("level"))


def thickness(manifest: DataFrame) -> DataFrame:
    """section_index, thickness_um: blank is null; anything else that is no positive number raises."""
    raw = F.nullif(F.trim("thickness_um"), F.lit(""))
    value = F.expr("try_cast(nullif(trim(thickness_um), '') as double)")
    bad = raw.isNotNull() & (value.isNull() | (value <= 0))
    return manifest.select("section_index", F.when(bad, F.raise_error(F.format_string("thickness_um must be positive, section %s has %s", F.col("section_index"), raw)).cast("double")).otherwise(value).alias("thickness_um"))


def task_sections(sections: DataFrame, task: int, n_tasks: int) -> DataFrame:
    """Every n-th section, from the task's own number."""
    if not 0 <= task < n_tasks:
        raise ValueError(f"task {task} of {n_tasks}")
    return sections.where(F.pmod("section_index", F.lit(n_tasks)) == task)


def resume_todo(sections: DataFrame, done: DataFrame, outputs: list[str]) -> DataFrame:
    """The sections that lack some of the outputs. done: section_index, output."""
    full = done.where(F.col("output").isin(outputs)).groupBy("section_index").agg(F.countDistinct("output").alias("n")).where(F.col("n") == len(set(outputs)))
    return sections if not outputs else sections.join(full.select("section_index"), "section_index", "left_anti")


def merge_cache(old: DataFrame, new: DataFrame) -> DataFrame:
    """section_index, size, mtime, mpp, stale: records of the new run over the old; those of absent sections stay.

    stale: an old file exists and was made from something else.
    """
    facts = ("size", "mtime", "mpp")
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, "section_index", "full")
    differs = F.lit(False)
    for c in facts:
        differs = differs | ~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    known, wanted = F.col("o.mpp").isNotNull(), F.col("n.mpp").isNotNull()
    return both.select("section_index", *(F.when(wanted, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in facts), (known & wanted & differs).alias("stale"))


def levels(slides: DataFrame) -> DataFrame:
    """section_index, level, width, height, downsample: a pyramid of powers of two to 64, as far as a side has a pixel."""
    steps = F.array(*(F.lit(1 << k) for k in range(7)))
    out = slides.select("section_index", "width", "height", F.posexplode(steps).alias("level", "downsample"))
    return out.select("section_index", "level", F.expr("cast(width div downsample as int)").alias("width"), F.expr("cast(height div downsample as int)").alias("height"), "downsample").where("width >= 1 and height >= 1")


def best_level(found: DataFrame, wanted: float) -> DataFrame:
    """section_index, level: the coarsest level that is not coarser than wanted, else 0."""
    return found.groupBy("section_index").agg(F.coalesce(F.max_by(F.when(F.col("downsample") <= wanted, F.col("level")), F.when(F.col("downsample") <= wanted, F.col("downsample"))), F.lit(0)).alias("level"))
