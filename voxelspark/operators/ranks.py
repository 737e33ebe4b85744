"""Exact order statistics by refinement: counts in buckets close in on the wanted ranks, nothing is sorted or listed.

A round counts the values of each group between the bounds known so far, in `BUCKETS` equal steps, together with the least and largest
value of each step. The step that holds the wanted rank gives the next bounds. As bounds are always values themselves, every round
parts them further; a group ends when they are equal. Ten bits a round: a handful of rounds for any doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.sources.checkpoints import drop_stored, stored

BUCKETS = 1024


def _has(value: str) -> Column:
    return F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))


def at_ranks(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """by, name, rank (from 0), value, below: for each group and name the value at that rank, and how many are below it.

    A rank is an expression over n, the number of values of the group that are not null or NaN; groups without any give no row.
    """
    own = stored(rows.where(_has(value)).select(*by, F.col(value).alias("value")))
    names = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.cast("long").alias("rank")) for k, v in ranks.items()))).alias("_want")
    groups = own.groupBy(*by).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    left = stored(groups.where("n > 0").select(*by, names, "lo", "hi", F.lit(0).cast("long").alias("below")).select(*by, "_want.name", "_want.rank", "lo", "hi", "below"))
    keys, done = [*by, "name"], left.where("lo = hi")
    held = [left]
    while True:
        open_ = left.where("lo < hi")
        if not open_.limit(1).count():
            break
        met = own.join(open_, by) if by else own.join(F.broadcast(open_), F.lit(True))  # without groups: one row for each rank
        met = met.where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
        step = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BUCKETS), F.lit(BUCKETS - 1))
        # values next to each other may share a step; the ends never do
        step = F.when(F.col("value") == F.col("hi"), BUCKETS).when(F.col("value") == F.col("lo"), -1).otherwise(step)
        counts = met.groupBy(*keys, "rank", "below", step.alias("step")).agg(F.count("*").alias("c"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        so_far = F.sum("c").over(Window.partitionBy(*keys).orderBy("step"))  # BUCKETS rows
        found = counts.withColumn("upto", F.col("below") + so_far).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
        left = stored(found.select(*keys, "rank", "lo", "hi", (F.col("upto") - F.col("c")).alias("below")))
        held.append(left)
        done = done.unionByName(left.where("lo = hi"))
    out = stored(done.select(*keys, "rank", F.col("lo").alias("value"), "below"))
    drop_stored(own, *held)
    return out


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """by and a column for each named share (0 to 1): the percentile, between the two nearest values in proportion; null without values."""
    ranks = {f"{k}|{e}": f((F.col("n") - 1) * F.lit(float(s))) for k, s in shares.items() for e, f in (("lo", F.floor), ("hi", F.ceil))}
    found = at_ranks(rows, by, value, ranks)
    sizes = rows.groupBy(*by).agg(F.count_if(_has(value)).alias("n"))
    pick = {c: F.max(F.when(F.col("name") == c, F.col("value"))) for c in ranks}
    wide = found.groupBy(*by).agg(*(v.alias(c) for c, v in pick.items()))
    both = sizes.join(wide, by, "left") if by else sizes.join(wide, F.lit(True), "left")
    cols = []
    for k, s in shares.items():
        at = (F.col("n") - 1) * F.lit(float(s))
        lo, hi = F.col(f"`{k}|lo`").cast("double"), F.col(f"`{k}|hi`").cast("double")
        cols.append((lo + (hi - lo) * (at - F.floor(at))).alias(k))
    return both.select(*by, *cols)
