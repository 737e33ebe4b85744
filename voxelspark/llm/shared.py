"""Tables that cut lineage, in the folder that the cluster shares; bounded Arrow batches; joins that split frequent keys."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.sources.checkpoints import drop_stored, shared_dir, stored

__all__ = ["bounded", "drop_stored", "salted_join", "shared_dir", "stored"]

_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(df: DataFrame, most: int = 2 << 20) -> DataFrame:
    """df, whose session sends at most `most` bytes of texts to a Python worker at once, unless it says otherwise itself.

    Batches are bounded by rows alone else, and ten thousand long texts do not fit beside the heap. Workers keep the memory that their
    largest batch took until they end, through all later stages, so batches hold a few slices of bytewords and no more.
    """
    if df.sparkSession.conf.get(_BYTES, None) is None:
        df.sparkSession.conf.set(_BYTES, str(most))
    return df


def salted_join(rows: DataFrame, keyed: DataFrame, keys: list[str], by: Column, n: str, n_rows: int) -> DataFrame:
    """The inner join of `rows` with `keyed`, which has each key once and in column `n` how many rows have it, `n_rows` in all.

    A key with more rows than a task's even share is dealt, by the hash of `by`, to as many tasks as it needs; the others stay whole
    and are not repeated. There are fewer such keys than tasks, so the side of the rows learns of them by a broadcast.
    """
    tasks = min(10_000, max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // 1_000_000))
    share = -(-n_rows // tasks) or 1
    parts = F.ceil(F.col(n) / share).cast("int")
    hot = F.broadcast(keyed.where(F.col(n) > share).select(*keys, parts.alias("_parts")))
    many = rows.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    few = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(n)
    return many.join(few, [*keys, "_salt"]).drop("_salt")
