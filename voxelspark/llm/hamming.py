"""Exact top-k neighbours of binary codes by incremental multi-index hashing.

A code is cut into segments of `WIDTH` bits. If two codes are within s * (r + 1) - 1 bits of each other, some of their s
segments are within r bits. The index has one row for each code and segment. In round r every open query probes, in each
segment, the values that are exactly r bits from its own, and the join meets the codes that have them. So no round repeats
another's probes, and a pair is compared once in all: in its first segment of those that differ least. Each query keeps the
k + 1 nearest codes met so far, and once it has them what is farther than the last is dropped where it is met. After round r none within s * (r + 1) - 1 bits can be missing, so a query closes once it
has its k neighbours among those; what it met beyond that reach waits for the rounds that cover it.

How much of the index is met depends on how far the k-th neighbour is: a segment's round r meets comb(16, r) / 65,536 of random
codes. `met_rows` tells how many rows a search met, round by round.

Rows with equal codes are searched once: the index holds distinct codes with their k + 1 least ids (no answer needs more), and
the queries are distinct codes too, so copies cost nothing. The index is broadcast while it has at most `broadcast_rows` rows
(960,000 did not fit a driver's heap of 750 MB); beyond that, probes and index are shuffled by segment and value.

Nulls: a null vector, or one without numbers, has no code, is no neighbour and gets no row. Null numbers and NaN count as
not positive, and so do the numbers that a vector lacks against the longest one: all numbers count, whatever the length. Ties go
to the least id. Rows alike in id count as one unless their codes differ. Fewer than k others: fewer rows. An empty table gives
none. Other columns are not read. Jobs run when `top_k` is called, one or two for each round.
"""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from voxelspark.llm.shared import drop_stored, stored

WIDTH = 16
#: Rows of the index that a task holds in a hash table (some 100 bytes each). With more of them both sides are sorted, which spills.
HASHED = 1_000_000


def sign_code(vector: Column, longs: int = 1) -> Column:
    """An array of longs whose bits say, number by number, which are positive; null without numbers."""

    def word(w: int) -> Column:
        bits = F.transform(F.slice(vector, 64 * w + 1, 64), lambda x, i: F.when((x > 0) & ~F.isnan(x.cast("double")), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return F.when(F.size(vector) > 0, F.array(*(word(w) for w in range(longs))))


def _segment(longs: list[Column], s: int) -> Column:
    per = 64 // WIDTH
    return F.shiftrightunsigned(longs[s // per], WIDTH * (s % per)).bitwiseAND((1 << WIDTH) - 1).cast("int")


def _masks(r: int) -> Column:
    """All values of `WIDTH` bits with exactly r of them set."""
    return F.expr(f"array({', '.join(str(m) for m in range(1 << WIDTH) if m.bit_count() == r)})")


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", broadcast_rows: int = 200_000, probes_per_task: int = 1_000_000, met_rows: list[tuple[int, int]] | None = None) -> DataFrame:
    """query_id, neighbour_id, distance, rank (from 1): the k nearest other rows of `vectors` for every row of `queries`.

    A list given as `met_rows` gets the number of open queries and of rows that their probes met for each round.
    """
    longest = F.max(F.size(vector_col)).alias("n")
    most = vectors.select(longest).union(queries.select(longest)).agg(F.max("n")).first()[0] or 1
    longs, segments = max(1, -(-most // 64)), 64 // WIDTH * max(1, -(-most // 64))
    coded = lambda df: df.select(F.col(id_col).cast("long").alias("id"), sign_code(F.col(vector_col), longs).alias("code")).where("code is not null and id is not null").distinct()
    asked = stored(coded(queries))
    by_code = Window.partitionBy("code").orderBy("id")
    least = coded(vectors).withColumn("r", F.row_number().over(by_code)).where(F.col("r") <= k + 1)
    codes = stored(least.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    words = [F.col("code")[w] for w in range(longs)]
    cut = F.explode(F.array(*(F.struct(F.lit(s).alias("segment"), _segment(words, s).alias("value")) for s in range(segments)))).alias("s")
    index = codes.select(F.col("code").alias("near"), F.col("ids")[0].alias("id"), F.size("ids").alias("n"), cut).select("near", "id", "n", "s.segment", "s.value")
    n_codes, n_ids = codes.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    small, enough = n_codes * segments <= broadcast_rows, min(k + 1, n_ids)
    if small:
        index = F.broadcast(index)
    else:
        # probes are made of few rows, so Spark takes them for few themselves: without a hint the driver collects and broadcasts them
        index = stored(index)
        fullest = index.groupBy("segment", "value").count().agg(F.max("count")).first()[0]
        a_task = fullest + n_codes * segments // int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        index = index.hint("shuffle_hash" if a_task <= HASHED else "merge")
    apart = [F.col("code")[w].bitwiseXOR(F.col("near")[w]) for w in range(longs)]
    distance = sum((F.bit_count(x) for x in apart[1:]), F.bit_count(apart[0])).cast("int")
    differ = [F.bit_count(_segment(apart, s)) for s in range(segments)]
    nearest, of = Window.partitionBy("code").orderBy("distance", "id"), Window.partitionBy("code")
    kept = found = vectors.sparkSession.createDataFrame([], "code array<long>, near array<long>, id long, n int, distance int")
    open_queries = stored(asked.select("code", F.lit(64 * longs).alias("bound")).distinct())
    for r in range(WIDTH + 1):
        n_open, n_masks, reach = open_queries.count(), comb(WIDTH, r), segments * (r + 1) - 1
        if not n_open or not n_codes:
            break
        # few queries make many probes: as many tasks as there are `probes_per_task` of them
        spread = -(-n_open * segments * n_masks // probes_per_task)
        asking = open_queries.repartition(max(1, min(n_open, spread)), "code").select("code", "bound", cut).select("code", "bound", "s.segment", F.col("s.value").alias("own"))
        probes = asking.select("code", "bound", "segment", "own", F.explode(_masks(r)).alias("mask")).select("code", "bound", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        met = probes.join(index, ["segment", "value"])
        if met_rows is not None:
            seen = Observation()
            met = met.observe(seen, F.count("*").alias("rows"))
        # not met by an earlier round, nor in an earlier segment of this one
        once = (F.least(*differ) == r) & (F.coalesce(*(F.when(d == r, F.lit(s)) for s, d in enumerate(differ))) == F.col("segment"))
        best = kept.unionByName(met.where((distance <= F.col("bound")) & once).select("code", "near", "id", "n", distance.alias("distance"))).withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1)
        covered = F.sum(F.when(F.col("distance") <= reach, F.col("n")).otherwise(0)).over(of) >= enough
        ring = stored(best.select("code", "near", "id", "n", "distance", covered.alias("closed")))
        if met_rows is not None:
            met_rows.append((n_open, seen.get["rows"]))
        found, kept = found.unionByName(ring.where("closed").drop("closed")), ring.where("not closed").drop("closed")
        far = F.when(F.sum("n") >= enough, F.max("distance")).alias("far")
        state = ring.groupBy("code").agg(F.max("closed").alias("closed"), far)
        left = open_queries.join(state, "code", "left").where(~F.coalesce("closed", F.lit(False))).select("code", F.coalesce("far", "bound").alias("bound"))
        before, open_queries = open_queries, stored(left)
        drop_stored(before)
    found = found.select("code", "near", "distance")
    ids = found.join(codes.select(F.col("code").alias("near"), "ids"), "near").select("code", "distance", F.explode("ids").alias("neighbour_id"))
    mine = asked.join(ids, "code").where(F.col("id") != F.col("neighbour_id")).select(F.col("id").alias("query_id"), "neighbour_id", "distance")
    return mine.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))).where(F.col("rank") <= k)
