"""Counts within balls: blocks wholly inside add their counts, only the rim meets points.

`ball_counts` deals probes and points to blocks, a power of two smaller than the largest radius where they are dense, and in chunks of at most
about `CHUNK` rows. Chunks meet as boxes with counts by class, without their points: beyond the radius a pair of them ends; wholly
within, its counts are added to all probes of the chunk; only the others, the rim, are joined with their points. In a task that goes on
with sub-blocks of `PART` points in the order of a space-filling curve. Pairs of points are compared where a boundary
passes between their sub-blocks, and never leave the task.

`ball_composition` counts voxels. A ball is a set of lines along x, and 64 voxels of a line are a bitmap for each class: a line costs one
or two rows, and its voxels are counted by bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.geometry import AXES, nearest_voxel, share
from voxelspark.sources.checkpoints import stored

CHUNK, PART, FINEST = 4096, 32, 3


def _chunks(rows: DataFrame, side: float, classes: list[int] | None) -> DataFrame:
    """One row for each chunk: its block, salt, box, number of rows, counts by class, and its rows as ids, places and classes."""
    blocks = [F.floor(F.col(n) / side).alias(f"b{n}") for n in AXES]
    keyed = rows.select("*", *blocks)
    sizes = keyed.groupBy(*(f"b{n}" for n in AXES)).agg(F.ceil(F.count("*") / CHUNK).alias("salts"))
    many = sizes.where("salts > 1")  # blocks with more rows than a chunk holds
    salted = keyed.join(many, [f"b{n}" for n in AXES], "left").withColumn("salt", F.pmod(F.xxhash64("id", *AXES), F.coalesce("salts", F.lit(1))))
    each = salted.groupBy(*(f"b{n}" for n in AXES), "salt")
    counts = [] if classes is None else [F.array(*(F.count_if(F.col("cls") == c) for c in classes)).alias("by_class")]
    box = [f(n).alias(f"{e}{n}") for e, f in (("lo", F.min), ("hi", F.max)) for n in AXES]
    return each.agg(F.count("*").alias("n"), *counts, *box, F.flatten(F.collect_list(F.array(*AXES))).alias("at"), F.collect_list("cls" if classes is not None else "id").alias("what"))


def _pair_distances(near: bool) -> Column:
    """The squared distance of the nearest or farthest places of the boxes p and q, rounded as distances of points are."""
    total = None
    for n in AXES:
        a, b = F.col(f"q.lo{n}") - F.col(f"p.hi{n}"), F.col(f"p.lo{n}") - F.col(f"q.hi{n}")
        step = F.greatest(a, b, F.lit(0.0)) if near else F.greatest(F.col(f"q.hi{n}") - F.col(f"p.lo{n}"), F.col(f"p.hi{n}") - F.col(f"q.lo{n}"))
        total = step * step if total is None else total + step * step
    return total


def curve_order(at: np.ndarray) -> np.ndarray:
    """The order of points along a Morton curve of 10 bits for each axis."""
    low = at.min(0)
    cell = ((at - low) / np.maximum(at.max(0) - low, 1e-300).max() * 1023).astype(np.int64)
    key = np.zeros(len(at), np.int64)
    for bit in range(10):
        for a in range(3):
            key |= ((cell[:, a] >> bit) & 1) << (3 * bit + a)
    return np.argsort(key, kind="stable")


class Parts:
    """Points in the order of a curve, cut in sub-blocks with their boxes and counts by class."""

    def __init__(self, at: np.ndarray, kinds: np.ndarray):
        self.order = curve_order(at)
        self.at, self.kinds = at[self.order], kinds[self.order]
        self.first = np.arange(0, len(at), PART)
        self.last = np.minimum(self.first + PART, len(at))
        self.low, self.high = (f.reduceat(self.at, self.first) for f in (np.minimum, np.maximum))
        self.counts = np.add.reduceat(self.kinds, self.first)


def count_within(probes: Parts, points: Parts, radii: tuple[float, ...]) -> np.ndarray:
    """(probes in the order of their curve, radii, kinds): how many points lie within each radius."""
    out = np.zeros((len(probes.at), len(radii), points.kinds.shape[1]), np.int64)
    gap = np.maximum(np.maximum(points.low - probes.high[:, None], probes.low[:, None] - points.high), 0.0)
    reach = np.maximum(points.high - probes.low[:, None], probes.high[:, None] - points.low)
    near, far = (a[..., 0] * a[..., 0] + a[..., 1] * a[..., 1] + a[..., 2] * a[..., 2] for a in (gap, reach))
    square = np.array(radii) ** 2
    for i, (a, b) in enumerate(zip(probes.first, probes.last, strict=True)):
        inside = far[i][:, None] <= square
        out[a:b] += (inside.T.astype(np.int64) @ points.counts)[None]
        rim = np.flatnonzero(((near[i][:, None] <= square) & ~inside).any(1))
        if not len(rim):
            continue
        which = np.concatenate([np.arange(points.first[k], points.last[k]) for k in rim])
        counted = np.repeat(inside[rim], points.last[rim] - points.first[rim], axis=0)
        step = probes.at[a:b, None] - points.at[which]
        d2 = step[..., 0] * step[..., 0] + step[..., 1] * step[..., 1] + step[..., 2] * step[..., 2]
        for k, s in enumerate(square):
            out[a:b, k] += ((d2 <= s) & ~counted[:, k]).astype(np.float32).dot(points.kinds[which].astype(np.float32)).astype(np.int64)
    return out


def ball_counts(probes: DataFrame, points: DataFrame, radii: tuple[float, ...], classes: list[int]) -> DataFrame:
    """id, counts of every probe (id, z, y, x): for each radius the number of points (z, y, x, cls) within it, then those of each class.

    Both include a probe that is itself among the points. Probes without any point near have zeros.
    """
    radii, widest = tuple(float(r) for r in radii), float(max(radii))
    own = probes.select(F.col("id").cast("long").alias("id"), *(F.col(n).cast("double").alias(n) for n in AXES)).dropna(subset=list(AXES))
    other = points.select(F.monotonically_increasing_id().alias("id"), *(F.col(n).cast("double").alias(n) for n in AXES), F.coalesce(F.col("cls").cast("int"), F.lit(-1)).alias("cls")).dropna(subset=list(AXES))
    # the densest block of the widest radius decides how fine blocks are
    most = other.groupBy(*(F.floor(F.col(n) / widest) for n in AXES)).count().agg(F.max("count")).first()[0] or 0
    level = min(FINEST, max(0, math.ceil(math.log(max(1, most / CHUNK), 8))))
    side, step = widest / 2**level, 2**level
    p, q = stored(_chunks(own, side, None)), stored(_chunks(other, side, classes))
    facts = lambda df, *more: df.drop("at", "what").select(*(f"b{n}" for n in AXES), F.struct("salt", "n", *more, *(f"b{n}" for n in AXES), *(f"{e}{n}" for e in ("lo", "hi") for n in AXES)).alias("f"))
    around = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip((a, b, c), AXES, strict=True))) for a in range(-step, step + 1) for b in range(-step, step + 1) for c in range(-step, step + 1)))
    asked = facts(p).select(F.col("f").alias("p"), *(f"b{n}" for n in AXES), F.explode(around).alias("o")).select("p", *((F.col(f"b{n}") + F.col(f"o.{n}")).alias(f"b{n}") for n in AXES))
    pairs = asked.join(facts(q, "by_class").withColumnRenamed("f", "q"), [f"b{n}" for n in AXES]).select("p", "q", _pair_distances(True).alias("near"), _pair_distances(False).alias("far")).where(F.col("near") <= widest * widest)
    squares = [r * r for r in radii]
    mixed = [(F.col("near") <= s) & (F.col("far") > s) for s in squares]
    rim = mixed[0]
    for m in mixed[1:]:
        rim = rim | m
    width = 1 + len(classes)
    # wholly within some radii and beyond the others: counts are enough
    whole = [F.when(F.col("far") <= s, v).otherwise(0) for s in squares for v in (F.col("q.n"), *(F.col("q.by_class")[k] for k in range(len(classes))))]
    key = [f"b{n}" for n in AXES] + ["salt"]
    summed = pairs.where(~rim).groupBy(*(F.col(f"p.{k}").alias(k) for k in key)).agg(*(F.sum(w).cast("long").alias(f"s{i}") for i, w in enumerate(whole)))
    given = p.join(summed, key).select(F.explode("what").alias("id"), F.array(*(F.col(f"s{i}") for i in range(len(whole)))).alias("counts"))
    met = pairs.where(rim).select(*(F.col(f"p.{k}").alias(k) for k in key), *(F.col(f"q.{k}").alias(f"q_{k}") for k in key))
    targets = q.select(*(F.col(k).alias(f"q_{k}") for k in key), F.col("at").alias("q_at"), F.col("what").alias("q_cls"))
    # by probe chunk, so that a task adds up one chunk after another; few rows, much work: as many tasks as the session has partitions
    met = met.repartition(int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    ready = met.join(targets, [f"q_{k}" for k in key]).select(*key, "q_at", "q_cls").join(p.select(*key, F.col("at").alias("p_at"), F.col("what").alias("p_id")), key)
    rows = ready.sortWithinPartitions(*key).select(F.concat_ws(",", *key).alias("chunk"), "p_at", "p_id", "q_at", "q_cls")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, own_parts, total = None, None, None, None

        def done() -> pa.RecordBatch:
            back = np.empty_like(total)
            back[own_parts.order] = total
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(list(back.reshape(len(ids), -1)), pa.list_(pa.int64()))], names=["id", "counts"])

        for batch in batches:
            for k, chunk in enumerate(batch.column("chunk").to_pylist()):
                p_at, q_at, q_cls = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("p_at", "q_at", "q_cls"))
                if chunk != name:
                    if name is not None:
                        yield done()
                    name, ids = chunk, batch.column("p_id")[k].values.to_numpy()
                    own_parts = Parts(p_at.reshape(-1, 3), np.ones((len(ids), 1), np.int64))
                    total = np.zeros((len(ids), len(radii), width), np.int64)
                kinds = np.column_stack([np.ones(len(q_cls), np.int64), *((q_cls == c).astype(np.int64) for c in classes)])
                total += count_within(own_parts, Parts(q_at.reshape(-1, 3), kinds), radii)
        if name is not None:
            yield done()

    found = rows.mapInArrow(count, "id long, counts array<long>").unionByName(given).unionByName(own.select("id", F.array_repeat(F.lit(0).cast("long"), len(radii) * width).alias("counts")))
    return found.groupBy("id").agg(F.array(*(F.sum(F.col("counts")[i]) for i in range(len(radii) * width))).alias("counts"))


def ball_composition(centres: DataFrame, voxels: DataFrame, classes: list[int], *, voxel_um: float, radius_um: float, id_col: str = "id") -> DataFrame:
    """id, composition_frac_{c}: shares of the tissue voxels within the sphere around the nearest voxel; 0 without any."""
    reach = radius_um / voxel_um
    h = int(reach)
    lines = [(z, y, math.isqrt(int(reach * reach - z * z - y * y))) for z in range(-h, h + 1) for y in range(-h, h + 1) if z * z + y * y <= reach * reach]
    lines = F.broadcast(centres.sparkSession.createDataFrame(lines, "dz int, dy int, half int"))  # bounded by the radius
    at = centres.select(F.col(id_col), *(nearest_voxel(F.col(f"{n}_um"), voxel_um).alias(n) for n in AXES))
    spans = at.join(lines, F.lit(True)).select(id_col, (F.col("z") + F.col("dz")).alias("z"), (F.col("y") + F.col("dy")).alias("y"), (F.col("x") - F.col("half")).alias("lo"), (F.col("x") + F.col("half")).alias("hi"))
    words = spans.withColumn("word", F.explode(F.sequence(F.floor(F.col("lo") / 64), F.floor(F.col("hi") / 64))))
    first, last = F.greatest(F.col("lo") - F.col("word") * 64, F.lit(0)).cast("int"), F.least(F.col("hi") - F.col("word") * 64, F.lit(63)).cast("int")
    words = words.withColumn("mask", F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(63) - (last - first)), first))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("x"), F.lit(64)).cast("int"))
    maps = voxels.where(F.col("label").isin(classes)).groupBy("z", "y", F.floor(F.col("x") / 64).alias("word")).agg(*(F.coalesce(F.bit_or(F.when(F.col("label") == c, bit)), F.lit(0).cast("long")).alias(f"m{c}") for c in classes))
    counts = words.join(maps, ["z", "y", "word"], "left").groupBy(id_col).agg(*(F.coalesce(F.sum(F.bit_count(F.col(f"m{c}").bitwiseAND(F.col("mask")))), F.lit(0)).alias(f"n{c}") for c in classes))
    total = sum((F.col(f"n{c}") for c in classes), F.lit(0))
    return counts.select(id_col, *(share(F.col(f"n{c}"), total, 0.0).alias(f"composition_frac_{c}") for c in classes))
