"""Joins in space: distance join, nearest neighbours, exact distance transform, kernel density."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.functions.geometry import AXES, distance2
from voxelspark.sources.checkpoints import drop_stored, stored

_AROUND = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]

#: A squared distance beyond all real ones, and the width of a strip of lines.
_FAR, _STRIP = 1 << 60, 64
#: Points of a cell, halvings at most (points at one place stay together), and points of a chunk of such a place.
_CELL, _DEPTH, _CHUNK = 256, 18, 2048


def _bucketed(df: DataFrame, width: float) -> DataFrame:
    return df.withColumns({f"b{n}": F.floor(F.col(n) / width) for n in AXES})


def distance_join(probes: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Each row of probes with each row of points within `radius`, as structs p and q, and their squared distance d2.

    Both have z, y, x. Probes are copied to the 27 cells of side `radius` around them and meet points by cell: an equi-join
    whose partitions split where cells are dense. Aggregate right behind it; neighbour lists are never collected.
    """
    around = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(d, AXES, strict=True))) for d in _AROUND))
    p = _bucketed(probes, radius).select(F.struct(*probes.columns).alias("p"), *(f"b{n}" for n in AXES), F.explode(around).alias("o"))
    p = p.select("p", *((F.col(f"b{n}") + F.col(f"o.{n}")).alias(f"b{n}") for n in AXES))
    q = _bucketed(points, radius).select(F.struct(*points.columns).alias("q"), *(f"b{n}" for n in AXES))
    return p.join(q, [f"b{n}" for n in AXES]).select("p", "q", distance2("p", "q").alias("d2")).where(F.col("d2") <= radius * radius)


def nearest_by_class(points: DataFrame, classes: list[int], *, id_col: str = "id", class_col: str = "label") -> DataFrame:
    """id, cls, d2: the squared distance of each point to the nearest other point of each class; no row where there is none.

    Points lie in a cube that is halved level by level, until no cell has more than `_CELL` of them. From the top, cells and the
    cells of a class are split together: for a cell, the farthest that any of its points can be from a whole cell of the class bounds its
    nearest neighbours, and cells beyond that bound go. A class with one far nucleus is one cell at every level, whatever
    lies between. Points only meet those of the cells that are left, in numpy, chunk by chunk.
    """
    own = stored(points.select(F.col(id_col).cast("long").alias("id"), *(F.col(n).cast("double").alias(n) for n in AXES), F.col(class_col).cast("int").alias("cls")).dropna(subset=["id", *AXES]))
    ends = own.agg(*(F.max(n).alias(f"hi_{n}") for n in AXES), *(F.min(n).alias(f"lo_{n}") for n in AXES)).first()
    nothing = own.select("id", "cls", F.lit(0.0).alias("d2")).limit(0)
    if ends["hi_z"] is None:
        return nothing
    side = max(max(ends[f"hi_{n}"] - ends[f"lo_{n}"] for n in AXES), 1e-9) * (1 + 1e-9)
    cell = lambda level: [F.least(F.floor((F.col(n) - ends[f"lo_{n}"]) / side * 2**level), F.lit(2**level - 1)).cast("long").alias(f"b{n}") for n in AXES]
    depth = 0
    while depth < _DEPTH and own.groupBy(*cell(depth)).count().where(F.col("count") > _CELL).limit(1).count():
        depth += 1
    keys = [f"b{n}" for n in AXES]
    box = [f(n).alias(f"{e}{n}") for e, f in (("lo", F.min), ("hi", F.max)) for n in AXES]
    targets = own.where(F.col("cls").isin(classes))
    probes_at = lambda level: own.groupBy(*cell(level)).agg(*box)
    targets_at = lambda level: targets.groupBy("cls", *cell(level)).agg(F.count("*").alias("n"), *box)

    def gap(near: bool) -> Column:
        steps = [F.greatest(F.col(f"t_lo{n}") - F.col(f"hi{n}"), F.col(f"lo{n}") - F.col(f"t_hi{n}"), F.lit(0.0)) if near else F.greatest(F.col(f"t_hi{n}") - F.col(f"lo{n}"), F.col(f"hi{n}") - F.col(f"t_lo{n}")) for n in AXES]
        return steps[0] * steps[0] + steps[1] * steps[1] + steps[2] * steps[2]

    pairs = None  # a cell, a class, and the cells of that class that may hold a nearest point
    for level in range(depth + 1):
        t = targets_at(level).select("cls", *(F.col(k).alias(f"t_{k}") for k in keys), "n", *(F.col(f"{e}{n}").alias(f"t_{e}{n}") for e in ("lo", "hi") for n in AXES))
        p = probes_at(level)
        if pairs is None:
            met = p.join(t, F.lit(True))  # one cell with one for each class
        else:
            up = [F.floor(F.col(k) / 2).alias(f"u_{k}") for k in keys]
            t_up = [F.floor(F.col(f"t_{k}") / 2).alias(f"u_t_{k}") for k in keys]
            old = pairs.select("cls", *(F.col(k).alias(f"u_{k}") for k in keys), *(F.col(f"t_{k}").alias(f"u_t_{k}") for k in keys))
            met = old.join(p.select("*", *up), [f"u_{k}" for k in keys]).join(t.select("*", *t_up), ["cls", *(f"u_t_{k}" for k in keys)])
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.col(f"t_{k}"))
        # a cell's only point cannot be its own neighbour
        far = F.when(~(same & (F.col("n") == 1)), gap(False))
        bounded = met.withColumns({"near": gap(True), "far": far}).withColumn("most", F.min("far").over(Window.partitionBy("cls", *keys)))  # the cells left for one cell
        before, pairs = pairs, stored(bounded.where((F.col("near") <= F.col("most")) | F.col("most").isNull()).select("cls", *keys, *(f"t_{k}" for k in keys)))
        if before is not None:
            drop_stored(before)

    def chunks(rows: DataFrame, *by: str) -> DataFrame:
        at = rows.select("id", "cls", *AXES, *cell(depth))
        salts = at.groupBy(*by, *keys).agg(F.ceil(F.count("*") / _CHUNK).alias("salts"))
        dealt = at.join(salts.where("salts > 1"), [*by, *keys], "left").withColumn("salt", F.pmod(F.xxhash64("id", *AXES), F.coalesce("salts", F.lit(1))))
        return dealt.groupBy(*by, *keys, "salt").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list(F.array(*AXES))).alias("at"))  # _CHUNK points

    q = chunks(targets, "cls").select("cls", *(F.col(k).alias(f"t_{k}") for k in keys), F.col("ids").alias("t_ids"), F.col("at").alias("t_at"))
    mine = chunks(own)
    met = pairs.repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    rows = met.join(q, ["cls", *(f"t_{k}" for k in keys)]).join(mine, keys).sortWithinPartitions(*keys, "salt", "cls")
    named = rows.select(F.concat_ws(",", *keys, "salt", "cls").alias("chunk"), "cls", "ids", "at", "t_ids", "t_at")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None

        def done() -> pa.RecordBatch:
            ids, cls, best = state
            has = np.isfinite(best)
            return pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(np.full(int(has.sum()), cls), pa.int32()), pa.array(best[has])], names=["id", "cls", "d2"])

        for batch in batches:
            for k in range(batch.num_rows):
                ids, at, t_ids, t_at = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("ids", "at", "t_ids", "t_at"))
                if batch.column("chunk")[k].as_py() != name:
                    if name is not None:
                        yield done()
                    name, state = batch.column("chunk")[k].as_py(), [ids, batch.column("cls")[k].as_py(), np.full(len(ids), np.inf)]
                at, t_at = at.reshape(-1, 3), t_at.reshape(-1, 3)
                for i in range(0, len(ids), 256):
                    step = at[i : i + 256, None] - t_at
                    d2 = step[..., 0] * step[..., 0] + step[..., 1] * step[..., 1] + step[..., 2] * step[..., 2]
                    d2[ids[i : i + 256, None] == t_ids] = np.inf
                    np.minimum(state[2][i : i + 256], d2.min(1), out=state[2][i : i + 256])
        if name is not None:
            yield done()

    return named.mapInArrow(nearest, "id long, cls int, d2 double").groupBy("id", "cls").agg(F.min("d2").alias("d2"))


def distance_transform(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """cells (z, y, x) with d2, the exact squared distance in voxels to the nearest target: one axis after another.

    Along x it is the nearest target before or behind in the line, by windows. Along y, then z, it is the least sum of what the
    axes before gave and the squared step, in numpy: a group is the lines of one section (or row) in a strip of `_STRIP` places.
    Without targets there are no rows.
    """
    both = cells.select(*AXES, F.lit(True).alias("cell"), F.lit(False).alias("target")).unionByName(targets.select(*AXES, F.lit(False).alias("cell"), F.lit(True).alias("target")))
    line = Window.partitionBy("z", "y").orderBy("x")
    at = F.when(F.col("target"), F.col("x"))
    before = F.last(at, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first(at, ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    step = F.least(F.col("x") - before, behind - F.col("x")).cast("long")
    out = both.groupBy(*AXES).agg(F.max("cell").alias("cell"), F.max("target").alias("target")).withColumn("d2", F.coalesce(step * step, F.lit(_FAR))).drop("target")
    for axis, fixed in (("y", "z"), ("z", "y")):
        out = out.groupBy(fixed, F.floor(F.col("x") / _STRIP)).applyInPandas(_along(axis), "z int, y int, x int, cell boolean, d2 long")
    return out.where(F.col("cell") & (F.col("d2") < _FAR)).drop("cell")


def _along(axis: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        places, i = np.unique(pdf[axis].to_numpy(np.int64), return_inverse=True)
        lines, j = np.unique(pdf["x"].to_numpy(np.int64), return_inverse=True)
        value = np.full((len(places), len(lines)), _FAR, np.int64)
        value[i, j] = pdf["d2"]
        best = np.stack([(((places - p) ** 2)[:, None] + value).min(axis=0) for p in places])
        return pdf.assign(d2=best[i, j])[["z", "y", "x", "cell", "d2"]]

    return run


def _reflected(i: Column, n: int) -> Column:
    m = F.pmod(i, F.lit(2 * n))
    return F.when(m >= n, 2 * n - 1 - m).otherwise(m).cast("int")


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [v / sum(w) for v in w]


def smooth_grid(counts: DataFrame, shape: tuple[int, int, int], sigma: float, value: str = "value") -> DataFrame:
    """z, y, x, value: a separable Gaussian over a sparse grid with mirrored borders. Sparse in, sparse out."""
    weights = gaussian_weights(sigma)
    r = len(weights) // 2
    taps = F.array(*(F.struct(F.lit(k - r).alias("k"), F.lit(w).alias("w")) for k, w in enumerate(weights)))
    out = counts.select(*AXES, F.col(value).cast("double").alias("value"))
    for axis, n in zip(AXES, shape, strict=True):
        spread = out.select(*AXES, "value", F.explode(taps).alias("t"))
        # what the window around a mirrored place picks up is given out from each place and each of its mirror images
        out = spread.withColumn(axis, _reflected(F.col(axis) + F.col("t.k"), n)).groupBy(*AXES).agg(F.sum(F.col("value") * F.col("t.w")).alias("value"))
    return out


def gradient_magnitude(field: DataFrame, shape: tuple[int, int, int], spacing: float) -> DataFrame:
    """field (z, y, x, value; missing cells are 0) with its gradient: central differences, one-sided at the border."""
    around = F.array(*(F.struct(F.lit(a).alias("axis"), F.lit(d).alias("d")) for a in AXES for d in (-1, 1)))
    give = field.select(*AXES, "value", F.explode(around).alias("o"))
    moved = give.select(*((F.col(n) + F.when(F.col("o.axis") == n, F.col("o.d")).otherwise(0)).alias(n) for n in AXES), F.col("o.axis").alias("axis"), F.col("o.d").alias("d"), "value")
    inside = moved.where(" and ".join(f"{n} between 0 and {s - 1}" for n, s in zip(AXES, shape, strict=True)))
    terms = []
    for axis in AXES:
        for d in (-1, 1):
            terms.append(F.sum(F.when((F.col("axis") == axis) & (F.col("d") == d), F.col("value"))).alias(f"{axis}{'p' if d == -1 else 'n'}"))
    # a value given with d = -1 arrives one place before its own: there it is the next value
    around_values = inside.groupBy(*AXES).agg(*terms)
    out = around_values.join(field, list(AXES), "full").na.fill(0.0)
    parts = []
    for axis, n in zip(AXES, shape, strict=True):
        nxt, prev, own = F.col(f"{axis}p"), F.col(f"{axis}n"), F.col("value")
        step = F.when(F.col(axis) == 0, (nxt - own) / spacing).when(F.col(axis) == n - 1, (own - prev) / spacing).otherwise((nxt - prev) / (2 * spacing))
        parts.append((step if n > 1 else F.lit(0.0)) ** 2)
    return out.select(*AXES, "value", F.sqrt(parts[0] + parts[1] + parts[2]).alias("gradient"))
