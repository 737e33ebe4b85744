"""Tiles and pixels: grids, ownership of detections, overlapping predictions, block means, masks, fits, instance features.

Pixels are rows (section_index, y, x, ...). Models are callables that a caller maps over tiles; none is part of the engine.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.operators import meshes
from voxelspark.operators.morphology import bit_rows, opening


def tile_grid(sizes: DataFrame, *, tile: int, overlap: int = 0, stride_is_tile: bool = True) -> DataFrame:
    """section_index, row, col, y0, x0, y1, x1 over sections of (height, width).

    stride_is_tile: tiles one after another, each widened by the overlap on all sides; else tiles that share the overlap.
    """
    if not 0 <= overlap < tile:
        raise ValueError("overlap must be at least 0 and under the tile")
    stride = tile if stride_is_tile else tile - overlap
    steps = lambda c: F.sequence(F.lit(0), F.greatest(F.col(c) - 1, F.lit(0)), F.lit(stride))
    grid = sizes.select("section_index", "height", "width", F.posexplode(steps("height")).alias("row", "y")).select("*", F.posexplode(steps("width")).alias("col", "x"))
    before, after = (overlap, tile + overlap) if stride_is_tile else (0, tile)
    return grid.select("section_index", "row", "col", F.greatest(F.col("y") - before, F.lit(0)).alias("y0"), F.greatest(F.col("x") - before, F.lit(0)).alias("x0"), F.least(F.col("y") + after, F.col("height")).alias("y1"), F.least(F.col("x") + after, F.col("width")).alias("x1"))


def owned(detections: DataFrame, *, tile: int) -> DataFrame:
    """The detections (row, col, y, x) whose centroid lies in the core of their tile, [lo, hi): each object once, no shuffle."""
    return detections.where((F.col("y") >= F.col("row") * tile) & (F.col("y") < (F.col("row") + 1) * tile) & (F.col("x") >= F.col("col") * tile) & (F.col("x") < (F.col("col") + 1) * tile))


def tissue_tiles(grid: DataFrame, tissue: DataFrame, *, least: float = 0.1) -> DataFrame:
    """grid (section_index, y0, x0, y1, x1) with `share`, the part of each tile that is tissue, and `wanted`: at least `least` of it.

    Tissue is rows of bitmaps, counted by cells of 64 first; whole cells join tiles, and only the rows of cells on a border are looked at.
    """
    cell = 64
    own = bit_rows(tissue.select("section_index", "y", "x")).withColumn("cy", F.floor(F.col("y") / cell)).withColumnRenamed("word", "cx")
    span = lambda a, b: F.sequence(F.floor(F.col(a) / cell), F.floor((F.col(b) - 1) / cell))
    cover = grid.select("section_index", "y0", "x0", "y1", "x1", F.explode(span("y0", "y1")).alias("cy")).select("*", F.explode(span("x0", "x1")).alias("cx"))
    whole = (F.col("cy") * cell >= F.col("y0")) & ((F.col("cy") + 1) * cell <= F.col("y1")) & (F.col("cx") * cell >= F.col("x0")) & ((F.col("cx") + 1) * cell <= F.col("x1"))
    keys, box = ["section_index", "cy", "cx"], ["section_index", "y0", "x0", "y1", "x1"]
    counts = own.groupBy(*keys).agg(F.sum(F.bit_count("bits")).alias("n"))
    # Spark does not know how many cells tiles have, and would broadcast them; a task holds its part of them
    full = cover.where(whole).hint("shuffle_hash").join(counts, keys).select(*box, "n")
    lo, hi = (F.col(c).cast("int") for c in ("lo", "hi"))
    mask = F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), cell - (hi - lo)), lo)
    bounds = {"lo": F.greatest(F.col("x0") - F.col("cx") * cell, F.lit(0)), "hi": F.least(F.col("x1") - F.col("cx") * cell, F.lit(cell))}
    met = cover.where(~whole).withColumns(bounds).where("lo < hi").hint("shuffle_hash").join(own, keys).where("y >= y0 and y < y1")
    rim = met.groupBy(*box).agg(F.sum(F.bit_count(F.col("bits").bitwiseAND(mask))).alias("n"))
    total = full.unionByName(rim).groupBy(*box).agg(F.sum("n").alias("n"))
    share = F.coalesce("n", F.lit(0)) / ((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")))
    return grid.join(total, box, "left").withColumn("share", share).withColumn("wanted", F.col("share") >= least).drop("n")


def off_scale(tile: int, seg_mpp: float, train_mpp: float = 0.4402, *, model_tile: int = 448, tolerance: float = 0.05) -> float | None:
    """The scale that a model sees if it is off its own by more than the tolerance, with a warning; else None."""
    seen = seg_mpp * tile / model_tile
    if abs(seen / train_mpp - 1) <= tolerance:
        return None
    warnings.warn(f"tiles of {tile} show {seen:.3f} um per pixel to a model for {train_mpp:.3f}; matched_tile gives the size that fits", stacklevel=2)
    return seen


def overlap_argmax(predictions: DataFrame, tissue: DataFrame | None = None) -> DataFrame:
    """section_index, y, x, label: the class with the highest mean of all predictions (the lowest of equals); 0 off tissue.

    A tile that tissue_tiles does not want is one prediction of class 0 with probability 1 for each of its pixels.
    """
    mean = predictions.groupBy("section_index", "y", "x", "class_index").agg((F.sum("prob") / F.count("*")).alias("p"))
    best = mean.groupBy("section_index", "y", "x").agg(F.max_by("class_index", F.struct("p", -F.col("class_index"))).alias("label"))
    if tissue is None:
        return best
    inside = tissue.select("section_index", "y", "x", F.lit(True).alias("inside"))
    return best.join(inside, ["section_index", "y", "x"], "left").withColumn("label", F.when(F.col("inside"), F.col("label")).otherwise(0)).drop("inside")


def block_mean(pixels: DataFrame, *, factor: int, height: int, width: int, value: str = "value") -> DataFrame:
    """section_index, y, x, value: means of blocks, cut to whole numbers; rows and columns that fill no block are left out."""
    whole = pixels.where((F.col("y") < height // factor * factor) & (F.col("x") < width // factor * factor))
    return whole.groupBy("section_index", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.floor(F.avg(value)).cast("int").alias("value"))


def downsample(pixels: DataFrame, *, mpp: float, target_mpp: float, height: int, width: int, value: str = "value") -> DataFrame:
    """section_index, y, x, value at the target resolution: block means by the whole part of the factor, then what is left of it.

    The rest (over 0.1 %) weighs the reduced pixels by how much of each new pixel they cover. Never enlarges by more than that rest.
    """
    factor = max(1, math.floor(target_mpp / mpp + 1e-6))
    rest = mpp * factor / target_mpp
    small = block_mean(pixels, factor=factor, height=height, width=width, value=value) if factor > 1 else pixels.select("section_index", "y", "x", F.col(value).alias("value"))
    if abs(rest - 1) <= 1e-3:
        return small
    sizes = {"y": height // factor, "x": width // factor}
    for axis, n in sizes.items():
        m, other = max(1, round(n * rest)), "x" if axis == "y" else "y"
        step = n / m
        to = F.explode(F.sequence(F.floor(F.col(axis) / step + 1e-9), F.least(F.ceil((F.col(axis) + 1) / step - 1e-9) - 1, F.lit(m - 1)))).alias("to")
        cover = F.least(F.col(axis) + 1, (F.col("to") + 1) * step) - F.greatest(F.col(axis), F.col("to") * step)
        small = small.select("section_index", other, axis, "value", to).where(F.col(axis) < n).withColumn("w", cover)
        small = small.groupBy("section_index", other, F.col("to").cast("int").alias(axis)).agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))
    return small.select("section_index", "y", "x", F.floor(F.col("value") + 1e-9).cast("int").alias("value"))


def stains(r: Column, g: Column, b: Column) -> list[Column]:
    """Haematoxylin, eosin and DAB of a pixel: optical densities (relative to one millionth) in the basis of the three stains."""
    # fixed values: the colour vectors of the stains
    basis = np.linalg.inv(np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11], [0.27, 0.57, 0.78]]))
    density = [F.log(F.greatest(c / 255, F.lit(1e-6))) / math.log(1e-6) for c in (r, g, b)]
    return [F.greatest(sum((d * float(w) for d, w in zip(density[1:], basis[1:, k], strict=True)), density[0] * float(basis[0, k])), F.lit(0.0)) for k in range(3)]


def gray_valleys(histogram: DataFrame, *, bins: int = 256, least_width: float = 0.06, least_prominence: float = 0.01) -> DataFrame:
    """section_index, valley: the gray value between a wide first hump and the spike after it, null without such a shape.

    histogram: section_index, bin, n (at most `bins` rows for each section). Counts are smoothed with a sigma of two bins.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(bins)
        n[pdf["bin"].to_numpy()] = pdf["n"]
        kernel = np.exp(-0.5 * (np.arange(-8, 9) / 2) ** 2)
        smooth = np.convolve(np.pad(n, 8, "symmetric"), kernel / kernel.sum(), "valid")
        return pd.DataFrame({"section_index": [pdf["section_index"].iloc[0]], "valley": [_valley(smooth, least_width * bins, least_prominence)]})

    return histogram.groupBy("section_index").applyInPandas(one, "section_index int, valley double")


def _valley(h: np.ndarray, least_width: float, least_prominence: float) -> float | None:
    def foot(p: int, step: int) -> float:
        k, low = p, h[p]
        while 0 <= k < len(h) and h[k] <= h[p]:
            low, k = min(low, h[k]), k + step
        return low

    tops = [p for p in range(1, len(h) - 1) if h[p - 1] < h[p] >= h[p + 1]]
    rise = {p: h[p] - max(foot(p, -1), foot(p, 1)) for p in tops}
    tops = [p for p in tops if rise[p] >= least_prominence * h.max()]
    if len(tops) < 2:
        return None
    first, second = tops[:2]
    level, a, b = h[first] - 0.9 * rise[first], first, first
    while a > 0 and h[a] > level:
        a -= 1
    while b < len(h) - 1 and h[b] > level:
        b += 1
    low = first + int(h[first : second + 1].argmin())
    return low / len(h) if b - a >= least_width and h[low] < h[second] / 2 else None


def gray(r: Column, g: Column, b: Column) -> Column:
    """The luminance weights."""
    return (0.2125 * r + 0.7154 * g + 0.0721 * b) / 255


def background(r: Column, g: Column, b: Column, threshold: float = 0.8) -> Column:
    return gray(r, g, b) > threshold


def overview(pixels: DataFrame, *, mpp: float, height: int, width: int, target_mpp: float = 80.0) -> DataFrame:
    """section_index, y, x, r, g, b, tissue of whole sections at an overview's resolution; unscanned (black) pixels are white."""
    white = fill_unscanned(F.col("r"), F.col("g"), F.col("b"))
    scanned = pixels.select("section_index", "y", "x", *(c.alias(n) for n, c in zip("rgb", white, strict=True)))
    out = None
    for n in "rgb":
        small = downsample(scanned, mpp=mpp, target_mpp=target_mpp, height=height, width=width, value=n).withColumnRenamed("value", n)
        out = small if out is None else out.join(small, ["section_index", "y", "x"])
    return out.withColumn("tissue", ~background(F.col("r"), F.col("g"), F.col("b")))


def fill_unscanned(r: Column, g: Column, b: Column) -> list[Column]:
    black = (r == 0) & (g == 0) & (b == 0)
    return [F.when(black, 255).otherwise(c) for c in (r, g, b)]


def tissue_bbox(tissue: DataFrame, *, height: int, width: int, min_sections: int = 2, pad_frac: float = 0.02, open_steps: int = 0) -> DataFrame:
    """y0, x0, y1, x1 around the pixels that are tissue in enough sections, padded and clamped; the whole frame without any.

    open_steps: each section's tissue is opened by so many steps first, so that specks do not count (two, where images are masked).
    """
    if open_steps:
        tissue = opening(tissue, open_steps)
    often = tissue.groupBy("y", "x").agg(F.countDistinct("section_index").alias("n")).where(F.col("n") >= min_sections)
    pad = {"y": int(pad_frac * height) + 2, "x": int(pad_frac * width) + 2}
    lo = lambda c: F.coalesce(F.greatest(F.min(c) - pad[c], F.lit(0)), F.lit(0))
    hi = lambda c, n: F.coalesce(F.least(F.max(c) + 1 + pad[c], F.lit(n)), F.lit(n))
    return often.agg(lo("y").alias("y0"), lo("x").alias("x0"), hi("y", height).alias("y1"), hi("x", width).alias("x1"))


def affine_fit(pairs: DataFrame, by: str = "section_index") -> DataFrame:
    """by, a00 ... a12: the least-squares affine from (u, v) to (y, x), from sums of products alone."""
    n, s = F.count("*"), lambda e: F.sum(F.expr(e))
    sums = pairs.groupBy(by).agg(n.alias("n"), *(s(e).alias(k) for k, e in {"su": "u", "sv": "v", "uu": "u*u", "uv": "u*v", "vv": "v*v", "sy": "y", "uy": "u*y", "vy": "v*y", "sx": "x", "ux": "u*x", "vx": "v*x"}.items()))
    sums = sums.withColumns({"cuu": F.expr("uu - su*su/n"), "cuv": F.expr("uv - su*sv/n"), "cvv": F.expr("vv - sv*sv/n")}).withColumn("det", F.expr("cuu*cvv - cuv*cuv"))
    out = [F.col(by)]
    for i, t in enumerate("yx"):
        a = F.expr(f"(cvv*(u{t} - su*s{t}/n) - cuv*(v{t} - sv*s{t}/n)) / det")
        b = F.expr(f"(cuu*(v{t} - sv*s{t}/n) - cuv*(u{t} - su*s{t}/n)) / det")
        out += [a.alias(f"a{i}0"), b.alias(f"a{i}1"), ((F.col(f"s{t}") - a * F.col("su") - b * F.col("sv")) / F.col("n")).alias(f"a{i}2")]
    return sums.select(*out)


def instance_features(pixels: DataFrame, *, mpp: float, by: tuple[str, ...] = ("section_index", "label")) -> DataFrame:
    """by, centroid_y, centroid_x, area_um2, eccentricity, orientation (0 for round ones) of labelled pixels (label 0 left out)."""
    return _ellipses(pixels.where("label <> 0").groupBy(*by).agg(F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"), (F.count("*") * mpp**2).alias("area_um2"), (F.covar_pop("y", "y") + 1 / 12).alias("a"), (F.covar_pop("x", "x") + 1 / 12).alias("c"), F.covar_pop("y", "x").alias("b")), by)


def run_features(runs: DataFrame, *, mpp: float, by: list[str]) -> DataFrame:
    """What instance_features has, from runs (by, y, x0, x1, both ends included), from whole sums of their powers."""
    n, exact = F.col("x1") - F.col("x0") + 1, lambda e: e.cast("decimal(38,0)")
    squares = lambda x: x * (x + 1) * (2 * x + 1)  # noqa: E731  six times the sum of squares up to x
    sums = {"n": n, "sy": n * F.col("y"), "sx2": n * (F.col("x0") + F.col("x1")), "syy": n * F.col("y") * F.col("y"), "sxx6": squares(F.col("x1")) - squares(F.col("x0") - 1), "sxy2": n * (F.col("x0") + F.col("x1")) * F.col("y")}
    of = runs.groupBy(*by).agg(*(F.sum(exact(e)).cast("decimal(30,0)").alias(k) for k, e in sums.items()))
    count = F.col("n").cast("double")
    covariance = lambda e, part: F.expr(e).cast("double") / (part * count * count)
    moments = {"a": covariance("n * syy - sy * sy", 1) + 1 / 12, "c": covariance("2 * n * sxx6 - 3 * sx2 * sx2", 12) + 1 / 12, "b": covariance("n * sxy2 - sy * sx2", 2)}
    return _ellipses(of.select(*by, (F.col("sy").cast("double") / count).alias("centroid_y"), (F.col("sx2").cast("double") / 2 / count).alias("centroid_x"), (count * mpp**2).alias("area_um2"), *(v.alias(k) for k, v in moments.items())), by)


def _ellipses(of: DataFrame, by: tuple[str, ...] | list[str]) -> DataFrame:
    """The ellipses that have the moments a (y with y), b (y with x), c (x with x)."""
    root = F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, F.lit(2)) + F.col("b") * F.col("b"))
    mid = (F.col("a") + F.col("c")) / 2
    ecc = F.when(mid + root > 0, F.sqrt(F.greatest(1 - (mid - root) / (mid + root), F.lit(0.0)))).otherwise(0.0)
    return of.select(*by, "centroid_y", "centroid_x", "area_um2", ecc.alias("eccentricity"), F.when(root > 1e-9, 0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("c"))).otherwise(0.0).alias("orientation"))


def instance_shapes(pixels: DataFrame, *, mpp: float, by: tuple[str, ...] = ("section_index", "label")) -> DataFrame:
    """by, feret_diameter_um, solidity of labelled pixels (label 0 left out). An instance is one group, of its rows' ends only.

    The hull is that of the middles between pixels and their neighbours; solidity is the share of the pixels in it that are labelled.
    """
    return _shapes(pixels.where("label <> 0").groupBy(*by, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")), mpp, by)


def run_shapes(runs: DataFrame, *, mpp: float, by: tuple[str, ...]) -> DataFrame:
    """What instance_shapes has, from runs (by, y, x0, x1, both ends included)."""
    return _shapes(runs.groupBy(*by, "y").agg(F.min("x0").alias("lo"), F.max("x1").alias("hi"), F.sum(F.col("x1") - F.col("x0") + 1).alias("n")), mpp, by)


def _shapes(rows: DataFrame, mpp: float, by: tuple[str, ...]) -> DataFrame:
    whole = rows.groupBy(*by).agg(F.sum("n").cast("long").alias("n"), F.flatten(F.collect_list(F.array(*(F.col(c).cast("long") for c in ("y", "lo", "hi"))))).alias("ends"))  # an instance's rows
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in whole.select(*by).schema)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, float]] = {}
        for batch in batches:
            ends, n = batch.column("ends"), batch.column("n").to_numpy()
            found = _shapes_of(ends.values.to_numpy(zero_copy_only=False).reshape(-1, 3), ends.offsets.to_numpy() // 3, n, known)
            feret, solid = (pa.array(c, pa.float64()) for c in found.T)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pc.multiply(feret, mpp), solid], names=[*by, "feret_diameter_um", "solidity"])

    return whole.mapInArrow(describe, f"{fields}, feret_diameter_um double, solidity double")


def _shapes_of(flat: np.ndarray, at: np.ndarray, n: np.ndarray, known: dict[bytes, tuple[float, float]]) -> np.ndarray:
    """_shape of each instance (rows flat[at[k] : at[k + 1]], n[k] pixels). Instances alike but for their place are measured once.

    known holds what earlier batches measured, some thousand small shapes.
    """
    size, out = np.diff(at), np.zeros((len(n), 2))
    if not len(n):
        return out
    flat = flat[np.lexsort((flat[:, 0], np.repeat(np.arange(len(n)), size)))]
    low = np.minimum.reduceat(flat, at[:-1])[:, [0, 1, 1]]
    flat = flat - np.repeat(low, size, axis=0)
    for rows in np.unique(size):
        own = np.flatnonzero(size == rows)
        table = np.column_stack((n[own], flat[(at[own][:, None] + np.arange(rows)).reshape(-1)].reshape(len(own), -1)))
        kinds, place = np.unique(table, axis=0, return_inverse=True)
        measured = np.zeros((len(kinds), 2))
        for k, kind in enumerate(kinds):
            name = kind.tobytes()
            shape = known.get(name)
            if shape is None:
                shape = _shape(kind[1:].reshape(-1, 3).astype(float), int(kind[0]))
                if len(known) < 4096 and rows <= 64:
                    known[name] = shape
            measured[k] = shape
        out[own] = measured[place.reshape(-1)]
    return out


def _shape(rows: np.ndarray, n: int) -> tuple[float, float]:
    """(Feret diameter, solidity) of n pixels by their rows (y, first x, last x)."""
    y, lo, hi = rows.T
    p = np.concatenate([np.column_stack((y + dy, x + dx)) for x in (lo, hi) for dy, dx in ((-0.5, 0), (0.5, 0), (0, -0.5), (0, 0.5))])
    ring = meshes.outline(np.unique(p, axis=0))
    side = np.roll(ring, -1, axis=0) - ring
    x, inside = np.arange(lo.min(), hi.max() + 1), 0
    for top in range(int(y.min()), int(y.max()) + 1, 64):  # some rows at a time
        row = np.arange(top, min(top + 64, int(y.max()) + 1))
        cross = side[:, 0, None, None] * (x - ring[:, 1, None, None]) - side[:, 1, None, None] * (row[:, None] - ring[:, 0, None, None])
        inside += int((cross >= -1e-9).all(axis=0).sum())
    return meshes.widest(ring), n / inside


def warp_points(points: DataFrame, warp: Callable[[int, np.ndarray], np.ndarray]) -> DataFrame:
    """points (section_index, centroid_y, centroid_x, ...) with reg_y_um, reg_x_um by warp(section_index, rows of y and x).

    Warped in batches where they are; a batch calls the function once for each of its sections, and not at all if it is empty.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros((len(pdf), 2))
            for section, at in pdf.groupby("section_index").indices.items():
                out[at] = warp(int(section), pdf[["centroid_y", "centroid_x"]].to_numpy(float)[at])
            yield pdf.assign(reg_y_um=out[:, 0], reg_x_um=out[:, 1])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInPandas(run, f"{kinds}, reg_y_um double, reg_x_um double")


def matched_tile(seg_mpp: float, train_mpp: float = 0.4402, tile: int = 448) -> int:
    return round(tile * train_mpp / seg_mpp)


def canvas(size: int, reg_mpp: float, target_mpp: float) -> int:
    return -int(-size * reg_mpp // target_mpp)


def overlay(labels: DataFrame, colours: DataFrame, *, alpha: float = 0.4) -> DataFrame:
    """labels (y, x, label, r, g, b) blended with the colours (label, cr, cg, cb); labels without a colour stay."""
    out = labels.join(F.broadcast(colours), "label", "left")
    blend = lambda c: F.floor(F.col(c) * (1 - alpha) + F.coalesce(F.col(f"c{c}"), F.col(c)) * alpha).cast("int").alias(c)
    return out.select("section_index", "y", "x", "label", *(blend(c) for c in "rgb"))
