"""Column expressions on grids and points."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def voxel_index(coord: Column, voxel_um: float, size: int) -> Column:
    """The voxel of a coordinate, clipped to the grid: no nucleus is dropped."""
    return F.least(F.greatest(F.floor(coord / voxel_um), F.lit(0)), F.lit(size - 1)).cast("int")


def nearest_voxel(coord: Column, voxel_um: float) -> Column:
    """The voxel whose centre is nearest, half to even."""
    return F.rint(coord / voxel_um).cast("int")


def code(z: Column, y: Column, x: Column) -> Column:
    """A long in raster order; coordinates stay under 2**21."""
    return z.cast("long") * (1 << 42) + y.cast("long") * (1 << 21) + x.cast("long")


def decode(c: Column) -> tuple[Column, Column, Column]:
    n = 1 << 21
    return F.floor(c / F.lit(1 << 42)).cast("int"), F.expr(f"cast(({_sql(c)} div {n}) % {n} as int)"), F.expr(f"cast({_sql(c)} % {n} as int)")


def _sql(c: Column) -> str:
    return c._jc.toString()


def offsets(connectivity: int, *, half: bool = False) -> list[tuple[int, int, int]]:
    """The neighbours of a voxel by 6, 18 or 26-connectivity; half: one of each opposite two."""
    if connectivity not in (1, 2, 3):
        raise ValueError(f"connectivity must be 1, 2 or 3, not {connectivity}")
    found = [d for d in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, d)) <= connectivity]
    return [d for d in found if d > (0, 0, 0)] if half else found


def sphere(spark: SparkSession, radius: float) -> DataFrame:
    """dz, dy, dx of the voxels within a radius in voxels: bounded by the radius."""
    h = int(radius)
    side = spark.range(2 * h + 1).select((F.col("id") - h).cast("int").alias("d"))
    cube = side.select(F.col("d").alias("dz")).join(side.select(F.col("d").alias("dy")), F.lit(True)).join(side.select(F.col("d").alias("dx")), F.lit(True))
    return cube.where(F.col("dz") * F.col("dz") + F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx") <= radius * radius)


def distance2(a: str, b: str, names: tuple[str, ...] = AXES) -> Column:
    """The squared distance of the columns a.z ... and b.z ..."""
    parts = [(F.col(f"{a}.{n}") - F.col(f"{b}.{n}")) * (F.col(f"{a}.{n}") - F.col(f"{b}.{n}")) for n in names]
    return parts[0] + parts[1] + parts[2]


def entropy(shares: list[Column]) -> Column:
    """-sum(f ln f) over the shares above 0; 0 where they are null."""
    out = F.lit(0.0)
    for f in shares:
        out = out - F.when(f > 0, f * F.ln(f)).otherwise(0.0)
    return out


def share(part: Column, total: Column, empty: float | None = None) -> Column:
    return F.when(total > 0, part / total).otherwise(F.lit(empty).cast("double"))


def eigenvalues(zz: Column, yy: Column, xx: Column, zy: Column, zx: Column, yx: Column) -> tuple[Column, Column]:
    """(largest, smallest) eigenvalue of a symmetric 3 x 3 matrix, in closed form."""
    q = (zz + yy + xx) / 3
    p2 = (zz - q) * (zz - q) + (yy - q) * (yy - q) + (xx - q) * (xx - q) + 2 * (zy * zy + zx * zx + yx * yx)
    p = F.sqrt(p2 / 6)
    a, b, c = (zz - q) / p, (yy - q) / p, (xx - q) / p
    d, e, f = zy / p, zx / p, yx / p
    r = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2
    phi = F.acos(F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0))) / 3
    flat = p <= 0
    third = 2.0943951023931953
    return F.when(flat, q).otherwise(q + 2 * p * F.cos(phi)), F.when(flat, q).otherwise(q + 2 * p * F.cos(phi + third))
