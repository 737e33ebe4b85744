"""What bodies of voxels add up over the 2 x 2 x 2 cells between them: surfaces and Euler numbers.

Voxels are dealt into blocks of `SIDE` x `SIDE` rows of 63 cells, each row a long; voxels on the low side of a block also count for the block
before. A group's cells in a block are taken at once from its rows as bitmaps (numpy inside a task), so no voxel is ever repeated for its
cells, and only sums by group and block are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.operators import meshes
from voxelspark.operators.components import bits_set, chunks, voxels_before

SIDE, WORD = 64, 63
_WHOLE = np.uint64((1 << WORD) - 1)


def sums_of_cells(cells: DataFrame, by: list[str], names: list[str], measure: Callable[[np.ndarray, np.ndarray, int], list[np.ndarray]]) -> DataFrame:
    """by and names: the sums of what measure(words, group, n) gives for rows of cells, as whole numbers for each of n groups.

    words[i, c] are the voxels of a row of cells at corner c = 2 * dz + dy: the cell at bit p has bit p at dx = 0 and bit p + 1 at dx = 1.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("x"), F.lit(WORD)).cast("int"))
    lines = cells.select(*by, *(F.col(n).cast("long").alias(n) for n in "zyx")).dropna(subset=["z", "y", "x"]).groupBy(*by, "z", "y", F.floor(F.col("x") / WORD).alias("w")).agg(F.bit_or(bit).alias("bits"))
    # a row belongs to its own block, and to those before it that it borders
    low = {"z": F.pmod(F.col("z"), F.lit(SIDE)) == 0, "y": F.pmod(F.col("y"), F.lit(SIDE)) == 0, "w": F.col("bits") % 2 != 0}
    before = lambda n: F.when(low[n], F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = lines
    for n in "zyw":
        rows = rows.withColumn(f"d{n}", F.explode(before(n)))
    last = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(WORD))
    block = [(F.floor(F.col(n) / SIDE) - F.col(f"d{n}")).alias(f"b{n}") for n in "zy"]
    rows = rows.select(*by, *block, (F.col("w") - F.col("dw")).alias("w"), "z", "y", F.when(F.col("dw") == 1, last).otherwise(F.col("bits")).alias("bits"))
    lists = rows.groupBy(*by, "bz", "by", "w").agg(F.collect_list(F.struct("z", "y", "bits")).alias("lines")).drop("w")  # SIDE * SIDE lines and a rim
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lists.select(*by).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.num_columns - 1)
            off, (z, y, bits) = own.offsets.to_numpy(), (own.values.field(n).to_numpy() for n in ("z", "y", "bits"))
            low_z, low_y = (batch.column(batch.num_columns - k).to_numpy() * SIDE for k in (3, 2))
            found = []
            for first, end in chunks(voxels_before(bits, off)):
                part = slice(off[first], off[end])
                group = np.repeat(np.arange(end - first), np.diff(off[first : end + 1]))
                iz, iy, word = z[part] - low_z[first:end][group], y[part] - low_y[first:end][group], bits[part].view(np.uint64)
                keys, corner, words = [], [], []
                for c in range(4):
                    cz, cy = iz - (c >> 1), iy - (c & 1)
                    kept = (cz >= 0) & (cz < SIDE) & (cy >= 0) & (cy < SIDE)
                    keys.append(((group * SIDE + cz) * SIDE + cy)[kept])
                    corner.append(np.full(len(keys[-1]), c))
                    words.append(word[kept])
                row, place = np.unique(np.concatenate(keys), return_inverse=True)
                table = np.zeros((len(row), 4), np.uint64)
                np.bitwise_or.at(table, (place, np.concatenate(corner)), np.concatenate(words))
                found.append(measure(table, row // (SIDE * SIDE), end - first))
            sums = [pa.array(np.concatenate(s).astype(np.int64)) if s else pa.array([], pa.int64()) for s in (zip(*found, strict=True) if found else [()] * len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(by)], *sums], names=[*by, *names])

    measured = lists.mapInArrow(run, ", ".join([*([fields] if by else []), *(f"{n} long" for n in names)]))
    return measured.groupBy(*by).agg(*(F.sum(n).alias(n) for n in names))


def euler(words: np.ndarray, group: np.ndarray, n: int) -> list[np.ndarray]:
    """Vertices - edges + faces - cubes of the closed voxels. A cell counts its middle and what leaves it upwards along the axes."""
    one = np.uint64(1)
    here = lambda w: np.bitwise_count(w >> one & _WHOLE).astype(np.int64)  # noqa: E731  dx = 1 only
    both = lambda w: np.bitwise_count((w | w >> one) & _WHOLE).astype(np.int64)
    a = words.T
    all_, up_y, up_z = a[0] | a[1] | a[2] | a[3], a[1] | a[3], a[2] | a[3]
    value = both(all_) - here(all_) - both(up_y) - both(up_z) + here(up_y) + here(up_z) + both(a[3]) - here(a[3])
    return [np.rint(np.bincount(group, value, n))]


_ROOTS, _PARTS = meshes.area_parts()
AREA_NAMES = [f"root{r}" for r in _ROOTS]


def area(words: np.ndarray, group: np.ndarray, n: int) -> list[np.ndarray]:
    """The surface as whole numbers of eighths of the square roots that areas of cells consist of."""
    one = np.uint64(1)
    some, every = np.bitwise_or.reduce(words, 1), np.bitwise_and.reduce(words, 1)
    row, bit = bits_set((some | some >> one) & ~(every & every >> one) & _WHOLE)  # cells of one kind have no surface
    at, mask = bit.astype(np.uint64), np.zeros(len(row), np.int64)
    for c in range(4):
        pair = (words[row, c] >> at).astype(np.int64)
        mask |= (pair & 1) << 2 * c | (pair >> 1 & 1) << 2 * c + 1
    kinds, place = np.unique(group[row] * 256 + mask, return_inverse=True)
    times = np.bincount(place, minlength=len(kinds))
    return [np.rint(np.bincount(kinds // 256, _PARTS[kinds % 256, k] * times, n)) for k in range(len(_ROOTS))]


def area_of(sums: DataFrame, by: list[str], scale: float) -> DataFrame:
    """by, surface_area_um2 from the sums of `area`; scale: square micrometres of a voxel's side."""
    total = sum((F.col(f"root{r}") * float(np.sqrt(r)) for r in _ROOTS), F.lit(0.0))
    return sums.select(*by, (total / 8 * scale).alias("surface_area_um2"))
