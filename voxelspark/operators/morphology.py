"""Binary morphology on rows of bitmaps: 64 pixels of a row are a long, and all is shifts, ands and ors in the JVM.

The structuring element is the diamond that `n` steps of a cross of four neighbours make. It is taken row by row: in a row at the
distance d it spans 2 * (n - d) + 1 pixels. What lies outside the pixels given is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEYS = ["section_index", "y", "word"]


def _left(bits: Column, n: int) -> Column:
    return F.call_function("shiftleft", bits, F.lit(n))


def _right(bits: Column, n: int) -> Column:
    return F.call_function("shiftrightunsigned", bits, F.lit(n))


def bit_rows(pixels: DataFrame) -> DataFrame:
    """section_index, y, word, bits of pixels (section_index, y, x)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("x"), F.lit(64)).cast("int"))
    return pixels.groupBy("section_index", "y", F.floor(F.col("x") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))


def pixels_of(rows: DataFrame) -> DataFrame:
    """section_index, y, x of the bits that are set."""
    each = rows.select(*_KEYS, "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k"))
    return each.where(F.call_function("getbit", F.col("bits"), F.col("k")) == 1).select("section_index", "y", (F.col("word") * 64 + F.col("k")).cast("int").alias("x"))


def _beside(rows: DataFrame) -> DataFrame:
    """rows with `before` and `behind`: the words beside each in its row, 0 where there is none."""
    line = Window.partitionBy("section_index", "y").orderBy("word")  # the words of one row
    get = lambda f, step: F.coalesce(F.when(f("word").over(line) == F.col("word") + step, f("bits").over(line)), F.lit(0).cast("long"))
    return rows.withColumns({"before": get(F.lag, -1), "behind": get(F.lead, 1)})


def erode(rows: DataFrame, n: int = 1) -> DataFrame:
    """The pixels whose whole diamond is set."""
    bits, before, behind = F.col("bits"), F.col("before"), F.col("behind")
    whole = [bits]
    for k in range(1, n + 1):
        shifted = [_left(bits, k).bitwiseOR(_right(before, 64 - k)), _right(bits, k).bitwiseOR(_left(behind, 64 - k))]
        whole.append(whole[-1].bitwiseAND(shifted[0]).bitwiseAND(shifted[1]))
    given = F.array(*(F.struct(F.lit(d).alias("d"), whole[n - abs(d)].alias("bits")) for d in range(-n, n + 1)))
    moved = _beside(rows).select(*_KEYS, F.explode(given).alias("g")).select("section_index", (F.col("y") + F.col("g.d")).alias("y"), "word", F.col("g.bits").alias("bits"))
    met = moved.groupBy(*_KEYS).agg(F.bit_and("bits").alias("bits"), F.count("*").alias("n"))
    return met.where((F.col("n") == 2 * n + 1) & (F.col("bits") != 0)).drop("n")


def dilate(rows: DataFrame, n: int = 1) -> DataFrame:
    """The pixels of all diamonds around set ones, beyond the frame as well."""
    bits = F.col("bits")
    given = []
    for d in range(-n, n + 1):
        own, before, behind = bits, F.lit(0).cast("long"), F.lit(0).cast("long")
        for k in range(1, n - abs(d) + 1):
            own = own.bitwiseOR(_left(bits, k)).bitwiseOR(_right(bits, k))
            before, behind = before.bitwiseOR(_left(bits, 64 - k)), behind.bitwiseOR(_right(bits, 64 - k))
        given += [F.struct(F.lit(d).alias("d"), F.lit(step).alias("w"), b.alias("bits")) for step, b in ((0, own), (-1, before), (1, behind))]
    moved = rows.select(*_KEYS, F.explode(F.array(*given)).alias("g")).where("g.bits <> 0")
    return moved.select("section_index", (F.col("y") + F.col("g.d")).alias("y"), (F.col("word") + F.col("g.w")).alias("word"), F.col("g.bits").alias("bits")).groupBy(*_KEYS).agg(F.bit_or("bits").alias("bits"))


def opening(pixels: DataFrame, n: int = 2) -> DataFrame:
    """section_index, y, x of the pixels that a diamond of n steps can cover without leaving them: specks go."""
    return pixels_of(dilate(erode(bit_rows(pixels.select("section_index", "y", "x")), n), n))
