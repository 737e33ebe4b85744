"""Label maps as PNG files, one for each section (`0007_labels.png`), read and written as a Spark data source.

Rows are runs (section_index, y, x0, x1, label), both ends included; label 0 is left out. A file is read as a stream, a band of rows at a
time, so no map is ever whole in memory; the row filters of PNG are undone for a whole band at once, along its diagonals. Files that this
module wrote have restart points: every band is compressed by itself, and a chunk of the file lists where the bands start and that
their first rows need no row above. Such a file is read by many tasks, a run of bands each; any other one by a single task.

To write, the runs of a section are dealt to bands, each band is compressed where it is, and a task puts the bands of a file together;
files appear under their name once they are whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Rows of a band, and bands of a task.
BAND, BANDS_PER_TASK = 256, 16
#: The private, ancillary chunk with the restart points.
RESTARTS = b"vxRs"
RUNS = "section_index int, y int, x0 int, x1 int, label int"
_NAME = "{:04d}_labels.png"


def file_name(section: int) -> str:
    return _NAME.format(section)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def unfilter(rows: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The gray values of filtered rows (a filter byte, then the row), below the row `above`.

    A value depends on those to its left, above, and above left. All values of one diagonal depend on earlier diagonals only, so a
    band is done in as many steps as it has diagonals, whatever filters its rows have.
    """
    kinds, data = rows[:, 0], rows[:, 1:]
    height, width = data.shape
    if not kinds.any():
        return data
    if (kinds <= 1).all():
        return np.where(kinds[:, None] == 1, np.cumsum(data, axis=1, dtype=np.uint8), data)
    if (kinds <= 2).all():  # whole rows, one after another
        out = np.empty(data.shape, np.uint8)
        for i in range(height):
            if kinds[i] == 1:
                np.cumsum(data[i], dtype=np.uint8, out=out[i])
            else:
                out[i] = data[i] + above if kinds[i] else data[i]
            above = out[i]
        return out
    # skewed: column t of row i holds the value at t - i, so a diagonal is a column; stored by column
    out = np.zeros((width + height + 1, height + 1), np.int16)  # out[x + i + 1, i + 1]: row i, place x
    out[np.arange(width), 0] = above
    source = np.zeros((width + height, height), np.int16)
    at = np.arange(height)
    for i in range(height):
        source[i : i + width, i] = data[i]
    is_sub, is_up, is_mean, is_paeth = (kinds == k for k in (1, 2, 3, 4))
    for t in range(width + height - 1):
        lo, hi = max(0, t - width + 1), min(height, t + 1)
        own = at[lo:hi]
        x = t - own
        left = np.where(x > 0, out[t, own + 1], 0)
        up = out[t, own]
        corner = np.where(x > 0, out[t - 1, own] if t else 0, 0)
        guess = left + up - corner
        da, db, dc = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
        paeth = np.where((da <= db) & (da <= dc), left, np.where(db <= dc, up, corner))
        add = np.where(is_paeth[own], paeth, np.where(is_mean[own], (left + up) >> 1, np.where(is_up[own], up, np.where(is_sub[own], left, 0))))
        out[t + 1, own + 1] = (source[t, own] + add) & 255
    return np.stack([out[i + 1 : i + 1 + width, i + 1] for i in range(height)]).astype(np.uint8)


def runs_of(band: np.ndarray, y0: int) -> np.ndarray:
    """(y, first x, last x, label) of the runs of a band."""
    width = band.shape[1]
    flat = band.reshape(-1)
    start = np.ones(len(flat), bool)
    start[1:] = flat[1:] != flat[:-1]
    start[::width] = True
    first = np.flatnonzero(start)
    last = np.append(first[1:], len(flat)) - 1
    keep = flat[first] != 0
    first, last = first[keep], last[keep]
    return np.column_stack((first // width + y0, first % width, last % width, flat[first].astype(np.int64)))


@dataclass
class Header:
    width: int
    height: int
    band: int = 0
    starts: tuple[int, ...] = ()  # bytes of the compressed stream before each band, its two leading bytes included
    idat: int = 0  # where the only data chunk begins in the file


def read_header(f) -> Header:
    """Size and restart points of an open file."""
    if f.read(8) != SIGNATURE:
        raise ValueError("not a PNG file")
    header = None
    while True:
        length, kind = struct.unpack(">I4s", f.read(8))
        if kind == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", f.read(length))
            if (depth, interlaced) != (8, 0) or colour not in (0, 3):
                raise ValueError(f"label maps have one byte for each pixel and are not interlaced, not depth {depth}, colour type {colour}, interlacing {interlaced}")
            header = Header(width, height)
        elif kind == RESTARTS:
            data = f.read(length)
            header.band, header.starts = struct.unpack(">I", data[:4])[0], struct.unpack(f">{(length - 4) // 8}Q", data[4:])
        elif kind == b"IDAT":
            header.idat = f.tell()
            return header
        else:
            f.seek(f.tell() + length)
        f.seek(f.tell() + 4)


def _compressed(f, header: Header, first: int) -> Iterator[bytes]:
    """The compressed stream from a band on (0: from its start), chunk by chunk."""
    f.seek(header.idat - 8)
    skip = header.starts[first] if first else 0
    while True:
        length, kind = struct.unpack(">I4s", f.read(8))
        if kind == b"IDAT":
            if skip < length:
                f.seek(f.tell() + skip)
                left, skip = length - skip, 0
                while left:
                    data = f.read(min(left, 1 << 20))
                    left -= len(data)
                    yield data
            else:
                f.seek(f.tell() + length)
                skip -= length
        elif kind == b"IEND":
            return
        else:
            f.seek(f.tell() + length)
        f.seek(f.tell() + 4)


def read_bands(f, header: Header, first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, values) of the bands first to last - 1 of an open file; first is 0 without restart points."""
    band, line = header.band or BAND, header.width + 1
    n = -(-header.height // band)
    last = n if last is None else min(last, n)
    inflate = zlib.decompressobj(-15 if first else 15)
    held, at, above = bytearray(), first, np.zeros(header.width, np.uint8)
    for data in _compressed(f, header, first):
        while data:
            held += inflate.decompress(data, 1 << 20)
            data = inflate.unconsumed_tail
            while at < last and len(held) >= (rows := min(band, header.height - at * band)) * line:
                flat = np.frombuffer(bytes(held[: rows * line]), np.uint8).reshape(rows, line)
                del held[: rows * line]
                values = unfilter(flat, above)
                above = values[-1]
                yield at * band, values
                at += 1
            if at == last:
                return
    raise ValueError(f"the file ends at row {at * band} of {header.height}")


def painted(runs: np.ndarray, y0: int, rows: int, height: int, width: int) -> np.ndarray:
    """The values of `rows` rows from y0 on that (y, x0, x1, label) runs give; of runs on one place the last one counts."""
    y, x0, x1, label = runs.astype(np.int64).T
    bad = np.flatnonzero((x0 < 0) | (x0 > x1) | (x1 >= width) | (y < y0) | (y >= y0 + rows) | (label < 0) | (label > 255))
    if len(bad):
        k = bad[0]
        raise ValueError(f"run ({y[k]}, {x0[k]} to {x1[k]}, label {label[k]}) does not fit a map of {height} x {width}")
    values = np.zeros(rows * width, np.uint8)
    size = x1 - x0 + 1
    first = (y - y0) * width + x0
    values[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())] = np.repeat(label, size)
    return values.reshape(rows, width)


def compress_band(values: np.ndarray) -> bytes:
    """A raw deflate piece that starts anew: rows are differences to the row above, the first one to its left."""
    rows = np.empty((values.shape[0], values.shape[1] + 1), np.uint8)
    rows[:, 0], rows[0, 0] = 2, 1
    rows[1:, 1:] = values[1:] - values[:-1]
    rows[0, 1:] = np.diff(values[0], prepend=np.uint8(0))
    data = zlib.compressobj(6, zlib.DEFLATED, -15)
    return struct.pack(">I", zlib.adler32(rows)) + data.compress(rows.tobytes()) + data.flush(zlib.Z_FULL_FLUSH)


def adler_of(first: int, second: int, length: int) -> int:
    """The Adler checksum of two texts, one after the other, from their own and the second one's length."""
    base = 65521
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    a = (a1 + a2 - 1) % base
    b = (b1 + b2 + (length % base) * (a1 - 1)) % base
    return b << 16 | a


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class _Bands(InputPartition):
    file: str
    section: int
    first: int
    last: int | None


@dataclass
class _Files(WriterCommitMessage):
    names: list[tuple[str, str]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[_Bands]:
        from pyarrow import fs

        store, root = _folder(self.path)
        out = []
        for info in store.get_file_info(fs.FileSelector(root)):  # one for each section
            number = info.base_name.removesuffix("_labels.png")
            if info.base_name.endswith("_labels.png") and number.isdigit():
                with store.open_input_file(info.path) as f:
                    header = read_header(f)
                n = len(header.starts)
                out += [_Bands(info.path, int(number), a, min(a + BANDS_PER_TASK, n)) for a in range(0, n, BANDS_PER_TASK)] or [_Bands(info.path, int(number), 0, None)]
        return out or [_Bands("", 0, 0, 0)]

    def read(self, part: _Bands) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        store, _ = _folder(self.path)
        with store.open_input_file(part.file) as f:
            header = read_header(f)
            for y0, values in read_bands(f, header, part.first, part.last):
                runs = runs_of(values, y0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), part.section), pa.int32()), *(pa.array(runs[:, k], pa.int32()) for k in range(4))], names=["section_index", "y", "x0", "x1", "label"])


class _Writer(DataSourceArrowWriter):
    """Takes (section_index, height, width, band, data), a section's bands together and in order."""

    def __init__(self, options: dict):
        self.path, self.band = options["path"], int(options["band"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Files:
        store, root = _folder(self.path)
        store.create_dir(root, recursive=True)
        names, held, section = [], [], None
        for batch in iterator:
            for k in range(batch.num_rows):
                row = [batch.column(c)[k].as_py() for c in range(5)]
                if row[0] != section and held:
                    names.append(self._file(store, root, held))
                    held = []
                section = row[0]
                held.append(row)
        if held:
            names.append(self._file(store, root, held))
        return _Files(names)

    def _file(self, store, root: str, rows: list[list]) -> tuple[str, str]:
        section, height, width = rows[0][:3]
        starts, at, total = [], 2, 1
        for r in rows:  # compressed bands
            starts.append(at)
            at += len(r[4]) - 4
            total = adler_of(total, struct.unpack(">I", r[4][:4])[0], min(self.band, height - r[3] * self.band) * (width + 1))
        name = f"{root}/{file_name(section)}"
        fresh = f"{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(fresh) as f:
            f.write(SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)))
            f.write(chunk(RESTARTS, struct.pack(f">I{len(starts)}Q", self.band, *starts)))
            for i, r in enumerate(rows):
                tail = b"\x03\x00" + struct.pack(">I", total) if i + 1 == len(rows) else b""
                f.write(chunk(b"IDAT", (b"\x78\x9c" if not i else b"") + r[4][4:] + tail))
            f.write(chunk(b"IEND", b""))
        return fresh, name

    def commit(self, messages: list[_Files | None]) -> None:
        store, _ = _folder(self.path)
        for m in messages:
            for fresh, name in m.names if m else ():
                store.move(fresh, name)

    def abort(self, messages: list[_Files | None]) -> None:
        store, _ = _folder(self.path)
        for m in messages:
            for fresh, _ in m.names if m else ():
                store.delete_file(fresh)


class LabelPng(DataSource):
    @classmethod
    def name(cls) -> str:
        return "label_png"

    def schema(self) -> str:
        return RUNS

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The runs of all label maps in a folder."""
    spark.dataSource.register(LabelPng)
    return spark.read.format("label_png").load(path)


def sections_in(spark: SparkSession, path: str) -> DataFrame:
    """section_index of the label maps in a folder; none if there is no folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []  # one for each section
    found = [n.removesuffix("_labels.png") for n in names if n.endswith("_labels.png")]
    return spark.createDataFrame([(int(n),) for n in found if n.isdigit()], "section_index int")


def pixels_of(runs: DataFrame) -> DataFrame:
    """section_index, y, x, label of the pixels of runs."""
    return runs.select("section_index", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def pixel_runs(pixels: DataFrame) -> DataFrame:
    """Runs of length one: what write_runs takes where there are only pixels (section_index, y, x, label)."""
    return pixels.select("section_index", "y", F.col("x").alias("x0"), F.col("x").alias("x1"), "label")


def write_runs(runs: DataFrame, sizes: DataFrame, path: str, *, band: int = BAND) -> None:
    """One file for each section of sizes (section_index, height, width); labels 0 to 255, runs must lie within their section."""
    runs.sparkSession.dataSource.register(LabelPng)
    number = F.floor(F.col("y") / band).cast("int")
    listed = runs.where("label <> 0").groupBy("section_index", number.alias("band")).agg(F.flatten(F.collect_list(F.array(*(F.col(c).cast("int") for c in ("y", "x0", "x1", "label"))))).alias("runs"))  # a band's runs
    wanted = sizes.select("section_index", "height", "width", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / band).cast("int"))).alias("band"))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                section, height, width, b = (batch.column(c)[k].as_py() for c in range(4))
                own = batch.column(4)[k].values
                own = own.to_numpy(zero_copy_only=False).reshape(-1, 4) if own is not None else np.zeros((0, 4), np.int32)
                data = compress_band(painted(own, b * band, min(band, height - b * band), height, width))
                yield pa.RecordBatch.from_arrays([pa.array([section], pa.int32()), pa.array([height], pa.int32()), pa.array([width], pa.int32()), pa.array([b], pa.int32()), pa.array([data], pa.binary())], names=["section_index", "height", "width", "band", "data"])

    whole = wanted.select(*(F.col(c).cast("int").alias(c) for c in wanted.columns)).join(listed, ["section_index", "band"], "left").select("section_index", "height", "width", "band", "runs")
    bands = whole.mapInArrow(compress, "section_index int, height int, width int, band int, data binary")
    bands.repartition("section_index").sortWithinPartitions("section_index", "band").write.format("label_png").option("band", band).mode("append").save(path)
