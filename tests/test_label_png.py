"""Label maps as PNG files: every filter of rows, files of others, restart points, and a volume built from a folder of them."""

import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.sources import label_png as png


def filtered(values, kinds):
    """Rows as an encoder writes them, value by value."""
    out, above = bytearray(), [0] * values.shape[1]
    for row, kind in zip(values.astype(int).tolist(), kinds, strict=True):
        out.append(kind)
        for x, v in enumerate(row):
            a, b, c = (row[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            p = a + b - c
            paeth = min(((abs(p - q), k, q) for k, q in enumerate((a, b, c))))[2]
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        above = row
    return bytes(out)


def foreign(values, kinds, pieces=3):
    data = zlib.compress(filtered(values, kinds))
    cut = [len(data) * k // pieces for k in range(pieces + 1)]
    head = struct.pack(">IIBBBBB", values.shape[1], values.shape[0], 8, 0, 0, 0, 0)
    return png.SIGNATURE + png.chunk(b"IHDR", head) + png.chunk(b"tEXt", b"a\0b") + b"".join(png.chunk(b"IDAT", data[a:b]) for a, b in zip(cut, cut[1:], strict=False)) + png.chunk(b"IEND", b"")


def whole(data):
    f = io.BytesIO(data)
    return np.concatenate([v for _, v in png.read_bands(f, png.read_header(f))])


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4]])
def test_all_filters(kinds, monkeypatch):
    monkeypatch.setattr(png, "BAND", 7)
    r = np.random.default_rng(1)
    for shape in ((23, 17), (1, 40), (40, 1), (7, 7)):
        values = r.integers(0, 256, shape).astype(np.uint8)
        assert (whole(foreign(values, [kinds[k % len(kinds)] for k in range(shape[0])])) == values).all()


def test_own_bands_take_whole_rows(monkeypatch):
    """A map of single pixels is painted and read by rows, not pixel by pixel or along the diagonals."""
    values = np.random.default_rng(3).integers(0, 5, (256, 192))
    y, x = np.indices(values.shape).reshape(2, -1)
    assert (png.painted(np.column_stack((y + 512, x, x, values.ravel())), 512, 256, 1000, 192) == values).all()
    assert png.painted(np.array([[0, 0, 3, 7], [0, 2, 5, 9]]), 0, 1, 1, 7).tolist() == [[7, 7, 9, 9, 9, 9, 0]]
    assert not png.painted(np.zeros((0, 4), int), 0, 2, 2, 3).any()
    with pytest.raises(ValueError, match="does not fit"):
        png.painted(np.array([[0, 0, 7, 1]]), 0, 1, 1, 7)
    rows = np.frombuffer(filtered(values, [1] + [2] * 255), np.uint8).reshape(256, 193)
    monkeypatch.setattr(png.np, "stack", lambda *a: pytest.fail("diagonals"))
    assert (png.unfilter(rows, np.zeros(192, np.uint8)) == values).all()


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="not a PNG"):
        whole(b"GIF89a..")
    with pytest.raises(ValueError, match="ends at row"):
        data = foreign(np.zeros((300, 4), np.uint8), [0] * 300)
        whole(data.replace(struct.pack(">II", 4, 300), struct.pack(">II", 4, 900)))
    with pytest.raises(ValueError, match="one byte"):
        whole(png.SIGNATURE + png.chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 4, 16, 0, 0, 0, 0)))


def test_round_trip_by_bands(spark, tmp_path):
    r = np.random.default_rng(2)
    maps = {3: r.integers(0, 5, (70, 90)), 12: np.zeros((40, 30), int), 4: np.kron(r.integers(0, 250, (5, 4)), np.ones((9, 8), int))}
    rows = [(k, int(y), int(x), int(v[y, x])) for k, v in maps.items() for y, x in np.argwhere(v)]
    pixels = spark.createDataFrame(rows, "section_index int, y int, x int, label int")
    sizes = spark.createDataFrame([(k, *v.shape) for k, v in maps.items()], "section_index int, height int, width int")
    path = str(tmp_path / "maps")
    png.write_runs(png.pixel_runs(pixels), sizes, path, band=16)
    files = {p.name: p.read_bytes() for p in (tmp_path / "maps").iterdir()}
    assert set(files) == {"0003_labels.png", "0004_labels.png", "0012_labels.png"}
    for k, v in maps.items():  # as any reader sees them, checksum included
        data = files[png.file_name(k)]
        assert (whole(data) == v).all()
        idat, at = b"", 8
        while at < len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            idat += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
            at += 12 + n
        assert len(zlib.decompress(idat)) == v.shape[0] * (v.shape[1] + 1)
        f = io.BytesIO(data)
        header = png.read_header(f)
        assert len(header.starts) == -(-v.shape[0] // 16)
        for b in range(1, len(header.starts)):
            (y0, band), *_ = png.read_bands(f, header, b, b + 1)
            assert y0 == 16 * b and (band == v[y0 : y0 + 16]).all()
    back = png.pixels_of(png.read_runs(spark, path))
    assert sorted(tuple(x) for x in back.collect()) == sorted(rows)
    with pytest.raises(Exception, match="does not fit"):
        png.write_runs(spark.createDataFrame([(3, 1, 80, 95, 1)], png.RUNS), sizes, path, band=16)


def test_volume_from_a_folder_of_label_maps(spark, tmp_path):
    from voxelspark.operators import volume
    from voxelspark.sources import manifest, sinks

    folder = str(tmp_path / "run")
    values = {k: np.full((40, 40), k % 5, np.uint8) for k in range(4)}
    (tmp_path / "run" / "label_maps").mkdir(parents=True)
    for k, v in values.items():
        (tmp_path / "run" / "label_maps" / png.file_name(k)).write_bytes(foreign(v, [k % 5] * 40))
    listed = spark.createDataFrame([(k, f"s{k}.tif", f"/d/s{k}.tif") for k in range(4)], "section_index int, filename string, path string")
    manifest.write_manifest(listed, f"{folder}/manifest")
    sinks.write_metadata(spark, folder, manifest_csv=f"{folder}/manifest", seg_mpp=8.0, registration_mpp=8.0)
    built = volume.build_from_run(spark, folder, size=(40, 40), target_um=8.0, with_nuclei=False)
    got = {tuple(x) for x in built.voxels.groupBy("z", "label").agg(F.count("*").alias("n")).collect()}
    assert got == {(k, k, 1600) for k in (1, 2, 3)}
    (tmp_path / "run" / "label_maps" / png.file_name(2)).unlink()
    with pytest.raises(ValueError, match=r"1 sections have no labels .*\[2\]"):
        volume.build_from_run(spark, folder, size=(40, 40), target_um=8.0, with_nuclei=False)
