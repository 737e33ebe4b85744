"""Connected components of sparse voxel tables, in two levels.

Voxels are dealt into cubes of `side` voxels, 64 of a row as one long. Many cubes are labelled at once (numpy inside a task, bounded by
its cubes), each by itself. Only voxels on faces between cubes are then joined with their neighbours, and the few links between local
components are brought together by least labels and labels of labels, one stored table for each round. Local components are rows with
their voxels as a list until they have their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.functions.geometry import code, offsets
from voxelspark.sources.checkpoints import drop_stored, stored

_STRIDE = np.array([1 << 42, 1 << 21, 1], np.int64)
#: rows of lists that are taken at once hold about this many entries, or voxels in their bitmaps
CHUNK = 1 << 18
#: edges that one task takes in a round
EDGES = 1 << 14


def edge_components(edges: DataFrame) -> DataFrame:
    """id, label for every node of edges (a, b: long): the least id reachable. Each round is stored and never run again.

    A round has tasks by the number of its edges, as a few edges in as many tasks as the session has partitions take most of their time to begin.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    tasks = 1 + both.count() // EDGES
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")).coalesce(tasks))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["a"], "left").select("id", "label", F.least("label", "near").alias("next"))
        far = labels.select(F.col("id").alias("hop"), F.col("label").alias("hop_label"))
        jumped = step.join(far, step["next"] == far["hop"], "left").select("id", F.least("next", "hop_label").alias("label"), (F.least("next", "hop_label") != F.col("label")).alias("changed"))
        new = stored(jumped.coalesce(tasks))
        moved = new.where("changed").limit(1).count()
        drop_stored(labels)
        labels = new
        if not moved:
            drop_stored(both)
            return labels.select("id", "label")


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of rows whose lists, by their offsets, hold about CHUNK entries together; a longer list is taken by itself."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, end
        first = end


def voxels_before(bits: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many voxels the rows before each row hold, for lists of bitmaps: what a chunk takes grows with them, not with its bitmaps."""
    return np.concatenate(([0], np.cumsum(np.bitwise_count(bits.view(np.uint64)), dtype=np.int64)))[offsets]


def bits_set(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of the bits that are set in words of 64, the lowest first."""
    octets = np.ascontiguousarray(words).view(np.uint8)
    at = np.flatnonzero(octets)  # most are empty
    byte, bit = np.nonzero(np.unpackbits(octets[at, None], axis=1, bitorder="little"))
    place = at[byte]
    return place >> 3, (place & 7) * 8 + bit


def label_roots(codes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """For sorted distinct codes: the place of the least one of each one's component; neighbours differ by one of steps."""
    links = []
    for step in steps:
        at = np.minimum(np.searchsorted(codes, codes + step), max(len(codes) - 1, 0))
        hit = np.flatnonzero(codes[at] == codes + step)
        links.append(np.column_stack((hit, at[hit])))
    a, b = np.concatenate(links).T if links else (np.zeros(0, int), np.zeros(0, int))
    root = np.arange(len(codes))
    while True:
        while (root[root] != root).any():
            root = root[root]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        if not len(a):
            return root
        # the larger root of a link goes below the smaller one
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))


def connected_components(voxels: DataFrame, *, connectivity: int = 1, side: int = 64, label: str = "label") -> DataFrame:
    """z, y, x, label, component: the code of the component's first voxel in raster order, its seed. Label 0 is left out.

    A component never spans two labels. Rows with nulls are left out; repeated voxels count once.
    """
    near = offsets(connectivity, half=True)
    wide = side + 2  # a cube and a rim, so that no step leads from one cube to another
    steps = np.array([int(np.dot(d, (wide * wide, wide, 1))) for d in near], np.int64)
    cube, keys = [F.floor(F.col(n) / side).alias(f"c{n}") for n in "zyx"], ["label", "cz", "cy", "cx"]
    cells = voxels.select("z", "y", "x", F.col(label).alias("label")).dropna().where("label <> 0").select("z", "y", F.pmod(F.col("x"), F.lit(side)).alias("i"), "label", *cube)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("i") % 64).cast("int"))
    lines = cells.groupBy(*keys, "z", "y", F.floor(F.col("i") / 64).alias("w")).agg(F.bit_or(bit).alias("bits"))
    lists = lines.groupBy(*keys).agg(F.collect_list(F.struct(*(F.col(n).cast("long").alias(n) for n in ("z", "y", "w", "bits")))).alias("lines"))  # the lines of a cube
    kind = lists.schema["label"].dataType.simpleString()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, off = batch.column("lines"), batch.column("lines").offsets.to_numpy()
            z, y, w, bits = (held.values.field(n).to_numpy() for n in ("z", "y", "w", "bits"))
            corner = np.column_stack([batch.column(n).to_numpy() for n in keys[1:]]) * side
            for first, end in chunks(voxels_before(bits, off)):
                own = slice(off[first], off[end])
                group = np.repeat(np.arange(end - first), np.diff(off[first : end + 1]))
                row, i = bits_set(bits[own])
                g = group[row]
                at = np.column_stack((z[own][row], y[own][row], w[own][row] * 64 + i + corner[first:end][g, 2]))
                inner = at - corner[first:end][g] + 1
                place = ((g * wide + inner[:, 0]) * wide + inner[:, 1]) * wide + inner[:, 2]
                order = np.argsort(place)
                root = label_roots(place[order], steps)
                codes = (at[order] * _STRIDE).sum(1)
                # voxels by their component; in it and among components by raster order, cube after cube
                by = np.argsort(root, kind="stable")
                start = np.flatnonzero(np.diff(root[by], prepend=-1))
                labels = batch.column("label").take(pa.array(first + g[order][by][start]))
                voxel = pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in at[order][by].T], names=["z", "y", "x"])
                found = pa.ListArray.from_arrays(pa.array(np.append(start, len(by)), pa.int32()), voxel)
                yield pa.RecordBatch.from_arrays([labels, pa.array(codes[by][start]), found], names=["label", "local", "voxels"])

    parts = stored(lists.mapInArrow(local, f"label {kind}, local long, voxels array<struct<z: int, y: int, x: int>>"))
    cells = parts.select("label", "local", F.explode("voxels").alias("v")).select("label", "local", "v.z", "v.y", "v.x")
    # no voxel lies beyond the outermost ones, so only faces between cubes are asked
    ends = cells.agg(*(f(n).alias(f"{k}{n}") for k, f in (("lo", F.min), ("hi", F.max)) for n in "zyx")).first()
    if ends["loz"] is None:
        return cells.select("z", "y", "x", "label", F.col("local").alias("component"))
    inside = lambda n, d: F.floor((F.col(n) + d) / side) != F.floor(F.col(n) / side)  # noqa: E731  the step leaves the cube
    edge = F.lit(False)
    for n in "zyx":
        edge |= ((F.pmod(F.col(n), F.lit(side)) == 0) & (F.col(n) > ends[f"lo{n}"])) | ((F.pmod(F.col(n), F.lit(side)) == side - 1) & (F.col(n) < ends[f"hi{n}"]))
    faces = cells.where(edge).withColumn("code", code(F.col("z"), F.col("y"), F.col("x")))
    leave = [F.when(inside("z", d[0]) | inside("y", d[1]) | inside("x", d[2]), F.lit(int(np.dot(d, _STRIDE)))) for d in near]
    a = faces.select("label", F.col("local").alias("a"), "code", F.explode(F.array_compact(F.array(*leave))).alias("step")).select("label", "a", (F.col("code") + F.col("step")).alias("code"))
    links = a.join(faces.select("label", "code", F.col("local").alias("b")), ["label", "code"]).where("a <> b").select("label", "a", "b").distinct()
    # a seed's label is part of its identity only by its place, so local ids are distinct over all labels
    links = stored(links.select("a", "b"))
    if not links.limit(1).count():
        return cells.select("z", "y", "x", "label", F.col("local").alias("component"))
    merged = edge_components(links).select("id", F.col("label").alias("root"))
    named = parts.join(merged, parts["local"] == merged["id"], "left")
    return named.select("label", F.coalesce("root", "local").alias("component"), F.explode("voxels").alias("v")).select("v.z", "v.y", "v.x", "label", "component")
