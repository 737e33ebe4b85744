"""Convex hulls of bodies of any size: hulls of blocks of lines, merged as a hull of hulls, in exact whole numbers.

The hull of a body is that of the middles between its voxels and their six neighbours; coordinates are doubled, so all is whole.
Four steps, each a shuffle of bounded lists:

1. The lines of a body along x are reduced to their ends, and the lines of a block of `BLOCK` sections and rows to the hull of
   their ends.
2. The hulls of a body's blocks meet. A hull of lattice points within L voxels has no more than some L^1.5 corners, whatever lies
   inside. The hull of these is the hull of the body; its facets are half-spaces.
3. The sections of a body's box are dealt out again in slabs. In each row the half-spaces leave an interval of x: its length
   counts the voxels of the hull image, and its ends are reduced to their hull as in the first step.
4. The ends of all slabs meet, and the largest distance between their middles outwards is the Feret diameter.

A body in a plane has no hull image. It is measured by the corners of its voxels: their hull's largest distance and volume.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sections and rows of a block of lines, and rows of a slab of the hull image.
BLOCK, SLAB = (16, 64), 4096
_AXIS_STEPS = np.concatenate((np.eye(3, dtype=np.int64), -np.eye(3, dtype=np.int64)))
_CORNER_STEPS = np.array(list(product((-1, 1), repeat=3)), np.int64)


class Hull:
    """points (distinct), corners (their indices), triangles, normals and offsets: n . p <= offset inside."""

    def __init__(self, points: np.ndarray, triangles: list[tuple[int, int, int]], normals: list[tuple[int, int, int]], offsets: list[int]):
        self.points, self.triangles = points, np.array(triangles, np.int64)
        self.corners = points[np.unique(self.triangles)]
        # coplanar triangles share a plane
        gcd = np.gcd.reduce(np.column_stack((np.array(normals, np.int64), np.array(offsets, np.int64))), axis=1)
        self.planes = np.unique(np.column_stack((np.array(normals, np.int64), np.array(offsets, np.int64))) // gcd[:, None], axis=0)

    def volume(self) -> float:
        a, b, c = (self.points[self.triangles[:, k]] - self.points[0] for k in range(3))
        return float(np.einsum("ij,ij->i", a, np.cross(b, c)).sum()) / 6


def _first_four(pts: np.ndarray) -> list[int] | None:
    """Four points that are not in a plane, far apart; None if there are none."""
    a = 0
    b = int(((pts - pts[a]) ** 2).sum(1).argmax())
    off = np.cross(pts - pts[a], pts[b] - pts[a])
    c = int((off.astype(float) ** 2).sum(1).argmax())
    if not off[c].any():
        return None
    height = (pts - pts[a]) @ np.cross(pts[b] - pts[a], pts[c] - pts[a])
    d = int(np.abs(height).argmax())
    return [a, b, c, d] if height[d] else None


def convex_hull(points: np.ndarray) -> Hull | None:
    """The hull of whole-number points, None if they lie in a plane. Exact while the points span less than 5e5 steps.

    Every facet keeps the points above it that it was dealt, so a new point looks only at what the facets it replaces held.
    """
    pts = np.unique(np.asarray(points, np.int64).reshape(-1, 3), axis=0)
    origin = pts[0].copy() if len(pts) else 0
    pts = pts - origin
    first = _first_four(pts) if len(pts) > 3 else None
    if first is None:
        return None
    xyz = pts.tolist()
    facets: list[tuple[int, int, int]] = []
    normals: list[tuple[int, int, int]] = []
    offsets: list[int] = []
    near: list[list[int]] = []  # across the edges from corner 0, 1, 2
    above: list[tuple[np.ndarray, np.ndarray] | None] = []
    dead: list[bool] = []

    def add(a: int, b: int, c: int) -> int:
        (az, ay, ax), (bz, by, bx), (cz, cy, cx) = xyz[a], xyz[b], xyz[c]
        uz, uy, ux, vz, vy, vx = bz - az, by - ay, bx - ax, cz - az, cy - ay, cx - ax
        n = (uy * vx - ux * vy, ux * vz - uz * vx, uz * vy - uy * vz)
        facets.append((a, b, c))
        normals.append(n)
        offsets.append(n[0] * az + n[1] * ay + n[2] * ax)
        near.append([-1, -1, -1])
        above.append(None)
        dead.append(False)
        return len(facets) - 1

    def deal(new: list[int], which: np.ndarray) -> None:
        """Give each of these points to the facet that it is highest above."""
        if not len(which):
            return
        heights = pts[which] @ np.array([normals[f] for f in new], np.int64).T - np.array([offsets[f] for f in new], np.int64)
        best = heights.argmax(1)
        high = heights[np.arange(len(which)), best]
        for k in np.unique(best[high > 0]).tolist():
            own = (best == k) & (high > 0)
            above[new[k]] = which[own], high[own]

    a, b, c, d = first
    for f in ((a, b, c, d), (a, b, d, c), (a, c, d, b), (b, c, d, a)):
        k = add(*f[:3])
        n, other = normals[k], xyz[f[3]]
        if n[0] * other[0] + n[1] * other[1] + n[2] * other[2] > offsets[k]:  # turn it outwards
            facets[k], normals[k], offsets[k] = (f[1], f[0], f[2]), (-n[0], -n[1], -n[2]), -offsets[k]
    edge_of = {(facets[k][i], facets[k][(i + 1) % 3]): k for k in range(4) for i in range(3)}
    for k in range(4):
        near[k] = [edge_of[facets[k][(i + 1) % 3], facets[k][i]] for i in range(3)]
    deal([0, 1, 2, 3], np.setdiff1d(np.arange(len(pts)), first))
    todo = [0, 1, 2, 3]
    while todo:
        start = todo.pop()
        if dead[start] or above[start] is None:
            continue
        which, high = above[start]
        p = int(which[high.argmax()])
        pz, py, px = xyz[p]
        seen, stack, horizon = {start}, [start], []
        while stack:
            k = stack.pop()
            for i, other in enumerate(near[k]):
                if other in seen:
                    continue
                n = normals[other]
                if n[0] * pz + n[1] * py + n[2] * px > offsets[other]:
                    seen.add(other)
                    stack.append(other)
                else:
                    horizon.append((facets[k][i], facets[k][(i + 1) % 3], other))
        new, begins = [], {}
        for u, v, other in horizon:
            k = add(u, v, p)
            near[k][0] = other
            at = facets[other]
            near[other][at.index(v)] = k  # there the edge runs from v to u
            begins[u] = k
            new.append(k)
        for k in new:
            follower = begins[facets[k][1]]
            near[k][1], near[follower][2] = follower, k
        held = [above[k][0] for k in seen if above[k] is not None]
        for k in seen:
            dead[k], above[k] = True, None
        which = np.concatenate(held)
        deal(new, which[which != p])
        todo += new
    kept = [k for k in range(len(facets)) if not dead[k]]
    o = [int(x) for x in origin]
    return Hull(pts + origin, [facets[k] for k in kept], [normals[k] for k in kept], [offsets[k] + sum(x * y for x, y in zip(normals[k], o, strict=True)) for k in kept])


def extreme(points: np.ndarray) -> np.ndarray:
    """The points whose hull is that of all; in a plane, the ends of their rows along each axis of two."""
    pts = np.unique(points, axis=0)
    if len(pts) < 16:
        return pts
    hull = convex_hull(pts)
    if hull is not None:
        return hull.corners
    for axes in ((0, 1), (0, 2), (1, 2)):  # an end of a line is an end in every direction
        order = np.lexsort((*(pts[:, a] for a in {0, 1, 2} - {*axes}), pts[:, axes[1]], pts[:, axes[0]]))
        rows = pts[order][:, axes]
        change = np.any(rows[1:] != rows[:-1], axis=1)
        ends = np.concatenate(([True], change)) | np.concatenate((change, [True]))
        pts = pts[order][ends]
    return pts


def rows_inside(planes: np.ndarray, z: np.ndarray, y: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) x of the voxels of each row (z, y) within half-spaces over doubled coordinates; last < first for none."""
    first, last = np.full(len(z), low, np.int64), np.full(len(z), high, np.int64)
    for nz, ny, nx, d in planes.tolist():
        room = d - 2 * (nz * z + ny * y)
        if nx > 0:
            np.minimum(last, room // (2 * nx), out=last)
        elif nx < 0:
            np.maximum(first, -(room // (-2 * nx)), out=first)
        else:
            last[room < 0] = low - 1
    return first, last


def widest(points: np.ndarray) -> float:
    """The largest distance of two points, in blocks."""
    best = 0
    for i in range(0, len(points), 512):
        best = max(best, int(((points[i : i + 512, None] - points[None]) ** 2).sum(2).max()))
    return best**0.5


def flat_shape(points: np.ndarray, n_voxels: int) -> tuple[float, float]:
    """(Feret diameter, solidity) of voxels in a plane, in voxels, by their corners."""
    hull = convex_hull((2 * points[:, None] + _CORNER_STEPS).reshape(-1, 3))
    return widest(hull.corners) / 2, n_voxels / (hull.volume() / 8)


def _lists(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """Each row's list of z, y, x, z, ... as an array of points."""
    column = batch.column(name)
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for i in range(len(column)):
        yield flat[at[i] : at[i + 1]].astype(np.int64).reshape(-1, 3)


def _flat(points: np.ndarray) -> list[int]:
    return points.reshape(-1).tolist()


def _block_hulls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [_flat(extreme(p)) for p in _lists(batch, "ends")]
        yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("n"), pa.array(ends, pa.list_(pa.int32()))], names=["component", "n", "ends"])


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The half-spaces of each body once for every slab of its box; a body in a plane is measured at once."""
    names, kinds = ["component", "n", "feret", "solidity", "planes", "z0", "z1", "y0", "y1", "low", "high"], [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), *[pa.int32()] * 6]
    for batch in batches:
        rows = []
        for component, n, points in zip(batch.column("component").to_pylist(), batch.column("n").to_pylist(), _lists(batch, "ends"), strict=True):
            points = np.unique(points, axis=0)
            body = convex_hull(points)
            if body is None:
                rows.append((component, n, *flat_shape(points, n), None, 0, 0, 0, 0, 0, 0))
                continue
            hull = convex_hull((2 * body.corners[:, None] + _AXIS_STEPS).reshape(-1, 3))
            (z0, y0, x0), (z1, y1, x1) = points.min(0).tolist(), points.max(0).tolist()
            step = max(1, SLAB // (y1 - y0 + 1))
            data = hull.planes.astype("<i8").tobytes()
            rows += [(component, n, None, None, data, z, min(z + step, z1 + 1), y0, y1 + 1, x0, x1) for z in range(z0, z1 + 1, step)]
            if sum(len(r[4] or b"") for r in rows) > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many voxels of the hull image a slab has, and the hull of its rows' ends."""
    for batch in batches:
        inside, ends = [], []
        for r in batch.select(["planes", "z0", "z1", "y0", "y1", "low", "high"]).to_pylist():
            if r["planes"] is None:
                inside.append(None)
                ends.append([])
                continue
            z, y = (a.reshape(-1) for a in np.meshgrid(np.arange(r["z0"], r["z1"]), np.arange(r["y0"], r["y1"]), indexing="ij"))
            first, last = rows_inside(np.frombuffer(r["planes"], "<i8").reshape(-1, 4), z, y, r["low"], r["high"])
            has = last >= first
            inside.append(int((last - first + 1)[has].sum()))
            both = np.concatenate([np.column_stack((z[has], y[has], x[has])) for x in (first, last)])
            ends.append(_flat(extreme(both)) if len(both) else [])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("component", "n", "feret", "solidity")), pa.array(inside, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], names=["component", "n", "feret", "solidity", "inside", "ends"])


def _diameters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        feret, solid = [], []
        rows = batch.select(["n", "feret", "solidity", "inside"]).to_pylist()
        for r, points in zip(rows, _lists(batch, "ends"), strict=True):
            if r["feret"] is None:
                middles = (2 * extreme(points)[:, None] + _AXIS_STEPS).reshape(-1, 3)
                r |= {"feret": widest(extreme(middles)) / 2, "solidity": r["n"] / r["inside"]}
            feret.append(r["feret"])
            solid.append(r["solidity"])
        yield pa.RecordBatch.from_arrays([batch.column("component"), pa.array(feret, pa.float64()), pa.array(solid, pa.float64())], names=["component", "feret", "solidity"])


def hull_shapes(components: DataFrame, *, voxel_um: float) -> DataFrame:
    """component, feret_diameter_max_um, solidity of the bodies (component, z, y, x) of distinct voxels."""
    lines = components.groupBy("component", "z", "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    place = [F.floor(F.col(a) / size) for a, size in zip(("z", "y"), BLOCK, strict=True)]
    both = F.array(*(F.col(c).cast("int") for c in ("z", "y", "lo", "z", "y", "hi")))
    blocks = lines.groupBy("component", *(p.alias(f"b{i}") for i, p in enumerate(place))).agg(F.sum("n").alias("n"), F.flatten(F.collect_list(both)).alias("ends"))  # BLOCK lines
    hulls = blocks.select(F.col("component").cast("long").alias("component"), "n", "ends").mapInArrow(_block_hulls, "component long, n long, ends array<int>")
    bodies = hulls.groupBy("component").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("ends")).alias("ends"))  # corners of hulls
    slabs = bodies.mapInArrow(_slabs, "component long, n long, feret double, solidity double, planes binary, z0 int, z1 int, y0 int, y1 int, low int, high int")
    images = slabs.repartition("component", "z0").mapInArrow(_images, "component long, n long, feret double, solidity double, inside long, ends array<int>")
    whole = images.groupBy("component").agg(F.max("n").alias("n"), F.max("feret").alias("feret"), F.max("solidity").alias("solidity"), F.sum("inside").alias("inside"), F.flatten(F.collect_list("ends")).alias("ends"))  # corners again
    found = whole.mapInArrow(_diameters, "component long, feret double, solidity double")
    return found.select("component", (F.col("feret") * voxel_um).alias("feret_diameter_max_um"), "solidity")
