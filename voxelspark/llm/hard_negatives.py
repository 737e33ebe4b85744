"""Hard negatives by exact inner product: clusters of anchors share candidate lists sorted by an angular upper bound.

Anchors are clustered by angle. For a cluster whose members lie within an angle b of its centroid, a candidate x at the angle t from
there scores at most |anchor| * |x| * cos(max(0, t - b)) with any member: that is the order of the cluster's list, and it is the
same for all members. A member walks the list from the top and stops, certified, once the bound of what is left is below
every score that could still enter its result.

The lists are walked in segments. One pass counts each cluster's bounds in bins, which gives thresholds behind the first `first`
candidates, `growth` times as many, and so on. In round r the candidates of segment r go to the clusters that still have open members,
dealt to slices by id; a slice is sorted by bound, and members walk it in blocks, one matrix product for each. After the
round the best of all slices are merged, and members close that the threshold of the next segment certifies. The last segment has
no threshold, so every answer is exact, however little the bounds rule out. Clusters with many members are split into groups
of about `members`; so a task holds one group and one slice, however many copies an anchor or a candidate has. There are no
pairs beyond the products inside blocks, and no more than k rows for each anchor, band and slice leave a task.

Two searches use this: the best rows of an anchor's own label (its positives), then, for each positive, the best rows of other labels
whose score lies within a band of the positive's. The lower end of the band is a certificate by itself.

The cluster centroids are fitted on at most `sample` anchors; they decide how much is walked, never what is found.

Nulls: rows with a null id, label or vector, or a null or non-finite component, take no part. Vectors are compared as if the
shorter one ended in zeros; one without components scores 0. Rows alike in id, label and vector count once; other rows that share an id
are rows of their own, but never each other's positives or negatives. Ties in score go to the smaller id. A positive with a
negative score has an empty band. Fewer rows than asked for: all of them. An empty table, or one without anchors, gives none.
Other columns are not read. Sums of squares must stay below 2^62, or the job fails with that message. Jobs run when `mine` is called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.llm.centroids import as_integers, is_kept, matrix
from voxelspark.llm.shared import drop_stored, stored

BINS = 512
BLOCK = 1024
SLICE = 8192
_FOUND = "key long, band int, id long, score long"
_FAR = 1 << 62


def angular_centroids(vectors: np.ndarray, k: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """k unit vectors by spherical k-means."""
    unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    centre = unit[np.random.default_rng(seed).permutation(len(unit))[:k]]
    for _ in range(rounds):
        of = (unit @ centre.T).argmax(1)
        for c in range(len(centre)):
            total = unit[of == c].sum(0)
            if np.linalg.norm(total) > 0:
                centre[c] = total / np.linalg.norm(total)
    return centre


def _angles(vectors: np.ndarray, norms: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(vectors @ centres.T / np.maximum(norms, 1e-300)[:, None], -1.0, 1.0))


def _bounds(vectors: np.ndarray, norms: np.ndarray, centres: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For every row and cluster: the most that the row scores with a member of norm 1."""
    return norms[:, None] * np.cos(np.maximum(0.0, _angles(vectors, norms, centres) - radius - 1e-6))


def reach(norms: np.ndarray, bound: float) -> np.ndarray:
    """What anchors of these norms score at most where the shared bound is `bound`; with room for rounding."""
    most = norms * bound
    return most + np.abs(most) * 1e-9 + 1e-3


def walk(members: dict[str, np.ndarray], bands: list[list[tuple[int, int, int, int]]], candidates: dict[str, np.ndarray], k: int, same_label: bool) -> list[tuple[int, int, int, int]]:
    """Rows (key, band, id, score): the best k of these candidates for each band (band, low, high, floor) of each member.

    A floor is the score that k rows found before reach; a candidate as good may still win by its id, so it is let through.
    """
    order = np.argsort(-candidates["bound"], kind="stable")
    rows, bound, ids, labels = (candidates[c][order] for c in ("v", "bound", "id", "label"))
    small = max((np.abs(x).max(initial=0) for x in (rows, members["v"]))) ** 2 * max(1, rows.shape[1]) < 1 << 52
    kind = float if small else np.int64  # products of doubles are exact below 2^53
    own, rows = members["v"].astype(kind), rows.astype(kind)
    floors = [[max(low, floor) for _, low, _, floor in b] for b in bands]
    least = np.array([min(f, default=_FAR) for f in floors], np.int64)
    best: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for at in range(0, len(rows), BLOCK):
        open_ = np.flatnonzero(reach(members["norm"], bound[at]) >= least)
        if not len(open_):
            break  # certified for all: the list is sorted
        block = slice(at, at + BLOCK)
        scores = (own[open_] @ rows[block].T).astype(np.int64)
        fits = ((labels[block] == members["label"][open_, None]) == same_label) & (ids[block] != members["id"][open_, None]) & (scores >= least[open_, None])
        for i in np.flatnonzero(fits.any(1)).tolist():
            m, hit = int(open_[i]), np.flatnonzero(fits[i])
            score, name = scores[i, hit], ids[block][hit]
            for b, (_, _, high, _) in enumerate(bands[m]):
                inside = np.flatnonzero((score >= floors[m][b]) & (score <= high))
                if not len(inside):
                    continue
                inside = inside[np.lexsort((name[inside], -score[inside]))[:k]]
                found = sorted([*best.get((m, b), []), *zip((-score[inside]).tolist(), name[inside].tolist(), strict=True)])[:k]
                best[m, b] = found
                if len(found) == k:
                    floors[m][b] = max(floors[m][b], -found[-1][0])
            least[m] = min(floors[m])
    return [(int(members["key"][m]), bands[m][b][0], name, -score) for (m, b), found in best.items() for score, name in found]


class _Lists:
    """The clusters' shared lists over stored rows (id, label, v, norm): bounds, thresholds and segments."""

    def __init__(self, rows: DataFrame, dims: int, centres: np.ndarray, radius: np.ndarray, most: float, first: int, growth: int):
        self.rows, self.dims = rows, dims
        self.shared = rows.sparkSession.sparkContext.broadcast((centres, radius))
        shared, edges, clusters = self.shared, np.linspace(-most, most, BINS + 1), len(centres)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((clusters, BINS), np.int64)
            for batch in batches:
                bounds = _bounds(matrix(batch.column(0), dims).astype(float), batch.column(1).to_numpy(), *shared.value)
                bins = np.clip(np.searchsorted(edges, bounds, "right") - 1, 0, BINS - 1)
                np.add.at(total, (np.broadcast_to(np.arange(clusters), bins.shape), bins), 1)
            c, b = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(b, pa.int32()), pa.array(total[c, b])], names=["cluster", "bin", "n"])

        # clusters * BINS counts
        counts = np.zeros((clusters, BINS), np.int64)
        for r in rows.select("v", "norm").mapInArrow(count, "cluster int, bin int, n long").groupBy("cluster", "bin").agg(F.sum("n").alias("n")).collect():
            counts[r["cluster"], r["bin"]] = r["n"]
        #: by cluster: (least bound, rows) of each segment, from the top
        self.segments: list[list[tuple[float, int]]] = []
        for c in range(clusters):
            own, want, got = [], first, 0
            for b in range(BINS - 1, -1, -1):
                got += int(counts[c, b])
                if got >= want and b:
                    own.append((float(edges[b]), got))
                    want, got = want * growth, 0
            self.segments.append([*own, (-np.inf, got)])

    def segment(self, r: int, groups: dict[int, list[int]]) -> DataFrame:
        """cluster, part, slice, id, label, bound, v of segment r, once for each open group of a cluster."""
        shared, dims = self.shared, self.dims
        spans = {c: (self.segments[c][r][0], self.segments[c][r - 1][0] if r else np.inf, self.slices(c, r)) for c in groups}

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, SLICE):
                    batch = whole.slice(start, SLICE)
                    bounds = _bounds(matrix(batch.column(2), dims).astype(float), batch.column(3).to_numpy(), *shared.value)
                    ids = batch.column(0).to_numpy().astype(np.uint64)
                    for c, parts in groups.items():
                        low, high, slices = spans[c]
                        at = np.flatnonzero((bounds[:, c] >= low) & (bounds[:, c] < high))
                        if not len(at):
                            continue
                        dealt = ((ids[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(slices)
                        taken = batch.take(pa.array(at))
                        for part in parts:
                            fixed = lambda x: pa.array(np.full(len(at), x), pa.int32())
                            yield pa.RecordBatch.from_arrays([fixed(c), fixed(part), pa.array(dealt.astype(np.int32)), taken.column(0), taken.column(1), pa.array(bounds[at, c]), taken.column(2)], names=["cluster", "part", "slice", "id", "label", "bound", "v"])

        return self.rows.select("id", "label", "v", "norm").mapInArrow(emit, "cluster int, part int, slice int, id long, label long, bound double, v array<int>")

    def slices(self, c: int, r: int) -> int:
        return max(1, -(-self.segments[c][r][1] // SLICE))


def _search(lists: _Lists, asked: DataFrame, k: int, same_label: bool) -> DataFrame:
    """key, band, id, score: the best k rows for every band of every row of `asked` (key, id, label, v, norm, cluster, part, bands)."""
    spark, dims = asked.sparkSession, lists.dims

    def task(members: pa.Table, candidates: pa.Table) -> pa.Table:
        if not members.num_rows or not candidates.num_rows:
            return pa.table({"key": pa.array([], pa.int64()), "band": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        own = {c: members.column(c).to_numpy() for c in ("key", "id", "label", "norm")} | {"v": matrix(members.column("v").combine_chunks(), dims)}
        bands = [[(b["band"], b["low"], b["high"], b["floor"]) for b in x] for x in members.column("bands").to_pylist()]
        others = {c: candidates.column(c).to_numpy() for c in ("id", "label", "bound")} | {"v": matrix(candidates.column("v").combine_chunks(), dims)}
        rows = walk(own, bands, others, k, same_label)
        columns = list(zip(*rows, strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("key", "band", "id", "score"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)})

    best, open_, r = spark.createDataFrame([], _FOUND), asked, 0
    while True:
        groups: dict[int, list[int]] = {}
        for row in open_.select("cluster", "part").distinct().collect():  # one row for each `members` anchors
            groups.setdefault(row[0], []).append(row[1])
        if not groups:
            return best
        dealt = F.broadcast(spark.createDataFrame([(c, lists.slices(c, r)) for c in groups], "cluster int, slices int"))  # one row for each cluster
        members = open_.join(dealt, "cluster").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices")
        keys = ["cluster", "part", "slice"]
        found = members.groupBy(*keys).cogroup(lists.segment(r, groups).groupBy(*keys)).applyInArrow(task, _FOUND)
        order = Window.partitionBy("key", "band").orderBy(F.desc("score"), "id")
        before = best
        best = stored(best.unionByName(found).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n"))
        drop_stored(before)
        # what the rest of each list can reach at most, against each band's floor
        rest = F.broadcast(spark.createDataFrame([(c, lists.segments[c][r][0]) for c in groups if r + 1 < len(lists.segments[c])], "cluster int, rest double"))
        full = best.groupBy("key", "band").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == k)
        floors = full.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", "score"))).alias("floors"))  # few bands for each key
        most = F.col("norm") * F.col("rest") * 1.0
        most = most + F.abs(most) * 1e-9 + 1e-3
        raised = F.transform("bands", lambda b: b.withField("floor", F.coalesce(F.try_element_at("floors", b["band"]), b["floor"])))
        later = open_.join(rest, "cluster").join(floors, "key", "left").withColumn("bands", raised).where(F.exists("bands", lambda b: most >= F.greatest(b["low"], b["floor"])))
        last, open_, r = open_, stored(later.drop("rest", "floors")), r + 1
        if last is not asked:
            drop_stored(last)


def mine(vectors: DataFrame, is_anchor: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = 20_000, members: int = 1024, first: int = 4096, growth: int = 8) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows where `is_anchor` holds are anchors. Of each, the first `positives` rows of its label are positives; for each positive, the
    first `negatives` rows of other labels with a score of `low` to `high` percent of the positive's are returned. Labels are integers.
    """
    spark = vectors.sparkSession
    taken = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    taken = taken.where("id is not null and label is not null").where(is_kept(F.col("v")))
    dims = max(1, taken.agg(F.max(F.size("v"))).first()[0] or 0)
    whole = taken.select("id", "label", as_integers(F.col("v"), scale).alias("v"), "anchor")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    checked = F.when(F.col("square") < float(_FAR), F.sqrt("square")).otherwise(F.raise_error(F.lit("a sum of squares is 2^62 or more")).cast("double"))
    whole = whole.withColumn("square", square).withColumn("norm", checked)
    padded = F.concat(F.transform("v", lambda x: x.try_cast("int")), F.array_repeat(F.lit(0), F.lit(dims) - F.size("v")))
    rows = stored(whole.select("id", "label", padded.alias("v"), "norm", "anchor").dropDuplicates())
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = rows.where("anchor")
    n_anchors, most = anchors.count(), rows.agg(F.max("norm")).first()[0]
    if not n_anchors:
        return nothing
    fitted = np.array([r[0] for r in anchors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()], float)
    centres = angular_centroids(fitted, int(min(256, len(fitted), max(1, np.sqrt(n_anchors) // 2))))
    shared = spark.sparkContext.broadcast(centres)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            angles = _angles(matrix(batch.column(2), dims).astype(float), batch.column(3).to_numpy(), shared.value)
            of = angles.argmin(1)
            # a vector of zeros scores 0 whatever its angle
            angle = np.where(batch.column(3).to_numpy() > 0, angles[np.arange(len(of)), of], 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32()), pa.array(angle)], names=["id", "label", "v", "norm", "cluster", "angle"])

    near = anchors.select("id", "label", "v", "norm").mapInArrow(nearest, "id long, label long, v array<int>, norm double, cluster int, angle double")
    asked = stored(near.withColumn("key", F.monotonically_increasing_id()))
    sizes = {r[0]: r[1:] for r in asked.groupBy("cluster").agg(F.count("*"), F.max("angle")).collect()}
    radius = np.array([sizes[c][1] if c in sizes else 0.0 for c in range(len(centres))])
    parts = F.broadcast(spark.createDataFrame([(c, -(-n // members)) for c, (n, _) in sizes.items()], "cluster int, parts int"))  # a row for each cluster
    asked = asked.join(parts, "cluster").select("key", "id", "label", "v", "norm", "cluster", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
    lists = _Lists(rows, dims, centres, radius, float(most) or 1.0, first, growth)
    band = lambda n, lo, hi: F.struct(n.cast("int").alias("band"), lo.cast("long").alias("low"), hi.cast("long").alias("high"), F.lit(-_FAR).cast("long").alias("floor"))
    everything = F.array(band(F.lit(0), F.lit(-_FAR), F.lit(_FAR)))
    own = _search(lists, asked.withColumn("bands", everything), positives, True)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id"))
    ranked = stored(own.select("key", place.alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    percent = lambda p: F.col("positive_score").cast("decimal(38,0)") * p / 100
    bands = ranked.where("positive_score >= 0").groupBy("key").agg(F.collect_list(band(F.col("band"), F.ceil(percent(low)), F.floor(percent(high)))).alias("bands"))  # `positives` rows for each key
    other = _search(lists, asked.join(bands, "key"), negatives, False)
    rank = F.row_number().over(Window.partitionBy("key", "band").orderBy(F.desc("score"), "id"))
    out = other.withColumn("rank", rank).join(ranked, ["key", "band"]).join(asked.select("key", F.col("id").alias("anchor_id")), "key")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
