"""Centroid clustering, token block files and hard negatives: brute force, odd rows, exact round trips."""

import hashlib
import io
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.llm.test_edges import odd  # noqa: F401
from voxelspark.llm import centroids, hard_negatives, queries, token_blocks

VECTORS = "vec_id long, embedding array<float>, label int"
ODD = [(None, [0.5] * 4, 1), (900, None, 1), (901, [], 1), (902, [0.1, None, 0.2, 0.3], 1), (903, [float("nan")] * 4, 1), (904, [float("inf"), 0.0, 0.0, 0.0], 1), (905, [0.1, 0.2], None), (906, [0.3, 0.1], 2), (907, [0.0] * 4, 3), (907, [0.0] * 4, 3)]


def vectors(seed, n, dims=4, copies=0):
    r = np.random.default_rng(seed)
    rows = [(i, r.normal(size=dims).astype(np.float32).tolist(), int(r.integers(3))) for i in range(n)]
    return rows + [(n + i, rows[1][1], i % 3) for i in range(copies)]


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("x") for c in ("id", "v", "cluster", "norm", "key", "bands", "anchor", "square", "score", "slice", "distance")})


def kmeans(rows, k, rounds, scale, dims):
    kept = [(i, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    mid = [list(v) for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), c) for c, m in enumerate(mid))
    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in kept:
            by[near(v)[1]].append(v)
        for c, own in by.items():
            mid[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    inertia = defaultdict(int)
    for _, c, d in found:
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in mid]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), names[c]) for i, c, d in found), key=str)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_clusters(spark, k):
    # copies of one vector tie and can start several centroids; the centroid with the smaller number keeps them all
    rows = [*vectors(1, 150, copies=60), *ODD, (3, [0.5] * 4, 0), (3, [0.25] * 4, 0)]
    got = centroids.cluster(frame(spark, rows), k=k, rounds=3, dims=4, scale=64).collect()
    assert sorted((tuple(r) for r in got), key=str) == kmeans(rows, k, 3, 64, 4)


def test_clusters_of_few_vectors(spark):
    few = frame(spark, vectors(2, 3))
    assert {r["distance"] for r in centroids.cluster(few, k=8, dims=4).collect()} == {0}
    assert centroids.cluster(few.limit(0), k=8, dims=4).count() == 0 and centroids.cluster(few, k=8, dims=5).count() == 0
    with pytest.raises(Exception, match="beyond 2\\^27"):
        centroids.cluster(frame(spark, [(1, [1e30] * 4, 0)]), k=2, dims=4)


@pytest.mark.parametrize("seed", range(4))
def test_tree_is_exact_and_prunes(seed):
    r = np.random.default_rng(seed)
    mid = r.integers(-1000, 1000, (60, 3))
    mid[7] = mid[3]  # a tie: the smaller number wins
    rows = np.concatenate((mid + r.integers(-30, 30, mid.shape), (mid[:30] + mid[30:]) // 2))
    best, square, measured = centroids.VantageTree(mid).nearest(rows)
    all_ = ((rows[:, None] - mid) ** 2).sum(2)
    assert (square == all_.min(1)).all() and (best == all_.argmin(1)).all() and measured < 0.6 * all_.size


def negatives(rows, every, positives, most, low, high, scale):
    whole = {(i, label, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)) for i, v, label in rows if None not in (i, v, label) and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for a, label, v in whole:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, m == label) for i, m, w in whole if i != a)
        own = [(s, i) for s, i, same in scored if same][:positives]
        for s, i in own:
            fit = [(t, j) for t, j, same in scored if not same and low * -s <= 100 * -t <= high * -s][:most]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize(("dims", "first", "members"), [(4, 16, 2), (4, 4096, 1024), (24, 64, 8)])
def test_hard_negatives(spark, dims, first, members):
    rows = [*vectors(3, 400, dims, copies=150), *ODD]
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 5 == 0, positives=4, negatives=7, scale=16, first=first, growth=3, members=members)
    assert sorted(tuple(r) for r in got.collect()) == negatives(rows, 5, 4, 7, 30, 90, 16)


def test_hard_negatives_of_few_rows(spark):
    few = frame(spark, vectors(4, 9))
    assert hard_negatives.mine(few.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert hard_negatives.mine(few, F.col("vec_id") < 0).count() == 0
    assert hard_negatives.mine(few.withColumn("label", F.lit(1)), F.col("vec_id") == 0).count() == 0
    with pytest.raises(Exception, match="2\\^62"):
        hard_negatives.mine(frame(spark, [(0, [3e7] * 4, 0)]), F.col("vec_id") == 0)


def test_walks_stop_once_certified():
    """On clustered vectors a member looks at a small part of its list, and still finds the best."""
    r = np.random.default_rng(5)
    rows = np.repeat(r.normal(size=(20, 8)) * 100, 1000, axis=0) + r.normal(size=(20_000, 8)) * 4
    rows = np.floor(rows).astype(np.int64)
    norms = np.linalg.norm(rows, axis=1)
    own = np.flatnonzero(np.arange(len(rows)) < 1000)[:20]
    centre = rows[own].mean(0, keepdims=True) / np.linalg.norm(rows[own].mean(0))
    radius = hard_negatives._angles(rows[own].astype(float), norms[own], centre).max(0)
    bound = hard_negatives._bounds(rows.astype(float), norms, centre, radius)[:, 0]
    looked = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            looked.append(self.shape[0] * other.shape[1])
            return np.asarray(self) @ np.asarray(other)

    labels = np.zeros(len(rows), np.int64)
    members = {"key": own, "id": own, "label": labels[own], "norm": norms[own], "v": rows[own].view(Counted)}
    got = hard_negatives.walk(members, [[(0, -(1 << 62), 1 << 62, -(1 << 62))]] * len(own), {"v": rows, "id": np.arange(len(rows)), "label": labels, "bound": bound}, 5, True)
    scores = rows[own] @ rows.T
    for i, a in enumerate(own):
        order = [j for j in np.lexsort((np.arange(len(rows)), -scores[i])) if j != a][:5]
        assert [(j, s) for m, _, j, s in got if m == a] == [(j, scores[i, j]) for j in order]
    assert sum(looked) < 0.5 * len(own) * len(rows)


@pytest.mark.parametrize("percentile", [0, 50, 90, 100])
def test_blocks_round_trip(percentile):
    r = np.random.default_rng(6)
    for ids in (np.zeros(1), np.full(5, 2**32 - 1), r.integers(0, 2**32, 1000), r.zipf(1.3, 3000) % 50_000, np.array([7] * 99 + [2**32 - 1]), np.arange(8)):
        ids = ids.astype(np.uint32)
        assert (token_blocks.decode_block(token_blocks.encode_block(ids, percentile)) == ids).all()
    # outliers go to the exception list in place of widening all
    assert len(token_blocks.encode_block(np.array([7] * 990 + [2**31] * 10, np.uint32), 90)) < 120


def test_shard_seeks_to_the_blocks_it_needs():
    r, out = np.random.default_rng(7), io.BytesIO()
    docs = [(i, r.integers(0, 50_000, int(n)).astype(np.uint32)) for i, n in enumerate(r.integers(0, 300, 200))]
    w = token_blocks.ShardWriter(out, block=128, split=4096)
    for i, ids in docs:
        w.add(i or None, ids)
    facts = w.close()
    assert len(facts["splits"]) > 3 and facts["ids"] == sum(len(x) for _, x in docs)

    class Source(io.BytesIO):
        taken = 0

        def size(self):
            return len(self.getvalue())

        def read(self, n=-1):
            Source.taken += n
            return super().read(n)

    shard = token_blocks.ShardReader(Source(out.getvalue()), 128)
    index, Source.taken = Source.taken, 0
    got = list(shard.documents(100, 103, at_once=100))
    assert [(d, list(x)) for d, _, x in got] == [(d, list(x)) for d, x in docs[100:103]] and Source.taken < 0.1 * len(out.getvalue())
    assert [d for d, _, _ in shard.documents(0, 200)] == [None, *range(1, 200)] and index > 0


def test_token_blocks(spark, odd, tmp_path):  # noqa: F811
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    docs = odd.union(odd.where("doc_id in (8, 13)")).withColumns({"ids": F.lit("i"), "start": F.lit(1)})
    path = str(tmp_path / "tokens")
    token_blocks.write(docs, queries.tokenizer_path(), path, end_id=2, block=1000)
    got = token_blocks.read(spark, path).orderBy("start").collect()
    expected = sorted(((r["doc_id"], tuple([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2])) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in got] == [d for d, _ in expected]
    ids = [(r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got]
    assert sorted(ids, key=str) == sorted(expected, key=str)
    assert [r["start"] for r in got] == np.cumsum([0, *(len(x) for _, x in ids)])[:-1].tolist()
    empty = str(tmp_path / "none")
    token_blocks.write(docs.limit(0), queries.tokenizer_path(), empty)
    assert token_blocks.read(spark, empty).count() == 0


def test_op12(spark):
    import pandas as pd
    from tokenizers import Tokenizer

    tok, start, expected = Tokenizer.from_file(queries.tokenizer_path()), 0, []
    for r in pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id").itertuples():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op12_token_blocks(spark, SF).collect()) == expected
