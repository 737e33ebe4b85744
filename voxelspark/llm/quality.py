"""Quality classifier: averaged embeddings of hashed words and character n-grams, softmax, trained by numpy SGD.

Fitting uses a bounded sample: the `sample` labelled rows with the least hash of their id. Their texts (whole) are hashed in
Spark; only the sparse counts of the sample reach the driver, where embeddings and output weights are learned together by
stochastic gradient descent. As the output is linear in the average, scoring needs one number for each bucket: the
embedding times the difference of the output weights. Scoring is map-only and reads whole texts.

Nulls: a null text is scored as an empty one, which has no features and gets the model's prior. Null labels or ids are not
learned from; several labels of one id count once each. Without labels of both kinds every score is the share of label 1
(0.5 without any). Repeated rows come out alike. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.bytewords import Words, slices, utf8
from voxelspark.llm.shared import bounded
from voxelspark.llm.symbols import codepoints

BITS = 17
GRAMS = (2, 3, 4)
_K = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(64 - BITS)


def _features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For words and for each n: the buckets of all texts, one after another, and where each text begins."""
    w = Words(data, at)
    yield ((w.hash * _K) >> _SHIFT).astype(np.int32), w.first
    points, start = codepoints(data, at)
    points = points.astype(np.uint64) + np.uint64(1)
    h = points * _K
    for n in range(2, max(GRAMS) + 1):
        h = (h[:-1] ^ points[n - 1 :]) * _K if len(h) else h
        if n not in GRAMS:
            continue
        bucket = (h >> _SHIFT).astype(np.int32)
        # n-grams that begin in one text and end in the next are left out
        last = np.maximum(start[1:] - n + 1, start[:-1])
        inside = np.zeros(len(bucket) + 1, np.int32)
        np.add.at(inside, np.minimum(start[:-1], len(bucket)), 1)
        np.add.at(inside, np.minimum(last, len(bucket)), -1)
        yield bucket[np.cumsum(inside[:-1]) > 0], np.concatenate(([0], np.cumsum(last - start[:-1])))


@dataclass
class QualityModel:
    weight: np.ndarray  # by bucket: the difference of the two outputs
    bias: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        total, n = np.zeros(len(at) - 1), np.zeros(len(at) - 1)
        for bucket, first in _features(data, at):
            size = np.diff(first)
            some = size > 0
            if some.any():
                total[some] += np.add.reduceat(self.weight[bucket], first[:-1][some])
            n += size
        return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + self.bias)))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, distinct buckets and their shares of a text's features."""
    for batch in batches:
        data, at = utf8(batch.column(1))
        ids, shares = [], []
        for k in range(len(at) - 1):
            parts = [b for b, _ in _features(data[at[k] : at[k + 1]], np.array([0, at[k + 1] - at[k]]))]
            u, n = np.unique(np.concatenate(parts), return_counts=True)
            ids.append(u.astype(np.int32))
            shares.append((n / max(1, n.sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["label", "ids", "shares"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 5000, dim: int = 8, updates: int = 60_000, rate: float = 20.0, seed: int = 7) -> QualityModel:
    """docs with labels 0 and 1; at most `sample` labelled rows are learned from, in `updates` steps whatever their number."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    chosen = known.distinct().orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    # bounded by `sample` rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    rows = bounded(texts).select("label", "text").mapInArrow(_sparse, "label int, ids array<int>, shares array<float>").toArrow()
    y = rows.column("label").to_numpy() if rows.num_rows else np.zeros(0)
    zero = np.zeros(1 << BITS, np.float32)
    share = float(y.mean()) if len(y) else 0.5
    prior = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    if not len(y) or share in (0.0, 1.0):
        return QualityModel(zero, prior)
    ids = [np.asarray(x) for x in rows.column("ids").to_numpy()]
    shares = [np.asarray(x) for x in rows.column("shares").to_numpy()]
    rng = np.random.default_rng(seed)
    order = np.lexsort((np.array([s.sum() if len(s) else 0 for s in shares]), np.array([int(x.sum()) for x in ids]), y))  # the same in every run
    embed = rng.normal(0, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    out, bias = np.stack([-np.ones(dim), np.ones(dim)]).astype(np.float32) / dim, np.array([0, prior], np.float32)
    done = 0
    while done < updates:
        for k in rng.permutation(order)[: updates - done]:
            lr = rate * (1 - done / updates)
            done += 1
            mean = shares[k] @ embed[ids[k]] if len(ids[k]) else np.zeros(dim, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[int(y[k])] -= 1
            back = out.T @ g
            out -= 0.01 * lr * np.outer(g, mean)
            bias -= 0.001 * lr * g
            embed[ids[k]] -= lr * np.outer(shares[k], back)
    return QualityModel((embed @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def score(docs: DataFrame, model: QualityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(1))
            parts = [shared.value.scores(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in slices(at, 1 << 18)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=[id_col, "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return bounded(docs).select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, score double")
