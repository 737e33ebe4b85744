"""Benchmark decontamination by CGK embeddings, bit-sampling LSH and exact edit verification, over words.

Words are runs of letters and digits without regard to ASCII case. A document holds an item of n words if some run of its
words is within n // 5 word edits of it (fewer than 6 words: equal).

1. Windows. An item cut into one piece more than its edits has a piece that every such run holds unchanged. So windows are
   taken only around such pieces: all item-sized windows whose start is within the edits of where the piece puts it, padded
   where they reach beyond their text. This loses nothing, and most texts end here.
2. CGK. A random walk maps each window and item to a longer string: a random bit of each symbol and step says whether to
   advance, so that a few edits become a small Hamming distance.
3. Bit sampling. Each of `TABLES` tables hashes a few sampled steps, chosen by the item's size alone; a window meets the items
   that agree on them. Walks are repeated until items with the full number of random edits are found with probability `recall`
   (measured when fitting on all items of a block, apart for edits of any kind and for deletions in a text that ends there).
   Items too long to be found so in `MOST_WALKS` walks skip the tables: every place of their pieces is verified. The recall
   is measured again on fresh draws of all items, and walks are added until it holds.
4. Verification. The edit distance of the item to the best run of words near the window is computed exactly.

The items are fitted in blocks of `block`, and documents are scanned once, in place, for all of them: no shuffle, however many
documents share a passage. All items are broadcast (up to 17 MB for each block and 2 KB for each item): a benchmark is a bounded list.

Nulls: a null text holds nothing; null items and items without words are never held. Repeated rows come out alike; items
that are alike are all reported. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.bytewords import NOT_ALNUM, Words, grams, mix, slices, utf8
from voxelspark.llm.shared import bounded

TABLES, SAMPLED, LONGEST_GRAM, MOST_WALKS = 4, 2, 4, 64
_TRIALS = 400
_PAD = np.uint64(0x5851F42D4C957F2D)


def edits(n: int) -> int:
    return n // 5 if n >= 6 else 0


def sellers(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(least edit distance of item to any run of text, end of the first such run)."""
    m = len(text)
    steps = np.arange(m + 1)
    row = np.zeros(m + 1, np.int64)
    for i, word in enumerate(item):
        new = np.empty_like(row)
        new[0] = i + 1
        new[1:] = np.minimum(row[:-1] + (text != word), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    end = int(row.argmin())
    return int(row[end]), end


def _changed(item: np.ndarray, ends: bool, rng: np.random.Generator) -> np.ndarray:
    """A window with the item after all its edits: of any kind in a longer text, or deletions in a text that ends there."""
    y = list(item)
    for _ in range(edits(len(item))):
        kind, at = 2 if ends else rng.integers(3), int(rng.integers(len(y)))
        if kind == 0:
            y[at] = rng.integers(0, 1 << 63, dtype=np.uint64)
        elif kind == 1:
            y.insert(at, rng.integers(0, 1 << 63, dtype=np.uint64))
        else:
            y.pop(at)
    y += [_PAD if ends else rng.integers(0, 1 << 63, dtype=np.uint64) for _ in range(len(item))]
    return np.array(y[: len(item)], np.uint64)


@dataclass
class Benchmark:
    """A block of items, ready to be looked for."""

    ids: list
    words: list[np.ndarray]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: sorted hashes, item, offset
    filters: dict[int, np.ndarray]
    bits: np.ndarray  # by walk and step
    samples: np.ndarray  # by walk, table: shares of the walk
    tables: list[list[tuple[np.ndarray, np.ndarray]]]
    direct: np.ndarray  # by item: verified at every place of its pieces
    recall: float | None = None  # measured on draws that the number of walks was not chosen by; None if all items are direct

    @classmethod
    def of(cls, ids: list, texts: list[str | None], *, recall: float = 0.99, seed: int = 11) -> Benchmark:
        data, at = utf8(pa.array(texts, pa.string()))
        w = Words(data, at, NOT_ALNUM)
        words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(ids))]
        some = [i for i, x in enumerate(words) if len(x)]
        ids, words = [ids[i] for i in some], [words[i] for i in some]
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for i, x in enumerate(words):
            n, k = len(x), edits(len(x))
            q = min(LONGEST_GRAM, n // (k + 1))
            g = grams(x, q)
            for j in range(k + 1):
                o = j * n // (k + 1)
                pieces.setdefault(q, []).append((int(g[o]), i, o))
        by, filters = {}, {}
        for q, rows in pieces.items():
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            by[q] = keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            filters[q] = np.zeros(1 << 22, bool)
            filters[q][(keys >> np.uint64(42)).astype(np.int64)] = True
        rng = np.random.default_rng(seed)
        most = 2 * max((len(x) for x in words), default=1)
        out = cls(ids, words, by, filters, rng.integers(0, 1 << 63, (MOST_WALKS, most), np.uint64) | np.uint64(1), rng.random((MOST_WALKS, TABLES, SAMPLED)), [], np.zeros(len(ids), bool))
        walks = out._walks_for(recall, rng)
        # on fresh draws, within two standard deviations; else more walks, and in the end none of the tables
        while (met := out.measured(walks, rng)) is not None and met < recall - 2 * (recall * (1 - recall) / _TRIALS) ** 0.5:
            if walks == MOST_WALKS:
                out.direct[:] = True
                break
            walks = min(MOST_WALKS, walks + 4)
        out.recall = met
        out.bits, out.samples = out.bits[:walks], out.samples[:walks]
        if words:
            block, n = out._block(words)
            for r in range(walks):
                keys = out._keys(block, n, r)
                orders = [np.argsort(keys[:, t], kind="stable") for t in range(TABLES)]
                out.tables.append([(keys[o, t], o) for t, o in enumerate(orders)])
        return out

    def _block(self, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        n = np.array([len(x) for x in words])
        block = np.full((len(words), n.max()), _PAD, np.uint64)
        for i, x in enumerate(words):
            block[i, : len(x)] = x
        return block, n

    def _keys(self, block: np.ndarray, n: np.ndarray, walk: int) -> np.ndarray:
        """One key for each row and table: the sampled steps of the walk of each row over its first n words."""
        rows, width = block.shape
        at, steps = np.zeros(rows, np.int64), min(2 * width, self.bits.shape[1])
        trace = np.empty((rows, steps), np.uint64)
        every = np.arange(rows)
        for j in range(steps):
            symbol = np.where(at < n, block[every, np.minimum(at, width - 1)], _PAD)
            trace[:, j] = symbol
            at += ((symbol * self.bits[walk, j]) >> np.uint64(63)).astype(np.int64)
        keys = np.zeros((rows, TABLES), np.uint64)
        for t in range(TABLES):
            for share in self.samples[walk, t]:
                step = np.minimum((share * 2 * n).astype(np.int64), steps - 1)
                keys[:, t] = mix(keys[:, t] * np.uint64(31) + trace[every, step] + step.astype(np.uint64))
        return keys

    def measured(self, walks: int, rng: np.random.Generator) -> float | None:
        """The share of changed items that meet theirs in some table: all items with edits and tables, the lower of both kinds of change."""
        own = np.flatnonzero([edits(len(x)) > 0 for x in self.words] & ~self.direct)
        if not len(own):
            return None
        items, shares = np.repeat(own, -(-_TRIALS // len(own))), []
        for ends in (False, True):
            met = np.zeros(len(items), bool)
            for part in np.array_split(np.arange(len(items)), -(-len(items) * self.bits.shape[1] // (1 << 21))):
                (a, n), (b, _) = self._block([self.words[i] for i in items[part]]), self._block([_changed(self.words[i], ends, rng) for i in items[part]])
                for walk in range(walks):
                    met[part] |= (self._keys(a, n, walk) == self._keys(b, n, walk)).any(axis=1)
            shares.append(met.mean())
        return float(min(shares))

    def _walks_for(self, recall: float, rng: np.random.Generator) -> int:
        """As many walks as find items with all their edits at random places with the given probability; longer items are direct."""
        sizes = np.array([len(x) for x in self.words])
        items = np.flatnonzero([edits(n) > 0 for n in sizes])
        items = np.repeat(items, -(-_TRIALS // max(1, len(items))))  # one for each trial
        met = []
        for ends in (False, True):
            changed = [_changed(self.words[i], ends, rng) for i in items]
            first = np.full(len(items), MOST_WALKS)  # by trial: the first walk that meets its item
            left = np.arange(len(items))
            for walk in range(MOST_WALKS):
                if len(left) <= (1 - recall) * len(items):
                    break
                for part in np.array_split(left, -(-len(left) * self.bits.shape[1] // (1 << 21))):
                    (a, n), (b, _) = self._block([self.words[items[i]] for i in part]), self._block([changed[i] for i in part])
                    first[part[(self._keys(a, n, walk) == self._keys(b, n, walk)).any(axis=1)]] = walk
                left = left[first[left] == MOST_WALKS]
            if len(left) > (1 - recall) * len(items):
                # the tables keep the items up to the greatest size up to which they find enough
                by_size = np.argsort(sizes[items], kind="stable")
                enough = np.cumsum(first[by_size] == MOST_WALKS) <= (1 - recall) * np.arange(1, len(items) + 1)
                last = np.append(np.diff(sizes[items[by_size]]) > 0, True)
                self.direct |= sizes > max(sizes[items[by_size[enough & last]]], default=5)
            met.append(first)
        kept = ~self.direct[items]
        if not kept.any():
            return 1
        return 1 + max(int(np.sort(first[kept])[int(np.ceil(recall * kept.sum())) - 1]) for first in met)

    def seeds(self, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first word, item, text) of the places where an item's piece puts it."""
        for q, (keys, items, offsets) in self.grams.items():
            g = grams(w.hash, q)
            p = np.flatnonzero(self.filters[q][(g >> np.uint64(42)).astype(np.int64)])
            a, b = np.searchsorted(keys, g[p], "left"), np.searchsorted(keys, g[p], "right")
            n = b - a
            p, at = np.repeat(p, n), np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            text = np.searchsorted(w.first, p, "right") - 1
            inside = p + q <= w.first[text + 1]
            yield (p - offsets[at])[inside], items[at][inside], text[inside]

    def found(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, words) of every item that a text holds, at its best place."""
        w = Words(data, at, NOT_ALNUM)
        parts = [x for x in zip(*self.seeds(w), strict=True)] if self.grams else []
        if not parts:
            return []
        start, item, text = (np.concatenate(x) for x in parts)
        if not len(start):
            return []
        sizes = np.array([len(x) for x in self.words])
        windows, pairs = [np.zeros((0, 3), np.int64)], []
        for i in np.unique(item):
            k, mine = edits(sizes[i]), np.unique(np.column_stack((text, start))[item == i], axis=0)
            if self.direct[i]:
                pairs += [(t, int(i), f) for t, f in mine.tolist()]
                continue
            spread = np.column_stack((np.repeat(mine[:, 0], 2 * k + 1), (mine[:, 1][:, None] + np.arange(-k, k + 1)).ravel()))
            windows.append(np.column_stack((spread, np.full(len(spread), sizes[i]))))
        rows = np.unique(np.concatenate(windows), axis=0)
        # a window that reaches beyond its text is padded there, so that it samples the same steps as its item
        rows = rows[(rows[:, 1] < w.first[rows[:, 0] + 1]) & (rows[:, 1] + rows[:, 2] > w.first[rows[:, 0]])]
        return self._verified(w, sorted(pairs + self._candidates(w, *rows.T)))

    def _candidates(self, w: Words, text: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[tuple[int, int, int]]:
        """Distinct (text, item, first word) of windows that meet an item in some table."""
        out = set()
        for i in range(0, len(first), 20_000):
            f, m, t = first[i : i + 20_000], n[i : i + 20_000], text[i : i + 20_000]
            at = f[:, None] + np.arange(m.max())
            inside = (at >= w.first[t][:, None]) & (at < np.minimum(f + m, w.first[t + 1])[:, None])
            block = np.where(inside, w.hash[np.clip(at, 0, len(w.hash) - 1)], _PAD)
            for walk, tables in enumerate(self.tables):
                keys = self._keys(block, m, walk)
                for c, (sorted_keys, order) in enumerate(tables):
                    a, b = np.searchsorted(sorted_keys, keys[:, c], "left"), np.searchsorted(sorted_keys, keys[:, c], "right")
                    for k in np.flatnonzero(b > a).tolist():
                        out.update((int(t[k]), int(x), int(f[k])) for x in order[a[k] : b[k]])
        return sorted(out)

    def _verified(self, w: Words, pairs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        i = 0
        while i < len(pairs):
            text, item, first = pairs[i]
            words = self.words[item]
            n, k = len(words), edits(len(words))
            j = i
            while j + 1 < len(pairs) and pairs[j + 1][:2] == (text, item) and pairs[j + 1][2] - pairs[j][2] <= n:
                j += 1
            a = max(first - k, w.first[text])
            b = min(pairs[j][2] + n + k, w.first[text + 1])
            i = j + 1
            region = w.hash[a:b]
            distance, stop = sellers(words, region)
            if distance > k:
                continue
            # the same from behind gives where the run begins
            _, back = sellers(words[::-1], region[:stop][::-1])
            value = (distance, int(a) + stop - back - int(w.first[text]), back)
            key = (text, item)
            if key not in best or value < best[key]:
                best[key] = value
        return [(t, i, *v) for (t, i), v in sorted(best.items())]


SCHEMA = "doc_id long, item_id long, distance int, first_word int, n_words int, item_words int"


def _blocks(items: DataFrame, item_id_col: str, item_text_col: str, recall: float, block: int) -> list:
    """The items, fitted and broadcast in blocks of `block`; an item of any block costs a scan the same."""
    spark = items.sparkSession
    listed = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null").distinct()
    parts, out = max(1, -(-listed.count() // block)), []
    for k in range(parts):
        # one block at a time, bounded in number
        rows = (listed if parts == 1 else listed.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)).collect()
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            out.append(spark.sparkContext.broadcast(Benchmark.of([r[0] for r in rows], [r[1] for r in rows], recall=recall)))
    return out


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", recall: float = 0.99, block: int = 4096) -> DataFrame:
    """doc_id, item_id, distance, first_word, n_words, item_words: every item that a document holds, at its best place."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded(own).mapInArrow(_scan(_blocks(items, item_id_col, item_text_col, recall, block)), SCHEMA)


def _scan(blocks: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
        for batch in batches:
            ids = batch.column(0)
            data, at = utf8(batch.column(1))
            rows = []
            for i, j in slices(at):
                for b in (shared.value for shared in blocks):
                    for text, item, distance, first, n in b.found(data[at[i] : at[j]], at[i : j + 1] - at[i]):
                        rows.append((ids[i + text].as_py(), b.ids[item], distance, first, n, len(b.words[item])))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "distance", "first_word", "n_words", "item_words"])

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", recall: float = 0.99, block: int = 4096) -> DataFrame:
    """The rows of docs that hold no item, with their columns: each row is judged where it is, so nothing is joined back."""
    return bounded(docs).mapInArrow(_sieve(_blocks(items, "item_id", "text", recall, block), text_col), docs.schema)


def _sieve(blocks: list, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(batch.schema.get_field_index(text_col)))
            kept = np.ones(len(at) - 1, bool)
            for i, j in slices(at):
                for shared in blocks:
                    for hit in shared.value.found(data[at[i] : at[j]], at[i : j + 1] - at[i]):
                        kept[i + hit[0]] = False
            yield batch.filter(pa.array(kept))

    return run
