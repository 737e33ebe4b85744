"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Which pieces share a sequence depends on their lengths alone, and there are at most ``capacity`` lengths. So Spark counts
the pieces of each length, the packing runs once over that histogram (bounded by the capacity, not by the corpus; equal
sequences are made in one step, with a multiplicity), and Spark deals the pieces of each length to the planned places by
their rank in that length. Ranks come from (length, salt) groups plus the sum of the groups before, so that no length,
however common, meets in one task: it has as many salts as its count asks for.

Nulls: a null text is an empty document, one piece of length 1 (its end token). Rows with equal ids are separate documents.
An empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.llm.bytewords import Words, slices, utf8
from voxelspark.llm.shared import bounded, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Characters for which lower() in Python and in the tokenizer agree and which normalisation leaves alone.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-įı-ɏ]*")
#: The tokenizer's own split, for those characters in lower case.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\s0-9a-z\xaa\xb2\xb3\xb5\xb9\xba\xbc-\xbe\xc0-\xd6\xd8-\xf6\xf8-ɏ]+")
#: Words in each of the two generations of a worker's cache, of some 30 bytes each.
_CACHE = 1 << 18


def _byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it prints, else the next from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class _WordIds:
    """Ids of words by hash, in sorted arrays."""

    def __init__(self) -> None:
        self.keys, self.start, self.size, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return at, (self.keys[at] == hashes) if len(self.keys) else np.zeros(len(hashes), bool)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words at these places, one after another; how many each has)."""
        size = self.size[at].astype(np.int64)
        to = np.cumsum(size)
        return self.ids[np.repeat(self.start[at] - to + size, size) + np.arange(size.sum())], size

    def add(self, hashes: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        keys = np.concatenate((self.keys, hashes))
        order = np.argsort(keys, kind="stable")  # two sorted runs
        self.keys = keys[order]
        self.start = np.concatenate((self.start, len(self.ids) + np.cumsum(size) - size))[order]
        self.size = np.concatenate((self.size, size.astype(np.int32)))[order]
        self.ids = np.concatenate((self.ids, ids))


class CachedTokenizer:
    """Token ids of many texts at once, as numpy arrays; each distinct word is tokenised once.

    A word is what stands between ASCII white space. Words never share a token, as the tokenizer drops white space before it
    merges, and case does not count, as it lower-cases. So the words of a batch are told apart by the 64-bit hashes of their
    bytes, and each one's ids are put in its places. A text that names one of the vocabulary's special tokens is tokenised
    whole, so that they are found as the tokenizer finds them. The caches are bounded and only save time.
    """

    _of: dict[tuple[str, bool], CachedTokenizer] = {}

    def __init__(self, path: str, encode_special: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = encode_special
        self.special = [] if encode_special else [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.part = lru_cache(maxsize=1 << 14)(self._part)
        self.new, self.old = _WordIds(), _WordIds()

    @classmethod
    def of(cls, path: str, encode_special: bool = False) -> CachedTokenizer:
        key = path, encode_special
        if key not in cls._of:
            cls._of[key] = cls(path, encode_special)
        return cls._of[key]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> list[int]:
        text = part if part.isascii() else "".join(self.letters[b] for b in part.encode())
        return [t.id for t in self.model.tokenize(text)]

    def _word(self, word: str) -> list[int]:
        if not _PLAIN.fullmatch(word):
            return self.tokenizer.encode(word, add_special_tokens=False).ids
        parts = _SPLIT.findall(word.lower())
        return self.part(parts[0]) if len(parts) == 1 else [i for p in parts for i in self.part(p)]

    def _learn(self, hashes: np.ndarray, words: Iterator[str]) -> None:
        """Put the ids of new words (by ascending hash) into the cache."""
        known = [self._word(w) for w in words]
        size = np.array([len(x) for x in known], np.int64)
        self.new.add(hashes, np.array([i for x in known for i in x], "<u4"), size)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another; where each text's begin, one offset more than texts) of UTF-8 bytes."""
        w = Words(data, at)
        kinds, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.new.keys) > _CACHE:
            self.old, self.new = self.new, _WordIds()
        at_new, hit = self.new.find(kinds)
        rest = np.flatnonzero(~hit)
        if len(rest):
            at_old, again = self.old.find(kinds[rest])
            kept = self.old.take(at_old[again])
            missing = rest[~again]
            spans = zip(w.begin[first[missing]].tolist(), w.end[first[missing]].tolist(), strict=True)
            self._learn(kinds[missing], (data[a:b].tobytes().decode() for a, b in spans))
            self.new.add(kinds[rest[again]], *kept)
            at_new, _ = self.new.find(kinds)
        flat, size = self.new.take(at_new)
        start, n = np.cumsum(size) - size, size[inverse]
        to = np.concatenate(([0], np.cumsum(n)))
        ids = flat[np.repeat(start[inverse] - to[:-1], n) + np.arange(to[-1])]
        offsets = to[w.first]
        whole = [k for k in range(len(at) - 1) if self._names_special(data[at[k] : at[k + 1]])] if self.special and self._names_special(data) else []
        for k in reversed(whole):
            own = np.frombuffer(self._whole(data[at[k] : at[k + 1]].tobytes().decode()), "<u4")
            ids = np.concatenate((ids[: offsets[k]], own, ids[offsets[k + 1] :]))
            offsets = np.concatenate((offsets[: k + 1], offsets[k + 1 :] - (offsets[k + 1] - offsets[k]) + len(own)))
        return ids, offsets

    def _names_special(self, data: np.ndarray) -> bool:
        low = data.tobytes().lower()
        return any(t in low for t in self.special)


def token_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, encode_special: bool = False) -> DataFrame:
    """One row for each piece of a document's ids and its end id: doc_id, piece, start, length, ids_crc32[, ids binary].

    `encode_special` reads the names of special tokens in a text as plain text.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = CachedTokenizer.of(tokenizer_path, encode_special), np.array([end_id], "<u4")
        for batch in batches:
            doc = batch.column(0).to_pylist()
            data, at = utf8(batch.column(1))
            rows: list[tuple] = []
            for i, j in slices(at):
                ids, to = tok.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
                for k in range(j - i):
                    own = np.concatenate((ids[to[k] : to[k + 1]], end))
                    for p in range(0, len(own), capacity):
                        part = own[p : p + capacity]
                        rows.append((doc[i + k], p // capacity, p, len(part), zlib.crc32(part), *([part.tobytes()] if with_ids else [])))
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return bounded(narrow).mapInArrow(pieces, PIECES + (", ids binary" if with_ids else ""))


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-two-fit over a histogram {length: pieces}: a list of (how many bins, {length: pieces in each such bin}).

    A bin takes the longest piece that still fits, again and again. Then its shortest piece gives way to the two unpacked
    pieces that fill the gap with it best, if they fill more. A bin is repeated as often as its lengths last: with the same
    choice of lengths the next bins would come out alike.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left)
    bins: list[tuple[int, dict[int, int]]] = []
    while lengths:
        gap, used = capacity, {}
        at = len(lengths)
        while gap > 0:
            at = bisect.bisect_right(lengths, gap, 0, at) - 1
            while at >= 0 and used.get(lengths[at], 0) >= left[lengths[at]]:
                at -= 1
            if at < 0:
                break
            k = lengths[at]
            n = min(left[k] - used.get(k, 0), gap // k)
            used[k] = used.get(k, 0) + n
            gap -= n * k
            at += 1
        small = min(used)
        if gap > 0 and sum(used.values()) > 1:
            pair = _best_pair(lengths, left, used, small, small + gap)
            if pair:
                used[small] -= 1
                for k in pair:
                    used[k] = used.get(k, 0) + 1
                used = {k: n for k, n in used.items() if n}
        times = min(left[k] // n for k, n in used.items())
        bins.append((times, used))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
                lengths.pop(bisect.bisect_left(lengths, k))
    return bins


def _best_pair(lengths: list[int], left: dict[int, int], used: dict[int, int], small: int, room: int) -> tuple[int, int] | None:
    """Two unpacked lengths whose sum is over `small`, at most `room`, and as large as any; None if there are none."""
    free = lambda k: left[k] - used.get(k, 0)
    best, pair = small, None
    i, j = 0, bisect.bisect_right(lengths, room - 1) - 1
    while i <= j:
        a, b = lengths[i], lengths[j]
        if free(a) <= 0:
            i += 1
        elif free(b) <= 0 or a + b > room:
            j -= 1
        else:
            if a + b > best and (a != b or free(a) >= 2):
                best, pair = a + b, (a, b)
                if best == room:
                    break
            i += 1
    return pair


def _places(bins: list[tuple[int, dict[int, int]]]) -> np.ndarray:
    """Rows (length, first rank, sequences, pieces in each, first sequence, offset of the first piece), by length and rank."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, used in bins:
        offset = 0
        for k in sorted(used, reverse=True):
            n, r = used[k], rank.get(k, 0)
            rows.append((k, r, times, n, sequence, offset))
            rank[k] = r + times * n
            offset += n * k
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, *, capacity: int = 4096, rows_per_salt: int = 10_000) -> DataFrame:
    """pieces (with `length` and any other columns, stored and so stable) plus sequence_id and offset, gapless from 0.

    The histogram, at most `capacity` rows, is all that reaches the driver; the plan made of it is bounded likewise. Each length's
    pieces are dealt to one salt for each `rows_per_salt` of them, so no task ranks many more, however common a length is.
    """
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}
    spark = pieces.sparkSession
    # at most `capacity` rows; as an Arrow table, as rows of Python go through workers of their own, which stay beside the others
    salts = pa.table({"length": pa.array(histogram.keys(), pa.int64()), "_salts": pa.array([-(-n // rows_per_salt) for n in histogram.values()], pa.int64())})
    salts = F.broadcast(spark.createDataFrame(salts))
    salted = pieces.join(salts, "length").withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_salts"))).drop("_salts")
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    places = _places(plan_bins(histogram, capacity))
    shared = spark.sparkContext.broadcast(places)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        key = plan[:, 0] * (1 << 42) + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            row = plan[np.searchsorted(key, length * (1 << 42) + rank, "right") - 1] if len(length) else plan[:0]
            r = rank - row[:, 1]
            seq, off = row[:, 4] + r // np.maximum(row[:, 3], 1), row[:, 5] + r % np.maximum(row[:, 3], 1) * length
            kept = [c for c in batch.schema.names if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(seq), pa.array(off)], names=[*kept, "sequence_id", "offset"])

    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_r", F.row_number().over(inside)).join(starts, ["length", "_salt"])
    ranked = ranked.select(*pieces.columns, (F.col("_before") + F.col("_r") - 1).alias("_rank"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(placed, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, encode_special: bool = False) -> DataFrame:
    """Tokenise docs, cut longer ones, and place every piece. The pieces are stored first: their ranks must not change."""
    pieces = token_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col, with_ids=with_ids, encode_special=encode_special)
    return pack(stored(pieces), capacity=capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (array of int), doc_ids, offsets: the packed sequences of pieces with ids. A sequence is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    out = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return out.select("sequence_id", F.expr("transform(p, x -> x.doc_id)").alias("doc_ids"), F.expr("transform(p, x -> x.offset)").alias("offsets"), F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
