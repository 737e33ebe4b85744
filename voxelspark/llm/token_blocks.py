"""Token ids as files of patched frame-of-reference blocks, written and read as a Spark data source.

Ids are cut into blocks of `block` ids, across documents. A block holds its least id, and what each id has above it in `width` bits:
as many as the `percentile` of them need. What the others have beyond that width stands in an exception list (place, high bits). A
shard ends in its index: where every block starts, the ids and lengths of its documents, and in a fixed trailer where the index
itself starts. So a reader that wants some documents seeks to the blocks that hold them.

Spark deals the documents to shards by ranges of doc_id and sorts within them; the tokens of a text never stand in more than one
task. Each task streams its shard into a file of its own name (a retried or speculative task writes another one), and the commit
writes the manifest: the files of the tasks that count, in order, with their sizes and places to split them. A reader knows only files that the
manifest names, so an executor lost at any time does no harm. Places in the whole stream come from the sizes in the manifest.

Nulls: a null text is empty and has its end id alone; null ids come first. Rows that share an id are documents of their own, in the order
of a hash of their texts, so they spread over shards; rows alike in both go to one shard, which a task streams, never gathers. An
empty table gives a manifest without files, which reads as no rows. Columns other than id and text are not read. The path must be
one that all machines reach (file:, hdfs:, s3: as pyarrow knows them).
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from voxelspark.llm.bytewords import slices, utf8
from voxelspark.llm.packing import CachedTokenizer
from voxelspark.llm.shared import bounded

MAGIC = b"PFORIDS1"
_BLOCK = struct.Struct("<IIIB")  # ids, exceptions, least id, width
_TRAILER = struct.Struct("<QQQQ8s")  # index offset, blocks, documents, documents without an id, magic
MANIFEST = "manifest.json"
_OUT = 1 << 22


def encode_block(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    """One block of uint32 ids."""
    least = int(ids.min())
    above = (ids - np.uint32(least)).astype("<u4")
    # the value below which the percentile lies, as one of the values
    width = int(np.partition(above, k := min(len(above) - 1, int(len(above) * percentile / 100)))[k]).bit_length()
    bits = np.unpackbits(above.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    place = np.flatnonzero(above >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    high = above[place] >> np.uint32(min(width, 31))
    return b"".join((_BLOCK.pack(len(ids), len(place), least, width), np.packbits(bits, bitorder="little").tobytes(), place.astype("<u4").tobytes(), high.astype("<u4").tobytes()))


def decode_block(data: bytes) -> np.ndarray:
    n, exceptions, least, width = _BLOCK.unpack_from(data)
    at = _BLOCK.size
    packed = np.frombuffer(data, np.uint8, -(-n * width // 8), at)
    bits = np.zeros((n, 32), np.uint8)
    bits[:, :width] = np.unpackbits(packed, count=n * width, bitorder="little").reshape(n, width)
    above = np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1).astype(np.uint32)
    at += len(packed)
    if exceptions:
        place, high = (np.frombuffer(data, "<u4", exceptions, at + 4 * exceptions * i) for i in range(2))
        above[place] |= high << np.uint32(width)
    return above + np.uint32(least)


class ShardWriter:
    """Streams documents into an open binary file; holds one block of ids and two numbers for each document."""

    def __init__(self, out, block: int = 1 << 14, percentile: float = 90.0, split: int = 1 << 22):
        self.out, self.block, self.percentile, self.split = out, block, percentile, split
        self.at, self.starts, self.docs, self.lengths, self.nulls = 0, [], [], [], 0
        self.pending: list[np.ndarray] = []
        self.waiting, self.total = 0, 0
        self.splits: list[tuple[int, int]] = [(0, 0)]  # (first document, ids before it)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.total - self.splits[-1][1] >= self.split:
            self.splits.append((len(self.docs), self.total))
        self.nulls += doc_id is None
        self.docs.append(doc_id or 0)
        self.lengths.append(len(ids))
        self.total += len(ids)
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            flat = np.concatenate(self.pending)
            whole = len(flat) // self.block * self.block
            for i in range(0, whole, self.block):
                self._put(encode_block(flat[i : i + self.block], self.percentile))
            self.pending, self.waiting = [flat[whole:].copy()], len(flat) - whole

    def _put(self, data: bytes) -> None:
        self.starts.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> dict:
        if self.waiting:
            self._put(encode_block(np.concatenate(self.pending), self.percentile))
        for numbers in (self.starts, self.docs, self.lengths):
            self.out.write(np.array(numbers, "<i8").tobytes())
        self.out.write(_TRAILER.pack(self.at, len(self.starts), len(self.docs), self.nulls, MAGIC))
        return {"documents": len(self.docs), "ids": self.total, "block": self.block, "splits": self.splits}


class ShardReader:
    """Reads documents of a shard by number, seeking to the blocks that hold them."""

    def __init__(self, source, block: int):
        self.source, self.block = source, block
        end = source.size()
        index, blocks, documents, self.nulls, magic = _TRAILER.unpack(self._bytes(end - _TRAILER.size, _TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token blocks")
        numbers = np.frombuffer(self._bytes(index, 8 * (blocks + 2 * documents)), "<i8")
        self.starts = np.append(numbers[:blocks], index)
        self.docs, self.lengths = numbers[blocks : blocks + documents], numbers[blocks + documents :]
        self.before = np.concatenate(([0], np.cumsum(self.lengths)))

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids at the places first to last - 1 of the shard."""
        a, b = first // self.block, -(-last // self.block)
        data = self._bytes(int(self.starts[a]), int(self.starts[b] - self.starts[a])) if b > a else b""
        cut = self.starts[a : b + 1] - self.starts[a]
        parts = [decode_block(data[cut[i] : cut[i + 1]]) for i in range(b - a)]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return flat[first - a * self.block : last - a * self.block]

    def documents(self, first: int, last: int, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the shard before it, its ids) of the documents first to last - 1; `at_once` ids or one document are held."""
        i = first
        while i < last:
            j = max(i + 1, min(last, int(np.searchsorted(self.before, self.before[i] + at_once, "right")) - 1))
            flat = self.ids(int(self.before[i]), int(self.before[j]))
            for k in range(i, j):
                a = int(self.before[k] - self.before[i])
                yield (int(self.docs[k]) if k >= self.nulls else None), int(self.before[k]), flat[a : a + int(self.lengths[k])]
            i = j


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class _Shard(WriterCommitMessage):
    partition: int
    facts: dict | None


@dataclass
class _Run(InputPartition):
    file: str
    block: int
    first: int
    last: int
    start: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.block, self.percentile = int(options.get("block", 1 << 14)), float(options.get("percentile", 90))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Shard:
        from pyspark import TaskContext

        partition = TaskContext.get().partitionId()
        store, root = _folder(self.path)
        shard, out, name = None, None, f"shard-{partition:05d}-{uuid.uuid4().hex}.pfor"
        for batch in iterator:
            docs = batch.column(0).to_pylist()
            for k, doc in enumerate(docs):
                if shard is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{name}")
                    shard = ShardWriter(out, self.block, self.percentile)
                shard.add(doc, np.frombuffer(batch.column(1)[k].as_buffer(), "<u4"))
        if shard is None:
            return _Shard(partition, None)
        facts = shard.close() | {"file": name}
        out.close()
        return _Shard(partition, facts)

    def commit(self, messages: list[_Shard | None]) -> None:
        store, root = _folder(self.path)
        store.create_dir(root, recursive=True)
        shards = [m.facts for m in sorted((m for m in messages if m is not None and m.facts), key=lambda m: m.partition)]
        with store.open_output_stream(f"{root}/{MANIFEST}.new") as f:
            f.write(json.dumps({"shards": shards}).encode())
        store.move(f"{root}/{MANIFEST}.new", f"{root}/{MANIFEST}")

    def abort(self, messages: list[_Shard | None]) -> None:
        store, root = _folder(self.path)
        for m in messages:
            if m is not None and m.facts:
                store.delete_file(f"{root}/{m.facts['file']}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[_Run]:
        store, root = _folder(self.path)
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            shards = json.loads(f.read())["shards"]
        runs, start = [], 0
        for s in shards:
            firsts = [d for d, _ in s["splits"]]
            runs += [_Run(s["file"], s["block"], a, b, start) for a, b in zip(firsts, [*firsts[1:], s["documents"]], strict=True)]
            start += s["ids"]
        return runs or [_Run("", 1, 0, 0, 0)]

    def read(self, run: _Run) -> Iterator[pa.RecordBatch]:
        if not run.file:
            return
        store, root = _folder(self.path)
        names, kinds = ["doc_id", "start", "ids"], (pa.int64(), pa.int64(), pa.binary())
        with store.open_input_file(f"{root}/{run.file}") as f:
            rows, held = [], 0
            for doc, before, ids in ShardReader(f, run.block).documents(run.first, run.last):
                rows.append((doc, run.start + before, ids.astype("<u4").tobytes()))
                held += len(rows[-1][2])
                if held >= _OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class TokenBlocks(DataSource):
    """`token_blocks`: rows doc_id, ids (little-endian uint32) in the order of their partitions; read back with `start`."""

    @classmethod
    def name(cls) -> str:
        return "token_blocks"

    def schema(self) -> str:
        return "doc_id long, start long, ids binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def token_ids(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2) -> DataFrame:
    """doc_id, ids of (doc_id, text), row by row: the ids of the text and the end id, as little-endian uint32."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = CachedTokenizer.of(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            data, at = utf8(batch.column(1))
            for i, j in slices(at):
                ids, to = tok.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
                own = [ids[to[k] : to[k + 1]].astype("<u4", copy=False).tobytes() + end for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(own, pa.binary())], names=["doc_id", "ids"])

    return bounded(docs).mapInArrow(encode, "doc_id long, ids binary")


def write(docs: DataFrame, tokenizer_path: str, path: str, *, end_id: int = 2, block: int = 1 << 14, percentile: float = 90.0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenise docs and write them to `path` in ascending doc_id order."""
    docs.sparkSession.dataSource.register(TokenBlocks)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    token_ids(ranged, tokenizer_path, end_id=end_id).write.format("token_blocks").option("block", block).option("percentile", percentile).mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it), ids of all documents that `write` put there."""
    spark.dataSource.register(TokenBlocks)
    return spark.read.format("token_blocks").load(path)
