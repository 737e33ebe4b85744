"""Exact Jaccard self-join of word-shingle sets by token-combination prefixes, and the groups that its links make.

Two sets of m and n shingles with Jaccard of at least t share ceil(t * (m + n) / (1 + t)) of them. If all shingles are
put in one order, rare before frequent, they share at least k among the first n - ceil(t * n) + k of each: its k-prefix.

1. Frequent shingles are found by counts over a million shingles at once (a heuristic: the order may be any, results never depend on it).
2. One pass makes each text's set, its 64-bit signature, its 3-prefix, three min-hashes and a bitmap with one bit for each class
   of shingles: whether the set holds an odd number of them. Two bitmaps differ in no more bits than the sets do in shingles,
   so they rule out nearly all pairs that do not link, before a pair is made. Texts with equal sets become one node.
3. The nodes are sorted by their min-hashes, in three orders, and compared with the node before. That joins groups of near copies
   with three comparisons for each copy, however large the group; the sort splits by range, so no group meets in one task.
4. Rare shingles are indexed singly: nodes that share a shingle of their 1-prefixes are a bucket. Only buckets that hold several
   groups matter, and of those of the same nodes the first. Small ones are compared wholly, larger ones first with those near in a few random orders.
5. Pairs are still open only between nodes of larger buckets that no links connect yet. They are listed, but in a bucket
   of over `bucket` nodes its shingle counts as frequent: the nodes are indexed by combinations of it with each later
   shingle of their 2-prefixes, and combinations that are still too frequent by three shingles of their 3-prefixes. A
   bucket whose combinations would make more pairs than it has, and what stays together after three, is listed as it is,
   so nothing is lost.
6. Candidate pairs are bounded by wider bitmaps and verified on the whole sets: the nearest one of each node first, then
   those whose ends are still in different groups.

Pairs inside a connected group are not all listed, but no two nodes that link end in different groups.

Nulls: a null text, or one without words, has an empty set and links with nothing. A null id is a document too; it never
gives a group its name unless all ids are null. Rows with equal ids are separate texts. With fewer than five words the
whole sequence is one shingle. Empty tables give no rows. Other columns are not read. Jobs run when `groups` is called: each
step is written to the shared folder and read by the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.llm.bytewords import mix, shingle_sets
from voxelspark.llm.shared import bounded, drop_stored, salted_join, stored
from voxelspark.operators.components import edge_components as components

#: Sets with a Jaccard of 0.8 that differ share four shingles at least, so combinations of three are always there.
LONGEST = 3
#: Random orders in which the nodes of a bucket are compared with those before them, and with how many.
ORDERS, NEAR = 4, 8
#: About how many nodes of a bucket are put in one such order.
STRETCH = 4096
#: Bound of the shingles that are put last as frequent (16 bytes each). Those beyond it are ordered as rare ones are.
MOST_FREQUENT = 1 << 19
#: Shingles among which frequent ones are counted at once, however small the batches are.
COUNTED = 1 << 20
_FILTER = 22
#: Min-hashes of a set, and longs of its small bitmap. The wide one has two bits for each shingle or more, and a power of two of longs.
MINS, BITS = 3, 4
_TURNS = np.array([1, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5], np.uint64)


def _ceil(percent: int, n):
    return -(-percent * n // 100)


def _common(n: int):
    """Counts of the shingles that several texts hold, among as many texts of a task as have `COUNTED` shingles."""

    def counts(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, count = np.unique(np.concatenate(sets), return_counts=True)
        often = count >= 3
        return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(count[often].astype(np.int64))], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), n):
                sets.append(s)
                held += len(s)
                if held >= COUNTED:
                    yield counts(sets)
                    sets, held = [], 0
        if sets:
            yield counts(sets)

    return run


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    lengths = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _bitmap(s: np.ndarray, longs: int) -> np.ndarray:
    """Whether the set has an odd number of shingles in each class, by their last bits. Halves of it make the one half as long by xor."""
    odd = np.bincount((s & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _signature(s: np.ndarray) -> int:
    return int(mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s))) if len(s) else 0


def _sketch(n: int, percent: int, shared):
    """doc_id, row, n, node (signature), prefix (the 3-prefix, rare shingles first), mins, bits, wide of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank = shared.value
        common = np.zeros(1 << _FILTER, bool)
        common[(keys >> np.uint64(64 - _FILTER)).astype(np.int64)] = True
        for batch in batches:
            size, node, prefix, mins, bits, wide = [], [], [], [], [], []
            for _, s in shingle_sets(batch.column(2), n):
                m = len(s)
                size.append(m)
                node.append(_signature(s))
                mins.append(np.array([(s * k).min() for k in _TURNS] if m else [0] * MINS, np.uint64).view(np.int64))
                wide.append(_bitmap(s, 1 << max(3, (m // 32).bit_length())))
                bits.append(np.bitwise_xor.reduce(wide[-1].reshape(-1, BITS)))
                most = min(m, m - _ceil(percent, m) + LONGEST)
                frequent = common[(s >> np.uint64(64 - _FILTER)).astype(np.int64)]
                if frequent.any():
                    at = np.searchsorted(keys, s)
                    at[at == len(keys)] = 0
                    frequent = keys[at] == s
                    last = s[frequent][np.argsort(rank[at[frequent]], kind="stable")]
                    s = np.concatenate((s[~frequent][:most], last))
                prefix.append(s[:most].view(np.int64))
            made = [pa.array(size, pa.int64()), pa.array(np.array(node, np.uint64).view(np.int64)), *(_lists(x) for x in (prefix, mins, bits, wide))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "row", "n", "node", "prefix", "mins", "bits", "wide"])

    return run


def _adjacent(percent: int):
    """Pairs (a < b) of neighbours in the order of the rows that share their first key and that sizes and bitmaps allow to link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, n = (batch.column(k).to_numpy() for k in range(3))
            bits = batch.column(3).flatten().to_numpy().view(np.uint64).reshape(-1, BITS)
            now = key, node, n, bits
            if last is not None:
                now = tuple(np.concatenate((x[-1:], y)) for x, y in zip(last, now, strict=True))
            key, node, n, bits = last = now
            far, total = np.bitwise_count(bits[1:] ^ bits[:-1]).sum(axis=1, dtype=np.int64), n[1:] + n[:-1]
            near = (key[1:] == key[:-1]) & (100 * np.minimum(n[1:], n[:-1]) >= percent * np.maximum(n[1:], n[:-1])) & ((100 + percent) * (total - far) >= 2 * percent * total)
            a, b = node[:-1][near], node[1:][near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def _sets(n: int):
    """node, shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                sets = [s for _, s in shingle_sets(batch.column(0).slice(k, 500), n)]
                node = np.array([_signature(s) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), _lists([s.view(np.int64) for s in sets])], names=["node", "shingles"])

    return run


class JaccardJoin:
    """The join over one table of texts."""

    def __init__(self, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, bucket: int = 128):
        self.docs = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        # what tells rows apart, as ids may be null or repeated
        self.rows = self.docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
        self.n, self.percent, self.bucket = n, percent, bucket

    def sketches(self) -> DataFrame:
        table = often = stored(self.docs.select("text").mapInArrow(_common(self.n), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 8"))
        # the most frequent by powers of two, as many as fit the bound of the broadcast
        power = F.floor(F.log2("n"))
        fit, least = 0, 64
        for p, count in sorted(often.groupBy(power.alias("p")).count().collect(), reverse=True):
            fit += count
            if fit > MOST_FREQUENT:
                break
            least = p
        often = often.where(power >= least).toArrow()
        keys, count = often.column("token").to_numpy().view(np.uint64), often.column("n").to_numpy()
        order = np.argsort(keys)
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((keys, count))] = np.arange(len(keys))
        shared = self.docs.sparkSession.sparkContext.broadcast((keys[order], rank[order]))
        drop_stored(table)
        return stored(self.rows.mapInArrow(_sketch(self.n, self.percent, shared), "doc_id long, row long, n long, node long, prefix array<long>, mins array<long>, bits array<long>, wide array<long>"))

    def _adjacent_pairs(self, nodes: DataFrame) -> DataFrame:
        """Pairs of nodes that share a min-hash and are next to each other in one of the orders by min-hashes."""
        out = None
        for r in range(MINS):
            keys = [F.col("mins")[(r + k) % MINS].alias(f"k{k}") for k in range(MINS)]
            by = [*(f"k{k}" for k in range(MINS)), "node"]
            ordered = nodes.select(*keys, "node", "n", "bits").repartitionByRange(*by).sortWithinPartitions(*by)
            pairs = ordered.select("k0", "node", "n", "bits").mapInArrow(_adjacent(self.percent), "a long, b long")
            out = pairs if out is None else out.union(pairs)
        return out.distinct()

    def _linked(self, pairs: DataFrame, nodes: DataFrame, labels: DataFrame | None = None) -> DataFrame:
        """id, label of the groups that the pairs that link make, with the groups that are known already.

        Wide bitmaps rule out most that do not. The nearest pair of each node goes first; of the others only those still apart.
        """
        pairs = stored(pairs)
        held = self._of(pairs.select(F.explode(F.array("a", "b")).alias("node")), nodes.select("node", "n", "wide"))
        a, b = (held.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("wide").alias(f"w_{x}")) for x in "ab")
        far, total = self._far("w_a", "w_b"), F.col("n_a") + F.col("n_b")
        near = pairs.join(a, "a").join(b, "b").where(self._sized(F.least("n_a", "n_b"), F.greatest("n_a", "n_b"))).withColumn("far", far)
        near = stored(near.where((100 + self.percent) * (total - F.col("far")) >= 2 * self.percent * total).select("a", "b", (F.col("far") / total).alias("far")))
        drop_stored(pairs, held)
        best = near.select(F.explode(F.array("a", "b")).alias("node"), F.struct("far", "a", "b").alias("p")).groupBy("node").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct()
        labels = self._merged(labels, self._verified(best, nodes))
        of = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"l_{x}"))
        rest = near.join(best, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("l_a", "a") != F.coalesce("l_b", "b")).select("a", "b")
        rest = stored(rest)
        if rest.limit(1).count():
            labels = self._merged(labels, self._verified(rest, nodes))
        drop_stored(near, rest)
        return labels

    def _of(self, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
        """The rows of `nodes` for the nodes wanted. Their ids are stored first, so Spark knows if they are few, and need not shuffle all nodes."""
        ids = stored(wanted.distinct())
        out = stored(nodes.join(ids, "node", "left_semi"))
        drop_stored(ids)
        return out

    def _merged(self, labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """id, label with more links: they are followed from group to group, not from node to node again."""
        if labels is None:
            return components(links)
        of = lambda x: labels.select(F.col("id").alias(x), F.col("label").alias(f"l_{x}"))
        between = stored(links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b")).where("a <> b"))
        if not between.limit(1).count():
            return labels
        to = components(between)
        moved = labels.join(to.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        merged = stored(moved.union(to.join(labels, "id", "left_anti").select("id", "label")))
        drop_stored(between)
        return merged

    def _verified(self, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The pairs that link, by their whole sets. Only the text of one row for each node in some pair is read to the join."""
        pairs = stored(pairs)
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = stored(nodes.select("node", "row").join(ends, "node").select("row"))
        texts = self.rows.join(wanted, "row", "left_semi").select("text")
        # both sides of the join read the same exchange by node
        sets = texts.mapInArrow(_sets(self.n), "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))
        a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        common = F.size(F.array_intersect("sa", "sb"))
        links = stored(pairs.join(a, "a").join(b, "b").where(100 * common >= self.percent * (F.size("sa") + F.size("sb") - common)).select("a", "b"))
        drop_stored(pairs, wanted)
        return links

    def _near(self, a: str, b: str):
        """Whether the bitmaps of two sets (columns bits_a, n_a ... by the prefixes given) allow them to link."""
        total = F.col(f"{a}n") + F.col(f"{b}n")
        far = sum((F.bit_count(F.col(f"{a}bits")[k].bitwiseXOR(F.col(f"{b}bits")[k])) for k in range(1, BITS)), F.bit_count(F.col(f"{a}bits")[0].bitwiseXOR(F.col(f"{b}bits")[0])))
        return (100 + self.percent) * (total - far) >= 2 * self.percent * total

    def _far(self, a: str, b: str):
        """In how many bits two wide bitmaps differ. Sizes that may link differ by less than two, so one is at most twice as long."""
        half = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (x, y) -> x ^ y), {0})"
        return F.expr(f"aggregate(zip_with({half.format(a, b)}, {half.format(b, a)}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")

    def _sized(self, small, large):
        return 100 * small >= self.percent * large

    def _room(self, n, pos, n2, pos2, k: int = 1):
        """Whether enough shingles can be common if the k-th common one stands at these positions (from 0) of both orders."""
        return (100 + self.percent) * (F.least(n - pos, n2 - pos2) + k - 1) >= self.percent * (n + n2)

    def _labelled(self, posts: DataFrame, nodes: DataFrame, labels: DataFrame, over: int) -> DataFrame:
        """token, size, node, n, pos, label, bits, wide: the posts of buckets of more than `over` nodes, of several groups.

        wide has a bit for each shingle or more, null for sets of which the small bitmap has as many.
        """
        named = posts.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        wide = F.expr(f"if(n < {64 * BITS}, null, zip_with(slice(wide, 1, size(wide) div 2), slice(wide, size(wide) div 2 + 1, size(wide) div 2), (x, y) -> x ^ y))").alias("wide")
        return stored(named.join(self._open(named, "token").where(F.col("size") > over), "token").join(nodes.select("node", "n", "bits", wide), "node"))

    def _open(self, named: DataFrame, *keys: str) -> DataFrame:
        """keys, size of the buckets that hold nodes of several groups; of buckets of the same nodes only the first, as two nodes' pair belongs to the first they share.

        All but the last key are common to buckets of the same nodes. These are told by two 64-bit sums of their signatures, beside their
        number and groups.
        """
        alike = F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y")
        of = named.groupBy(*keys).agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("pos").alias("pos"), *alike).where("lo <> hi")
        first = of.groupBy(*keys[:-1], "size", "lo", "hi", "x", "y").agg(F.min(F.struct("pos", keys[-1])).alias("t"))
        return first.select(*keys[:-1], f"t.{keys[-1]}", "size")

    def _listed(self, live: DataFrame, k: int = 1) -> DataFrame:
        """All pairs of unconnected nodes of each bucket that sizes, places and bitmaps allow to link."""
        a, b = (live.select("token", *(F.col(c).alias(f"{x}_{c}") for c in ("node", "n", "label", "pos", "bits", "wide"))) for x in "ab")
        first = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_node") < F.col("b_node")))
        can = first & (F.col("a_label") != F.col("b_label")) & self._sized(F.col("a_n"), F.col("b_n")) & self._room(F.col("a_n"), F.col("a_pos"), F.col("b_n"), F.col("b_pos"), k)
        # the small bitmap says nothing of long sets
        total = F.col("a_n") + F.col("b_n")
        wide = F.col("a_wide").isNull() | F.col("b_wide").isNull() | ((100 + self.percent) * (total - self._far("a_wide", "b_wide")) >= 2 * self.percent * total)
        pairs = a.join(b.withColumnRenamed("token", "b_token"), (F.col("token") == F.col("b_token")) & can & self._near("a_", "b_") & wide)
        return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))

    def _neighbours(self, live: DataFrame) -> DataFrame:
        """All unconnected pairs of small buckets, and of larger ones up to two for each node with those near it in a random order."""
        # a random order may be cut at random: a large bucket is dealt to several tasks
        turn = F.pmod("token", F.lit(ORDERS))
        part = F.pmod(F.xxhash64(turn, "node"), F.ceil(F.col("size") / STRETCH))
        order = Window.partitionBy("token", part).orderBy(F.xxhash64("node", turn), "node").rowsBetween(-NEAR, -1)
        near = live.where(F.col("size") > 2 * NEAR).withColumn("before", F.collect_list(F.struct("node", "n", "label", "pos", "bits")).over(order))
        total = "(o.n + n)"
        far = " + ".join(f"bit_count(o.bits[{k}] ^ bits[{k}])" for k in range(BITS))
        can = f"o.label <> label and 100 * least(n, o.n) >= {self.percent} * greatest(n, o.n) and {100 + self.percent} * least(n - pos, o.n - o.pos) >= {self.percent} * {total} and {100 + self.percent} * ({total} - ({far})) >= {2 * self.percent} * {total}"
        near = near.select("node", F.explode(F.expr(f"slice(transform(filter(before, o -> {can}), o -> o.node), 1, 2)")).alias("o"))
        near = near.select(F.least("node", "o").alias("a"), F.greatest("node", "o").alias("b"))
        return near.union(self._listed(live.where(F.col("size") <= 2 * NEAR))).distinct()

    def _open_pairs(self, live: DataFrame, nodes: DataFrame) -> DataFrame:
        """All pairs of nodes in one bucket that no links connect."""
        out = None
        for k in range(1, LONGEST + 1):
            large, listed = live.where(F.col("size") > self.bucket), live.where(F.col("size") <= self.bucket)
            if k == LONGEST or not large.limit(1).count():
                listed, large = live, None
            else:
                held = self._of(large.select("node"), nodes.select("node", "prefix"))
                longer = large.withColumnRenamed("token", "parent").join(held, "node")
                end = F.least(F.size("prefix"), (F.col("n") - F.ceil(F.col("n") * self.percent / 100)).cast("int") + k + 1)
                first = F.col("pos").alias("pos1")
                later = longer.select("parent", "node", "n", "label", "bits", "wide", first, F.posexplode(F.slice("prefix", 1, end)).alias("pos", "token")).where("pos > pos1").drop("pos1")
                # a dense bucket, whose nodes share many shingles, makes more pairs by combinations than without; counts tell before any is made
                split = stored(self._open(later, "parent", "token"))
                cost = split.groupBy(F.col("parent").alias("token")).agg(F.sum(F.col("size") * F.col("size")).alias("cost"))
                plain = stored(large.select("token", "size").distinct().join(cost, "token", "left").where(F.coalesce("cost", F.lit(0)) >= F.col("size") * F.col("size")).select("token"))
                listed = listed.unionByName(large.join(plain, "token", "left_semi"))
                finer = split.join(plain.withColumnRenamed("token", "parent"), "parent", "left_anti")
                large = stored(later.join(finer, ["parent", "token"]).withColumn("token", F.xxhash64("parent", "token")).drop("parent"))
                drop_stored(split, held)
            pairs = self._listed(listed, k)
            out = pairs if out is None else out.union(pairs)
            if large is None:
                break
            live = large
        return out.distinct()

    def groups(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every row: the least id that links reach, and its own without any."""
        sketches = self.sketches()
        some = sketches.where("n > 0")
        nodes = stored(some.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), *(F.first(c).alias(c) for c in ("n", "prefix", "mins", "bits", "wide"))))
        # sketches take half as much as the texts; of each row only its node is still asked for
        rows = stored(sketches.select("doc_id", "n", "node"))
        drop_stored(sketches)
        labels = self._linked(self._adjacent_pairs(nodes), nodes)
        first = F.slice("prefix", 1, F.least(F.size("prefix"), (F.col("n") - F.ceil(F.col("n") * self.percent / 100)).cast("int") + 1))
        tokens = nodes.select("node", F.posexplode(first).alias("pos", "token"))
        sizes = stored(tokens.groupBy("token").agg(F.count("*").alias("size")).where("size > 1"))
        n_posts = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        posts = stored(salted_join(tokens, sizes, ["token"], F.col("node"), "size", n_posts))
        drop_stored(sizes)
        # small buckets are listed wholly by the first
        for over, pairs in ((1, self._neighbours), (2 * NEAR, lambda live: self._open_pairs(live, nodes))):
            live = self._labelled(posts, nodes, labels, over)
            if live.limit(1).count():
                labels = self._linked(pairs(live), nodes, labels)
            drop_stored(live)
        drop_stored(posts)
        named = nodes.select("node", "doc_id").join(labels, nodes["node"] == labels["id"], "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
        names = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        named = stored(named.join(names, "label").select("node", "component_id"))
        drop_stored(nodes)
        out = rows.join(named, "node", "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_groups(docs: DataFrame, **options) -> DataFrame:
    return JaccardJoin(docs, **options).groups()
