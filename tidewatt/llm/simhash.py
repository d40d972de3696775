"""SimHash near-duplicates: fingerprints over word shingles, and BK-trees that find the links.

Documents with equal fingerprints are one node. Two fingerprints within the radius agree in all but
``radius`` of the blocks that the 64 bits are cut into, so each is dealt to one shard for every choice of
blocks that may agree, and every link lies within some shard. The shard's BK-tree (children keyed by their
Hamming distance to the parent) is built once where the shard is read and serves all of its queries, which
follow only the edges within the radius. Shards that would outgrow a task are dealt as pairs of bounded
parts. A shard gives a spanning forest of its links, never all pairs.

Null texts count as empty; documents without words have fingerprint zero and link like any other. A null id
stays, and is a component's name only where there is no other. Repeated rows stay as they are. An empty
table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from .common import map_batches, small_batches, table, texts
from .components import components

BITS, SEED = 64, 42
#: Fingerprints of a shard that one tree holds; larger shards are dealt as pairs of parts of this size.
SHARD = 8_192
#: Fingerprints in small shards that are searched together, and queries that walk the trees at once.
TOGETHER, WALK = 32_768, 256


def fingerprint(text: str, words: int = 3) -> int:
    """Bits that are set in over half of the shingles' XXH64; repeats count. Only A-Z are lower-cased."""
    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(min(words, len(w)))), strict=False))
    hashes = (xxhash.xxh64_intdigest(s, SEED) for s in shingles)
    n, counts = 0, np.zeros(BITS, np.int64)
    while len(h := np.fromiter(itertools.islice(hashes, 65_536), np.uint64)):
        n += len(h)
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Add ``fp``, the fingerprint as a signed long."""
    return map_batches(docs, lambda b: [np.array([fingerprint(t, words) for t in texts(b)], np.uint64).view(np.int64)], [("fp", T.LongType())])


class BKForest:
    """One BK-tree for each group of values; the values of a group differ from one another."""

    def __init__(self, values: np.ndarray, group: np.ndarray, radius: int):
        self.values, self.radius = values, radius
        self.child = np.full((len(values), BITS + 1 + 2 * radius), -1, np.int32)  # by distance + radius
        order = np.argsort(group, kind="stable")
        first = np.r_[True, np.diff(group[order]) != 0][: len(order)]
        heads = order[first]
        self.root = np.empty(len(values), np.int32)  # of each value's own tree
        self.root[order] = heads[np.cumsum(first) - 1]
        at, owner = order[~first], self.root[order[~first]]
        while len(at):  # one level of all trees
            d = np.bitwise_count(values[at] ^ values[owner])
            order = np.lexsort((d, owner))
            at, owner, d = at[order], owner[order], d[order]
            first = np.r_[True, (np.diff(owner) != 0) | (np.diff(d) != 0)]
            heads = at[first]
            self.child[owner[first], d[first].astype(np.int64) + radius] = heads
            at, owner = at[~first], heads[np.cumsum(first) - 1][~first]

    def near(self, queries: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, value) within the radius, each query starting from its root."""
        q, node, found = np.arange(len(queries)), roots, []
        window = np.arange(2 * self.radius + 1)
        while len(q):
            d = np.bitwise_count(queries[q] ^ self.values[node])
            hit = d <= self.radius
            found.append((q[hit], node[hit]))
            below = self.child[node[:, None], d[:, None].astype(np.int64) + window]
            which, col = np.nonzero(below >= 0)
            q, node = q[which], below[which, col]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (q, q)


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, pairs: np.ndarray) -> None:
        for a, b in pairs.tolist():
            a, b = self.find(a), self.find(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.find(x) for x in range(len(self.up))], np.int64)


def small_groups(values: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """Position of each value's root, for many groups at once."""
    forest, union = BKForest(values, group, radius), Union(len(values))
    for at in range(0, len(values), 16 * WALK):
        q, v = forest.near(values[at : at + 16 * WALK], forest.root[at : at + 16 * WALK])
        union.join(np.stack([q[q + at < v] + at, v[q + at < v]], 1))
    return union.roots()


def large_group(values: np.ndarray, radius: int) -> np.ndarray:
    """Position of each value's root within one group. A value that was found leaves the tree's targets, so
    a dense ball of values costs little more than its size."""
    n = len(values)
    union, waiting = Union(n), []
    target = np.ones(n, bool)
    where = np.arange(n)
    forest = BKForest(values, np.zeros(n, np.int8), radius)
    while waiting or target.any():
        if waiting:
            take, waiting = np.array(waiting[:WALK]), waiting[WALK:]
        else:  # all that are linked to one value are found before the next begins
            take = target.argmax(keepdims=True)
            target[take] = False
        left = int(target.sum())
        if not left:
            continue
        if 2 * left < len(where):
            where = np.flatnonzero(target)
            forest = BKForest(values[where], np.zeros(left, np.int8), radius)
        q, v = forest.near(values[take], np.full(len(take), forest.root[0]))
        v = where[v]
        q, v = take[q[target[v]]], v[target[v]]
        target[v] = False
        new = np.unique(v)
        union.join(np.unique(np.stack([q, v], 1), axis=0))
        waiting += new.tolist()
    return union.roots()


def _forests(shards: DataFrame, radius: int) -> DataFrame:
    """Spanning forests ``a, b`` of the shards that ``table_no, key, part, other, fp`` lists in order."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        """Sorted distinct values of each shard or pair of parts."""
        held: list = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("table_no", "key", "part", "other")]
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            cut = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
            for a, z in itertools.pairwise([0, *cut.tolist(), len(fp)]):
                name = tuple(int(c[a]) for c in cols)
                if name != last and held:
                    yield np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
                    held = []
                last = name
                held.append(fp[a:z])
        if held:
            yield np.unique(np.concatenate(held)) if len(held) > 1 else held[0]

    def out(values: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
        linked = roots != np.arange(len(values))
        return pa.RecordBatch.from_arrays([pa.array(values[linked].view(np.int64)), pa.array(values[roots[linked]].view(np.int64))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for values in units(batches):
            if len(values) > 1_024:
                yield out(values, large_group(values, radius))
            elif len(values) > 1:
                held.append(values)
                size += len(values)
            if size >= TOGETHER:
                values, group = np.concatenate(held), np.repeat(np.arange(len(held)), [len(v) for v in held])
                held, size = [], 0
                yield out(values, small_groups(values, group, radius))
        if held:
            values, group = np.concatenate(held), np.repeat(np.arange(len(held)), [len(v) for v in held])
            yield out(values, small_groups(values, group, radius))

    return shards.mapInArrow(run, "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(nodes: int, radius: int) -> list[int]:
    """Which bits must agree, for each choice of blocks; more nodes get more blocks, and so longer keys."""
    blocks = radius + 1
    while blocks < 2 * radius + 2 and nodes > 64 << (BITS * (blocks - radius) // blocks):
        blocks += 1
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    part = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(part, blocks - radius)]


def near_links(nodes: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``a, b`` between the fingerprints of ``nodes(fp)``, enough to connect all that are within the radius."""
    n = nodes.count()
    keyed = nodes.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks(n, radius)))).alias("table_no", "key"))
    hot = scratch.written(keyed.groupBy("table_no", "key").count().where(F.col("count") > SHARD).select("table_no", "key", F.ceil(F.col("count") / SHARD).cast("int").alias("parts")), "hot-shards")
    parts = F.coalesce("parts", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), parts).cast("int")
    dealt = keyed.join(hot, ["table_no", "key"], "left").select("table_no", "key", "fp", mine.alias("mine"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("with"))
    dealt = dealt.select("table_no", "key", F.least("mine", "with").alias("part"), F.greatest("mine", "with").alias("other"), "fp")
    order = ["table_no", "key", "part", "other"]
    return _forests(dealt.repartition(*order).sortWithinPartitions(*order, "fp"), radius)


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest id that can be reached over links, for each row of ``docs``."""
    small_batches(docs.sparkSession)
    marked = scratch.written(with_fingerprints(docs.select("doc_id", "text"), words).drop("text"), "simhash")
    nodes = scratch.written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    labels = components(near_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = nodes.join(labels, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    names = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    named = scratch.written(linked.join(names, "label").select("fp", "component_id"), "simhash-named")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """Of each component of near-duplicates only the row with the smallest id; rows without an id stay."""
    groups = near_duplicates(docs, words, radius)
    drop = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti")
