"""SimHash near-duplicates of a given Jaccard similarity of their sets of five-word shingles.

Fingerprints of similar texts differ in up to ``RADIUS`` bits, far more than blocks of agreeing bits could deal to shards.
So a shard of fingerprints is what agrees in all ``DEEP`` minima of one of ``BANDS`` bands of minimum hashes; a pair of
similarity s shares none with probability (1 - s^5)^40, 1.3e-7 at 0.8 and less above. The shard's BK-tree finds
the candidates within the radius, and they are compared exactly by their whole sets of 64-bit shingle hashes, so no pair
below the similarity is linked. Shards with the same members are searched once; shards that would outgrow a task are
dealt as pairs of bounded parts.

Documents of equal sets are one node. A text of fewer words than a shingle is one shingle; texts without words are
equal. Only A-Z are lower-cased. Rows without an id stay and link nothing; of rows that share an id all stay if one
does. An empty table gives an empty result. Further columns stay.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from .common import map_batches, small_batches, texts
from .components import components
from .simhash import BKForest, Union, fingerprint
from .substrings import rolled, word_hashes

WORDS, BANDS, DEEP, SEED = 5, 40, 5, 42
#: Linked are pairs with at least NUMER / DENOM of their union in common.
NUMER, DENOM = 4, 5
#: Bits that fingerprints of similar texts may differ in; 17 is the most among the pairs of the test tables.
RADIUS = 24
#: Sets of a shard that one tree holds; larger shards are dealt as pairs of parts of this size.
PART = 2_048
#: Sets of a shard that is searched with others, and of those that are searched together.
SMALL, TOGETHER = 64, 8_192
_random = np.random.default_rng(SEED)
_FACTOR = _random.integers(0, 1 << 64, BANDS * DEEP, np.uint64) | np.uint64(1)
_ADDED = _random.integers(0, 1 << 64, BANDS * DEEP, np.uint64)


def shingles(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; null counts as empty."""
    hashes, at = word_hashes(pc.ascii_lower(pc.fill_null(column, "")))
    h = (hashes[a:z] for a, z in itertools.pairwise(at.tolist()))
    return [np.unique(rolled(x, WORDS) if len(x) >= WORDS else rolled(x, len(x), len(x))) if len(x) else x for x in h]


def band_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """One key for each band of each set; none of an empty set."""
    full = [s for s in sets if len(s)]
    least = np.empty((len(full), BANDS * DEEP), np.uint64)
    for row, s in zip(least, full, strict=True):
        row[:] = np.min([(s[a : a + 1_024, None] * _FACTOR + _ADDED).min(0) for a in range(0, len(s), 1_024)], axis=0)
    bands = least.reshape(len(full), BANDS, DEEP).transpose(2, 0, 1)
    keys = iter(rolled(np.concatenate([np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[1:])[None], bands]), DEEP + 1)[0])
    return [next(keys) if len(s) else s for s in sets]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _signed(b: pa.RecordBatch) -> list:
    sets = shingles(b.column("text"))
    names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
    prints = np.array([fingerprint(t, WORDS) for t in texts(b)], np.uint64).view(np.int64)
    return [names, prints, _lists(band_keys(sets))]


def _body(b: pa.RecordBatch) -> list:
    """Whether a text has the set it is taken for, which rows that share an id need not, and the set."""
    sets = shingles(b.column("text"))
    names = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
    return [names == b.column("set").to_numpy(), _lists(sets)]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(a) + len(b) - len(np.union1d(a, b))
    return DENOM * common >= NUMER * (len(a) + len(b) - common)


def small_groups(sets: list[np.ndarray], prints: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Pairs of positions that connect what is similar within each of many small groups."""
    forest, union, pairs = BKForest(prints, group, RADIUS), Union(len(sets)), []
    for at in range(0, len(sets), 1_024):
        q, v = forest.near(prints[at : at + 1_024], forest.root[at : at + 1_024])
        for i, j in zip((q[q + at < v] + at).tolist(), v[q + at < v].tolist(), strict=True):
            if union.find(i) != union.find(j) and similar(sets[i], sets[j]):
                pairs.append((i, j))
                union.join(np.array([(i, j)]))
    return np.array(pairs, np.int64).reshape(-1, 2)


def linked(sets: list[np.ndarray], prints: np.ndarray) -> np.ndarray:
    """The same within one large group. A set that was found leaves the targets and waits as a query, so a group of
    near copies costs little more than its size."""
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    own = np.split(flat, np.cumsum(size)[:-1])
    mark = np.zeros(flat.max() + 1, np.int32)
    values, of = np.unique(prints, return_inverse=True)  # one node of the tree for equal fingerprints
    members = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])
    forest, target = BKForest(values, np.zeros(len(values), np.int8), RADIUS), np.ones(len(sets), bool)
    waiting, pairs = [], []
    while waiting or target.any():
        if waiting:
            q = waiting.pop()
        else:  # all that are linked to one set are found before the next begins
            q = int(target.argmax())
            target[q] = False
        near = np.concatenate([members[v] for v in forest.near(prints[[q]], forest.root[:1])[1]])
        near = near[target[near]]
        if not len(near):
            continue
        mark[own[q]] = 1
        common = np.add.reduceat(mark[np.concatenate([own[i] for i in near])], np.r_[0, np.cumsum(size[near])[:-1]])
        mark[own[q]] = 0
        found = near[DENOM * common >= NUMER * (size[near] + size[q] - common)]
        target[found] = False
        pairs += [(q, i) for i in found.tolist()]
        waiting += found.tolist()
    return np.array(pairs, np.int64).reshape(-1, 2)


def _forests(members: DataFrame) -> DataFrame:
    """Links ``a, b`` within the shards that ``key, part, other, set, fp, shingles`` lists in order."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
        last, held = None, {}
        for b in batches:
            names = zip(*(b.column(c).to_pylist() for c in ("key", "part", "other", "set", "fp")), strict=True)
            for i, (*name, node, fp) in enumerate(names):
                if name != last:
                    yield list(held), [f for f, _ in held.values()], [s for _, s in held.values()]
                    last, held = name, {}
                held[node] = fp, b.column("shingles")[i].values.to_numpy().view(np.uint64)
        yield list(held), [f for f, _ in held.values()], [s for _, s in held.values()]

    def out(nodes: list[int], pairs: np.ndarray) -> pa.RecordBatch:
        found = np.array(nodes, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[pairs[:, 0]]), pa.array(found[pairs[:, 1]])], names=["a", "b"])

    def unsigned(prints: list[int]) -> np.ndarray:
        return np.array(prints, np.int64).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, prints, sets, group = [], [], [], []
        for more_nodes, more_prints, more_sets in units(batches):
            if len(more_nodes) > SMALL:
                yield out(more_nodes, linked(more_sets, unsigned(more_prints)))
            elif len(more_nodes) > 1:
                group += [group[-1] + 1 if group else 0] * len(more_nodes)
                nodes, prints, sets = nodes + more_nodes, prints + more_prints, sets + more_sets
            if len(nodes) >= TOGETHER:
                yield out(nodes, small_groups(sets, unsigned(prints), np.array(group)))
                nodes, prints, sets, group = [], [], [], []
        if nodes:
            yield out(nodes, small_groups(sets, unsigned(prints), np.array(group)))

    return members.mapInArrow(run, "a long, b long")


def near_links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the sets of ``nodes(set, first, fp, keys)``, each set once, enough to connect all candidates that are
    similar, as a written table. Only sets that share a shard are taken again from the texts of ``rows``. Joins with texts and
    sets are hashed by partition at every size, so the plan of a small table is that of a large one."""
    keyed = nodes.select("set", F.explode("keys").alias("key")).repartition("key")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("set")).alias("same")).where("n > 1")
    buckets = scratch.written(shared.groupBy("n", "same").agg(F.min("key").alias("key")), "similar-buckets")
    members = scratch.written(keyed.join(buckets.select("key", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "key"), "similar-members")
    first = scratch.written(members.select("set").distinct().join(nodes.select("set", "fp", F.col("first").alias("doc_id")), "set"), "similar-first")
    made = map_batches(rows.join(first.hint("shuffle_hash"), "doc_id"), _body, [("own", T.BooleanType()), ("shingles", T.ArrayType(T.LongType()))], keep=["set", "fp"])
    bodies = scratch.written(made.where("own").drop("own"), "similar-bodies")
    mine, last = F.pmod(F.xxhash64("set"), "parts").cast("int"), F.col("parts") - 1
    dealt = members.select("key", "set", mine.alias("mine"), F.explode(F.sequence(F.lit(0), last)).alias("with"))
    dealt = dealt.select("key", F.least("mine", "with").alias("part"), F.greatest("mine", "with").alias("other"), "set").hint("shuffle_hash").join(bodies, "set")
    order = ["key", "part", "other"]
    links = scratch.written(_forests(dealt.select(*order, "set", "fp", "shingles").repartition(*order).sortWithinPartitions(*order)), "similar-links")
    for done in (buckets, members, first, bodies):
        scratch.discard(done)
    return links


def first_ids(docs: DataFrame) -> DataFrame:
    """``doc_id``: the smallest id of each component of similar documents."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    fields = [("set", T.LongType()), ("fp", T.LongType()), ("keys", T.ArrayType(T.LongType()))]
    marked = map_batches(rows, _signed, fields, keep=["doc_id"])
    nodes = marked.groupBy("set").agg(F.min(F.struct("doc_id", "fp", "keys")).alias("node"))
    nodes = scratch.written(nodes.select("set", F.col("node.doc_id").alias("first"), "node.fp", "node.keys"), "similar-nodes")
    labels = components(near_links(rows, nodes)).withColumnRenamed("node", "set")
    named = nodes.select("set", "first").join(labels, "set", "left").groupBy(F.coalesce("label", "set").alias("label")).agg(F.min("first").alias("doc_id"))
    found = scratch.written(named.select("doc_id").distinct(), "similar-firsts")
    scratch.discard(nodes)
    return found


def keep_first(docs: DataFrame) -> DataFrame:
    """Of each component of similar documents only the row with the smallest id; rows without an id stay."""
    kept = docs.join(first_ids(docs).hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
