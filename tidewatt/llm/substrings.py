"""Substring deduplication with prefix-partitioned suffix trees over words.

A suffix matters by its first ``WINDOW`` words, its window. Suffixes are partitioned by prefixes of variable length.
The first are single grams of ``GRAM`` words: of the suffixes that share a window only those count that begin at its
smallest gram, with the words to the left that the window has before it, so that a prefix stands for a few windows.
Prefixes that only one document has are dropped, for nothing below them can repeat. Prefixes that more than ``GROUP``
documents share are lengthened: their windows are suffixes of their own, partitioned by their first ``LONGER`` words.
Where that prefix is still too common it is lengthened to the whole window: the partition is a single deep node, whose
smallest document is a minimum that is aggregated before it is shuffled, and told to that document alone. So no task
holds more than a bounded group, and nothing is joined within a group.

A partition's tree is built from the top: nodes are split by the next words, nodes with one suffix are cut off, and what
remains at depth ``WINDOW`` are the deep internal nodes. All but the smallest document's suffixes in them are repeats;
successive ones make up a maximal repeat, whose words are removed. Hashes only deal suffixes to tasks: within a
partition the words themselves are compared, so no two different words are ever taken for equal.

Words are runs of anything but ASCII white space. A null text has no words. Rows without an id neither remove nor lose
words, and rows that repeat an id are one document to each other. Of rows with equal texts only the smallest id's are
searched; the others are repeats as a whole. An empty table gives an empty result. ``deduplicated`` keeps all other
columns; the names it adds replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, small_batches, table

WINDOW, GRAM, LONGER = 13, 5, 9
_GRAMS = WINDOW - GRAM + 1  # of a window; its prefix starts at one of as many offsets
#: Documents of a prefix above which it is lengthened, and windows of the trees that are built together.
GROUP, TOGETHER = 8_192, 1 << 18
_MULTIPLIER, _KEY = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Lanes of eight bytes that a word is hashed by, and which bits of a lane are the word's.
_LANES, _MASK = 8, np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bits of a gram's hash that don't go into the shuffle. Prefixes that agree by chance share a task, no more.
_SPARE = np.uint64(16)
_IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@dataclass
class Words:
    """The words of a column of texts: the bytes where each begins and ends, and the word where each text begins."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray

    def codes(self) -> np.ndarray:
        """A number for each word, the same for the same bytes only."""
        # One array of words and what lies between them, over the bytes as they are; every second is a word.
        edges = np.empty(2 * len(self.starts), np.int32)
        edges[::2], edges[1::2] = self.starts, self.ends
        both = pa.Array.from_buffers(pa.binary(), max(0, len(edges) - 1), [None, pa.py_buffer(edges), pa.py_buffer(self.raw)])
        return both.dictionary_encode().indices.to_numpy()[::2].astype(np.int64)

    def hashes(self) -> np.ndarray:
        """A keyed hash of each word, eight bytes at a time; very long words are hashed by XXH64."""
        size = self.ends - self.starts
        eights = np.ndarray(len(self.raw), "<u8", self.raw + bytes(8), 0, (1,)) if self.raw else np.zeros(0, np.uint64)
        h = size.astype(np.uint64) * _MULTIPLIER ^ _KEY
        at, left, which = self.starts, size, slice(None)
        for _ in range(_LANES):
            x = eights[at] & _MASK[np.minimum(left, 8)]
            x = (h[which] ^ x) * _MULTIPLIER
            h[which] = x ^ x >> np.uint64(32)
            more = np.flatnonzero(left > 8)
            if not len(more):
                break
            which = more if isinstance(which, slice) else which[more]
            at, left = at[more] + 8, left[more] - 8
        for i in np.flatnonzero(size > 8 * _LANES).tolist():
            h[i] = xxhash.xxh64_intdigest(self.raw[self.starts[i] : self.ends[i]], int(_KEY))
        h *= _MULTIPLIER
        return h ^ h >> np.uint64(29)


def words_of(texts: pa.Array) -> Words:
    """Found for all texts at once, so that no word becomes an object."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = data[bounds[0] : bounds[-1]].to_pybytes() if data is not None else b""
    bounds = bounds - bounds[0]
    inside = np.zeros(len(raw) + 2, bool)  # with a stop before and after
    inside[1:-1] = _IN_WORD[np.frombuffer(raw, np.uint8)]
    cut = np.zeros(len(raw) + 1, bool)  # a text begins before this byte
    cut[bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return Words(raw, starts, ends, np.searchsorted(starts, bounds))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one array, and where each text's begin and end."""
    w = words_of(texts)
    return w.hashes(), w.at


def rolled(a: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of each ``n`` successive values."""
    h = np.full(max(0, len(a) - n + 1), seed, np.uint64)
    for j in range(n):
        h = (h ^ a[j : j + len(h)]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def smallest(g: np.ndarray) -> np.ndarray:
    """The smallest of each ``_GRAMS`` successive values."""
    m, width = g, 1
    while width < _GRAMS:
        step = min(width, _GRAMS - width)
        m, width = np.minimum(m[: max(0, len(m) - step)], m[step:]), width + step
    return m


def anchors(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gram hashes of a text's word hashes, and for each window the place of its smallest gram, the first of equals."""
    g = rolled(a, GRAM) >> _SPARE
    if len(a) < WINDOW:
        return g, np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(g, _GRAMS)
    return g, np.arange(len(windows)) + windows.argmin(1)


def _distinct(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, give or take pairs that meet in one hash."""
    for _ in range(2):
        new = np.r_[True, (np.diff(doc) != 0) | (np.diff(key) != 0)][: len(key)]
        key, doc = key[new], doc[new]
        order = np.argsort((key ^ doc.astype(np.uint64) << np.uint64(40)) * _MULTIPLIER)
        key, doc = key[order], doc[order]
    return key, doc


def _prefix_rows(docs: DataFrame, hot: str | None = None) -> DataFrame:
    """``prefix, doc_id`` for the distinct prefixes of each document: smallest grams, or, where ``hot`` is given, the
    first ``LONGER`` words of the windows whose smallest gram is among that column's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, at = word_hashes(b.column("text"))
            # All texts of the batch are one array; windows that run over a text's end are left out.
            key = smallest(rolled(hashes, GRAM) >> _SPARE)
            doc = np.repeat(np.arange(b.num_rows), np.diff(at))[: len(key)]
            inside = np.arange(len(key)) + WINDOW <= at[doc + 1]
            if hot:
                for i, w in enumerate(b.column(hot)):
                    mine = slice(at[i], min(at[i + 1], len(key)))
                    inside[mine] &= np.isin(key[mine], w.values.to_numpy().view(np.uint64))
                key = rolled(hashes, LONGER, LONGER)[: len(key)]
            key, doc = _distinct(key[inside], doc[inside])
            if len(key):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column("doc_id").take(pa.array(doc))], names=["prefix", "doc_id"])

    if hot:
        docs = docs.where(F.size(hot) > 0)
    return docs.select("doc_id", "text", *[hot] * bool(hot)).mapInArrow(run, "prefix long, doc_id long")


def _shared(rows: DataFrame, cold: str, hot: str) -> DataFrame:
    """The prefixes of each document that another has as well: those that make a bounded group, and the others."""
    n = rows.groupBy("prefix").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    mine = rows.join(n.select("prefix", (F.col("n") > GROUP).alias("hot")), "prefix").groupBy("doc_id")
    return mine.agg(F.collect_list(F.when(~F.col("hot"), F.col("prefix"))).alias(cold), F.collect_list(F.when(F.col("hot"), F.col("prefix"))).alias(hot))


SUFFIX = "prefix long, doc_id long, shape int, places binary, words binary"


def _ints(value: pa.Scalar) -> np.ndarray:
    return value.values.to_numpy().view(np.uint64) if value.is_valid else np.zeros(0, np.uint64)


def longer_suffixes(w: Words, i: int, hashes: np.ndarray, within: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Windows of text ``i`` whose gram is ``within`` and whose longer prefix is ``wanted``: prefix, place and words."""
    a = hashes[w.at[i] : w.at[i + 1]]
    g, at = anchors(a)
    place = np.flatnonzero(np.isin(g[at], within))
    key = rolled(a, LONGER, LONGER)[place]
    keep = np.isin(key, wanted)
    place, key = place[keep], key[keep]
    first = w.at[i] + place
    return key, place, [b" ".join(w.raw[x:z].split()) for x, z in zip(w.starts[first].tolist(), w.ends[first + WINDOW - 1].tolist(), strict=True)]


def _suffixes(joined: DataFrame, wanted: str, within: str | None = None) -> DataFrame:
    """The suffixes below the ``wanted`` prefixes, with the words of their windows.

    A row of a gram has all windows around it: ``shape`` is the number of words before the gram times 16 plus the
    number of windows. A row of a longer prefix, of windows whose gram is in ``within``, is one window. Equal words in a
    document are one row; ``places`` has the row's mark and the words where they begin."""

    def around(w: Words, i: int, hashes: np.ndarray, keys: np.ndarray) -> Iterator[tuple]:
        g, at = anchors(hashes[w.at[i] : w.at[i + 1]])
        place, first, count = np.unique(at, return_index=True, return_counts=True)
        keep = np.isin(g[place], keys)
        place, first, count = place[keep], first[keep], count[keep]
        begin, end = w.starts[w.at[i] + first], w.ends[w.at[i] + first + count + (WINDOW - 2)]
        for key, shape, f, x, z in zip(g[place].view(np.int64).tolist(), ((place - first) * 16 + count).tolist(), first.tolist(), begin.tolist(), end.tolist(), strict=True):
            yield (key, shape, w.raw[x:z]), f

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = words_of(b.column("text"))
            hashes, out = w.hashes(), []
            for i, (doc, mark, keys) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("mark").to_pylist(), map(_ints, b.column(wanted)), strict=True)):
                if within:
                    key, place, body = longer_suffixes(w, i, hashes, _ints(b.column(within)[i]), keys)
                    rows = zip(((k, 1, x) for k, x in zip(key.view(np.int64).tolist(), body, strict=True)), place.tolist(), strict=True)
                else:
                    rows = around(w, i, hashes, keys)
                found: dict[tuple, list[int]] = {}
                for row, place in rows:
                    found.setdefault(row, [mark]).append(place)
                out += [(key, doc, shape, np.array(p, np.int64).tobytes(), body) for (key, shape, body), p in found.items()]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["prefix", "doc_id", "shape", "places", "words"])

    return joined.where(F.size(wanted) > 0).select("doc_id", "mark", "text", wanted, *[within] * bool(within)).mapInArrow(run, SUFFIX)


def repeats(group: np.ndarray, codes: np.ndarray, start: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which suffixes lie in a deep internal node with a smaller document. Suffixes begin at ``start`` of ``codes``;
    those of different groups never meet. Nodes are split by two words at a time where a 64-bit key holds them."""
    out = np.zeros(len(group), bool)
    active = np.arange(len(group))
    _, node = np.unique(group, return_inverse=True)
    bits = int(codes.max(initial=1)).bit_length()
    two = 2 * bits + len(group).bit_length() < 64
    depth = 0
    while depth < WINDOW and len(active):
        key = node.astype(np.int64)
        for _ in range(2 if two and depth else 1):  # a window has an odd number of words
            key = key << bits | codes[start[active] + depth]
            depth += 1
        _, node = np.unique(key, return_inverse=True)
        inner = np.bincount(node)[node] > 1
        active, node = active[inner], node[inner]
    if len(active):
        least = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc[active])
        out[active] = doc[active] > least[node]
    return out


def _trees(suffixes: DataFrame) -> DataFrame:
    """``doc_id, places, begin, stop``: maximal repeats of each row's words, counted from the places."""

    def found(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        prefix, doc, shape = (t[c].to_numpy() for c in ("prefix", "doc_id", "shape"))
        before, n = shape >> 4, shape & 15
        words = words_of(t["words"].chunk(0))
        row = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        # Windows with equal words have their gram at the same offset.
        group = np.unique(prefix, return_inverse=True)[1][row].astype(np.int64) * 16 + before[row] - nth
        hit = np.flatnonzero(repeats(group, words.codes(), words.at[row] + nth, doc[row]))
        row, nth = row[hit], nth[hit]
        head = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(nth) != 1)][: len(hit)])
        tail = np.r_[head[1:] - 1, len(hit) - 1][: len(head)]
        at = pa.array(row[head])
        return pa.RecordBatch.from_arrays([t["doc_id"].chunk(0).take(at), t["places"].chunk(0).take(at), pa.array(nth[head], pa.int32()), pa.array(nth[tail] + WINDOW, pa.int32())], names=["doc_id", "places", "begin", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            prefix = b.column("prefix").to_numpy()
            # Trees are built for whole prefixes: what is held ends before the last prefix of the batch.
            last = int(np.searchsorted(prefix, prefix[-1]))
            if size >= TOGETHER and (last or held[-1].column("prefix")[-1].as_py() != prefix[0]):
                yield found([*held, b.slice(0, last)] if last else held)
                held, size, b = [], 0, b.slice(last)
            held.append(b)
            size += int((b.column("shape").to_numpy() & 15).sum())
        if held:
            yield found(held)

    return suffixes.repartition("prefix").sortWithinPartitions("prefix").mapInArrow(run, "doc_id long, places binary, begin int, stop int")


def _own_windows(suffixes: DataFrame) -> DataFrame:
    """``doc_id, own``: of the prefixes that are whole windows those whose smallest document this is, a minimum that is
    aggregated before it is shuffled. All other documents know by their lists of prefixes that they repeat it."""
    return suffixes.groupBy("words").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("words").alias("own"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """Add to ``docs(doc_id, mark, text, copy)`` the stretches of the rows that are no copies that a smaller document has
    as well: ``hits`` of the trees and, for prefixes that are whole windows, the lists ``hot``, ``hot_longer`` and ``own``."""
    # Left joins, so that the shuffled texts are the very exchange that later joins read again.
    texts = docs.where("NOT copy").select("doc_id", "mark", "text")
    first = _shared(_prefix_rows(texts), "cold", "hot").hint("shuffle_hash")
    with_first = docs.join(first, "doc_id", "left")
    texts = with_first.where("NOT copy")
    longer = _shared(_prefix_rows(texts, "hot"), "cold_longer", "hot_longer").hint("shuffle_hash")
    both = with_first.join(longer, "doc_id", "left")
    texts_longer = both.where("NOT copy")
    hits = _trees(_suffixes(texts, "cold")).union(_trees(_suffixes(texts_longer, "cold_longer", "hot")))
    hits = hits.groupBy("doc_id").agg(F.collect_list(F.struct("places", "begin", "stop")).alias("hits"))
    own = _own_windows(_suffixes(texts_longer, "hot_longer", "hot"))
    return both.drop("cold", "cold_longer").join(hits.hint("shuffle_hash"), "doc_id", "left").join(own.hint("shuffle_hash"), "doc_id", "left")


def _firsts(docs: DataFrame) -> DataFrame:
    """``doc_id, firsts``: marks of the rows that are the first of all with their text; other rows are copies."""
    first = docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.first("mark").alias("mark"))
    return first.groupBy("doc_id").agg(F.collect_set("mark").alias("firsts"))


def removed(n: int, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Which of ``n`` words lie in one of the stretches."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, begins, 1)
    np.add.at(step, stops, -1)
    return np.cumsum(step[:-1]) > 0


def _gone(b: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray | None]]:
    """The words of each row, and which of them are to go."""
    hot = np.flatnonzero(pc.greater(pc.fill_null(pc.list_value_length(b.column("hot_longer")), 0), 0).to_numpy(zero_copy_only=False)).tolist()
    w = words_of(b.column("text").take(pa.array(hot, pa.int64()))) if hot else None
    hashes, nth = w.hashes() if hot else None, {i: k for k, i in enumerate(hot)}
    cols = (b.column(c).to_pylist() for c in ("text", "mark", "copy", "hits"))
    for i, (text, mark, copy, hits) in enumerate(zip(*cols, strict=True)):
        words = (text or "").encode().split()
        if copy:
            yield words, np.ones(len(words), bool) if len(words) >= WINDOW else None
            continue
        found = [(p[1:] + h["begin"], p[1:] + h["stop"]) for h in hits or () if (p := np.frombuffer(h["places"], np.int64))[0] == mark]
        if i in nth:
            _, place, body = longer_suffixes(w, nth[i], hashes, _ints(b.column("hot")[i]), _ints(b.column("hot_longer")[i]))
            own = set(b.column("own")[i].as_py() or ())
            place = place[[x not in own for x in body]] if len(place) else place
            found.append((place, place + WINDOW))
        yield words, removed(len(words), *map(np.concatenate, zip(*found, strict=True))) if found else None


def deduplicated(docs: DataFrame) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by single spaces."""
    small_batches(docs.sparkSession)
    new = ["n_words", "n_removed", "kept"]
    others = [c for c in docs.columns if c not in ("doc_id", "text", *new)]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"), F.struct(F.lit(0).alias("__"), *others).alias("rest"))
    named = rows.where(F.col("doc_id").isNotNull())
    named = named.join(_firsts(named.select("doc_id", "mark", "text")).hint("shuffle_hash"), "doc_id", "left")
    named = named.withColumn("copy", ~F.coalesce(F.array_contains("firsts", F.col("mark")), F.lit(False))).drop("firsts")
    marked = with_repeats(named)
    nothing = {c: F.lit(None).cast(marked.schema[c].dataType) for c in ("hot", "hot_longer", "hits", "own")}
    marked = marked.unionByName(rows.where(F.col("doc_id").isNull()).withColumns({"copy": F.lit(False)} | nothing))

    def cut(b: pa.RecordBatch) -> list:
        n_words, n_removed, kept = [], [], []
        for words, gone in _gone(b):
            n_words.append(len(words))
            if gone is not None:
                words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        return [n_words, n_removed, kept]

    fields = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType())]
    done = map_batches(marked, cut, fields, keep=["doc_id", "text", "rest"])
    return done.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns if c not in new), *new)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated words cut from their texts; texts that lose none stay as they are. ``n_chars``
    follows, where it is there."""
    own = {c: f"__own_{c}" for c in docs.columns if c in ("n_words", "n_removed", "kept")}
    done = deduplicated(docs.withColumnsRenamed(own))
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars"))}
    return done.select(*((new[c] if c in new else F.col(own.get(c, c))).alias(c) for c in docs.columns))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that an earlier document's windows cover."""
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = {
    "op6_substrings": f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS least FROM s),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i FROM g WHERE least < doc_id),
k AS (SELECT d.doc_id, d.w, list(c.i) FILTER (c.i IS NOT NULL) AS gone FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id, d.w)
SELECT doc_id, len(w) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256
FROM k"""
}
