"""The pipeline's near-duplicates: SimHash fingerprints of Jaccard similarity 0.8, against brute force over all pairs."""

import collections
import itertools

import numpy as np
import pytest
from test_corpus_operators import LONG, docs, empty, shingle_set

import corpus_pipeline
from tidewatt.llm import simhash, similar
from tidewatt.llm.common import table


def lowered(text):
    return (text or "").encode().lower().decode()


def brute_pairs(texts):
    """Pairs of positions of distinct texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = [shingle_set(lowered(t)) for t in texts]
    holders, common = collections.defaultdict(list), collections.Counter()
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for h in holders.values():
        common.update(itertools.combinations(h, 2))
    return {(a, b) for (a, b), n in common.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)}


def brute_first(rows):
    """Ids that stay: the smallest of each component."""
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    blank = [i for i, (_, t) in enumerate(rows) if not shingle_set(t)]
    for a, b in [*brute_pairs([t for _, t in rows]), *itertools.pairwise(blank)]:
        up[find(a)] = find(b)
    first = {}
    for i, (d, _) in enumerate(rows):
        first[find(i)] = min(d, first.get(find(i), d))
    return sorted(d for i, (d, _) in enumerate(rows) if d == first[find(i)])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pipeline_leaves_no_similar_pair(spark, sf):
    path = f"/root/testdata/{sf}"
    out = table(spark, path, "documents")
    before = brute_pairs([r.text for r in out.dropDuplicates(["text"]).collect()])
    out = dict(corpus_pipeline.STAGES)["near-duplicates"](spark, out, path)
    assert before and not brute_pairs([r.text for r in out.collect()])


def test_keeps_the_first_of_each_component(spark):
    path = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in table(spark, path, "documents").collect()]
    got = sorted(r.doc_id for r in similar.keep_first(table(spark, path, "documents")).collect())
    assert got == brute_first(rows)


def test_odd_rows(spark):
    df = docs(spark)
    out = similar.keep_first(df)
    assert sorted(out.columns) == sorted(df.columns)
    rows = [(r.doc_id, r.text) for r in df.collect() if r.doc_id is not None]
    assert {r.doc_id for r in out.collect()} == set(brute_first(rows)) | {None}
    assert similar.keep_first(empty(spark)).count() == 0


def test_buckets_in_parts(spark, monkeypatch):
    words = LONG.split()[:100]
    texts = [" ".join(words[:i] + [f"new{i}"] + words[i + 1 :]) for i in range(0, 40)]
    df = docs(spark, texts + ["nothing like it at all, this one"], extra=False).where("doc_id IS NOT NULL AND doc_id != 15")
    monkeypatch.setattr(similar, "PART", 4)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(r.doc_id for r in similar.keep_first(df).collect()) == brute_first(rows)


def near_sets():
    r = np.random.default_rng(3)
    base = [r.integers(0, 1 << 40, 60) for _ in range(5)]
    return [np.unique(np.r_[base[i % 5][: 60 - i // 5], r.integers(0, 1 << 40, i // 5)]).astype(np.uint64) for i in range(80)]


def print_of(values):
    votes = np.unpackbits((values * np.uint64(0x9E3779B97F4A7C15) ^ values).view(np.uint8), bitorder="little").reshape(-1, 64).sum(0)
    return np.packbits(2 * votes > len(values), bitorder="little").view(np.uint64)[0]


@pytest.mark.parametrize("how", ["large", "small", "same prints"])
def test_links_connect_what_brute_force_does(how):
    sets = near_sets()
    pairs = {(a, b) for a, b in itertools.combinations(range(80), 2) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    prints = np.array([print_of(s) for s in sets]) if how != "same prints" else np.zeros(80, np.uint64)
    got = similar.small_groups(sets, prints, np.zeros(80, int)) if how == "small" else similar.linked(sets, prints)
    got = {tuple(sorted(p)) for p in got.tolist()}
    assert got <= pairs

    def labels(links):
        label = list(range(80))
        for _ in range(80):
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return label

    assert labels(got) == labels(pairs)


def test_recall_of_the_radius(spark):
    """Fingerprints of all pairs of the test table that are similar lie within the radius, with room to spare."""
    found = sorted({r.text for r in table(spark, "/root/testdata/sf0.1", "documents").collect() if r.text})
    apart = [(simhash.fingerprint(found[a], similar.WORDS) ^ simhash.fingerprint(found[b], similar.WORDS)).bit_count() for a, b in brute_pairs(found)]
    assert len(apart) > 40 and max(apart) <= similar.RADIUS - 4
