"""The corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows
and clashing columns."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import assert_same, run_sql
from pyspark.sql import functions as F

from tidewatt.llm import chat, components, minhash, mpegts, packing, quality, sampling, sentencepiece_codec, simhash, substrings, toxicity, warc
from tidewatt.llm.common import held_out

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(9_000))
BASE = "the quick brown fox jumps over the lazy dog while seven wizards quietly boil a pot of tea in the old tower by the sea"
TEXTS = [None, "", " \t\n", "one", "a b c", BASE, BASE, BASE.upper(), BASE + " and then some", "x " + BASE, LONG, LONG + " end", "é 𝄞 日本 ñ" * 30, "a " * 50]


def docs(spark, texts=TEXTS, extra=True):
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(None, BASE), (15, BASE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # names that the operators use themselves
        for c in ("score", "fp", "n_words", "kept", "hits", "label", "node", "media", "words", "n_removed", "prefix"):
            df = df.withColumn(c, F.lit("mine"))
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- fingerprints
def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_minhash_neighbours_and_likeness(spark, tmp_path):
    path = str(tmp_path)
    docs(spark).write.parquet(f"{path}/documents.parquet")
    got = minhash.op1_minhash(spark, path).collect()
    rows = sorted(((i, t or "") for i, t in docs(spark).select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(rows)
    want = {}
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        want.setdefault(i, []).append((len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()))
    for i, found in itertools.groupby(sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), key=lambda r: r.doc_id):
        assert sorted((r.n_chars, r.edited_sha256) for r in found) == sorted(want[i])
    prints = {}
    texts = {i: t for i, t in rows}
    for r in got:
        prints.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def brute_sketch(spark, texts):
    """Bins, densification and low bits by plain loops over the shingles' hashes, which Spark gives."""
    shift, low = 64 - minhash.BINS.bit_length() + 1, (1 << 64 - minhash.BINS.bit_length() + 1) - 1
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    probes = spark.range(minhash.BINS).select(F.col("id").cast("int").alias("b")).select("b", F.xxhash64("b", F.lit(1)).alias("o"), F.xxhash64("b", F.lit(2)).alias("s")).collect()
    order = {r.b: [(r.o + (2 * (r.s % (minhash.BINS // 2)) + 1) * t) % minhash.BINS for t in range(minhash.BINS)] for r in probes}
    out = []
    for r in frame.select("text", minhash.shingles(minhash.words_of(F.col("text"))).alias("h")).collect():
        w = words(r.text)
        assert len(r.h) == (max(1, len(w) - 4) if w else 0)
        held = {}
        for h in r.h:
            b, rest = (h >> shift) + minhash.BINS // 2, h & low  # bins in the order of signed hashes
            held[b] = min(held.get(b, low), rest)
        held = {b: v for b, v in held.items() if v != low}
        values = [held.get(b, next((held[p] for p in order[b] if p in held), None)) for b in range(minhash.BINS)] if held else []
        out.append([v & (1 << minhash.BITS) - 1 for v in values])
    return out


def test_minhash_against_brute_force(spark, tmp_path):
    """Fingerprints, near_edited and near_next of the query."""
    path = str(tmp_path)
    df = docs(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    df.write.parquet(f"{path}/documents.parquet")
    rows = sorted((i, t or "") for i, t in df.select("doc_id", "text").collect())
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for (_, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True)]
    own, other = brute_sketch(spark, [t for _, t in rows]), brute_sketch(spark, edited)

    def like(a, b):
        if a == b:
            return 1.0
        same, chance = sum(x == y for x, y in zip(a, b, strict=False)), 2.0**-minhash.BITS
        return max(0.0, (same / minhash.BINS - chance) / (1 - chance)) if a and b else 0.0

    got = {r.doc_id: r for r in minhash.op1_minhash(spark, path).collect()}
    shown = lambda s: "".join(f"{x:02x}" for x in s) or "00" * minhash.BINS
    for k, (i, _) in enumerate(rows):
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (shown(own[k]), shown(other[k]))
        assert got[i].near_edited == pytest.approx(like(own[k], other[k])) and got[i].near_next == pytest.approx(like(own[k], own[(k + 1) % len(rows)]))


def test_minhash_estimates_jaccard(spark):
    rng = np.random.default_rng(5)
    pairs = []
    for k in range(40):
        a = [f"t{x}" for x in rng.integers(0, 50_000, 400)]
        b = list(a)
        for at in rng.choice(400, 2 * k, replace=False):
            b[at] = f"u{at}"
        pairs.append((" ".join(a), " ".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").select("*", minhash.sketch(F.col("a")).alias("x"), minhash.sketch(F.col("b")).alias("y"))
    rows = df.select("a", "b", minhash.likeness(F.col("x"), F.col("y")).alias("near"), minhash.packed(F.col("x")).alias("p")).collect()
    errors = [r.near - len(shingle_set(r.a) & shingle_set(r.b)) / len(shingle_set(r.a) | shingle_set(r.b)) for r in rows]
    assert np.sqrt(np.mean(np.square(errors))) < 0.05 and abs(np.mean(errors)) < 0.02
    assert all(len(r.p) == minhash.BINS * minhash.BITS // 4 for r in rows)


def test_minhash_single_row_and_empty_table(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([(7, "a b c d e f")], "doc_id long, text string").write.parquet(f"{path}/one/documents.parquet")
    empty(spark).write.parquet(f"{path}/none/documents.parquet")
    (row,) = minhash.op1_minhash(spark, f"{path}/one").collect()
    assert row.near_next == 1.0 and row.n_chars == 11
    assert minhash.op1_minhash(spark, f"{path}/none").count() == 0


def test_minhash_densification_is_complete(spark):
    row = spark.range(1).select(minhash.densified(minhash.bins(F.array(F.lit(123456789).cast("long")))).alias("d")).first()
    assert len(row.d) == minhash.BINS and len(set(row.d)) == 1 and None not in row.d


def test_minhash_is_native(spark):
    plan = minhash.op1_minhash(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- classifiers
def labelled(spark, n=600):
    rng = np.random.default_rng(3)
    vocabulary = [f"word{i}" for i in range(5_000)]
    rows = []
    for i in range(n):
        toxic, good = i % 7 == 0, i % 5 != 0
        w = list(rng.choice(vocabulary, 40))
        if toxic:
            w[rng.integers(40)] = str(rng.choice(["scumbag", "moronic", "vileness"]))
        rows.append((i, " ".join(w if good else [x + "$$$" for x in w]), int(good), int(toxic)))
    both = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")
    return both.select("doc_id", "text"), both.select("doc_id", "quality", "toxic")


def accuracy(scored, labels, name, threshold):
    rows = scored.join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", name).collect()
    return np.mean([(r.score >= threshold) == bool(r[name]) for r in rows])


def test_toxicity_held_out(spark):
    d, labels = labelled(spark, 2_000)
    rows = toxicity.with_scores(d, toxicity.fit(d, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", "toxic").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert np.mean([t > c for t in toxic for c in clean]) > 0.97
    assert np.mean([c >= toxicity.THRESHOLD for c in clean]) < 0.02


def test_toxicity_risk_is_not_negative():
    rows, cols = np.arange(40), np.r_[np.zeros(10, int), np.zeros(9, int), np.ones(21, int)]
    w, b = toxicity.fit_one(rows, cols, np.arange(40) < 10, 0.3, 2)
    assert np.isfinite(w).all() and w[0] > w[1]
    assert toxicity.sigmoid(w[0] + b) > 0.5 > toxicity.sigmoid(w[1] + b)


def plain_fit(rows, positive, prior, width):
    """The non-negative risk's descent by loops over rows."""
    n_p, n_u = sum(positive), len(positive) - sum(positive)
    w = [0.0] * width + [np.log(prior / (1 - prior))]
    m, v = [0.0] * (width + 1), [0.0] * (width + 1)
    for step in range(1, toxicity.STEPS + 1):
        z = [sum(w[c] for c in row) + w[-1] for row in rows]
        as_negative = [np.log1p(np.exp(-abs(x))) + max(0.0, x) for x in z]
        bracket = sum(x for x, p in zip(as_negative, positive, strict=True) if not p) / n_u - prior * sum(x for x, p in zip(as_negative, positive, strict=True) if p) / n_p
        grad = [toxicity.DECAY * x for x in w[:-1]] + [0.0]
        for row, x, p in zip(rows, z, positive, strict=True):
            q = 1 / (1 + np.exp(-x))
            negative = (-prior * q / n_p if p else q / n_u) * (1 if bracket >= 0 else -1)
            for c in [*row, width]:
                grad[c] += negative + (prior * (q - 1) / n_p if p else 0.0)
        for c in range(width + 1):
            m[c], v[c] = 0.9 * m[c] + 0.1 * grad[c], 0.999 * v[c] + 0.001 * grad[c] ** 2
            w[c] -= toxicity.RATE * (m[c] / (1 - 0.9**step)) / (np.sqrt(v[c] / (1 - 0.999**step)) + 1e-8)
    return w


@pytest.mark.parametrize("prior", [0.1, 0.4])
def test_toxicity_fit_against_plain_loops(prior):
    r = np.random.default_rng(8)
    rows = [sorted(set(r.integers(0, 12, 4).tolist()) | ({12} if k < 15 else set())) for k in range(60)]
    positive = np.arange(60) < 15
    at = np.repeat(np.arange(60), [len(x) for x in rows])
    w, b = toxicity.fit_one(at, np.concatenate(rows), positive, prior, 13)
    assert [*w, b] == pytest.approx(plain_fit(rows, positive.tolist(), prior, 13), abs=1e-6)


@pytest.mark.parametrize(("module", "query", "threshold"), [(toxicity, "op2_toxicity", 0.7), (quality, "op7_quality", 0.5)])
def test_classifier_queries(spark, tmp_path, module, query, threshold):
    path = str(tmp_path)
    d, labels = labelled(spark, 300)
    d.unionByName(spark.createDataFrame([(1_000, None), (1_001, ""), (None, "a b"), (7, "again")], "doc_id long, text string")).withColumn("score", F.lit("mine")).write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    out = getattr(module, query)(spark, path)
    assert [n for n, _ in out.dtypes] == ["doc_id", "held_out", "score", "predicted"] and dict(out.dtypes)["score"] == "double" and dict(out.dtypes)["predicted"] == "int"
    rows = out.collect()
    assert len(rows) == 304
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    assert len({r.score for r in rows if r.doc_id in (1_000, 1_001)}) == 1


def test_toxicity_scores_against_plain_sums(spark):
    d, labels = labelled(spark, 300)
    weights, intercept = toxicity.fit(d, labels)
    for r in toxicity.with_scores(d, (weights, intercept)).collect():
        found = set(re.findall(r"\w+", r.text.lower()))
        found |= {f"{w[:5]}*" for w in found if len(w) > 5}
        z = sum(float(weights[b]) for b in {zlib.crc32(w.encode()) % toxicity.BUCKETS for w in found}) + intercept
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_quality_held_out(spark):
    d, labels = labelled(spark)
    assert accuracy(quality.with_scores(d, quality.fit(d, labels)), labels, "quality", quality.THRESHOLD) > 0.95


def test_quality_gradients():
    """Along the gradient of each parameter, away from the kinks of the maxima."""
    net = quality.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    body = np.concatenate([quality.chunks(r.integers(32, 120, 2_400, dtype=np.uint8).tobytes()), quality.chunks(r.integers(32, 120, 1_024, dtype=np.uint8).tobytes())])
    of = np.array([0] * (len(body) - 1) + [1])
    net.training = True
    _, held = net.forward(body, of, 2)
    g = np.array([0.3, -0.7])
    grads = net.gradients(body, of, held, g)
    for name, grad in grads.items():
        grad = np.asarray(grad, np.float64)
        step = 1e-6 * grad / np.sqrt((grad**2).sum())
        net.p[name] = net.p[name] + step
        up = net.forward(body, of, 2)[0] @ g
        net.p[name] = net.p[name] - 2 * step
        down = net.forward(body, of, 2)[0] @ g
        net.p[name] = net.p[name] + step
        assert (up - down) / 2e-6 == pytest.approx(np.sqrt((grad**2).sum()), rel=0.01), name


def plain_score(net, raw):
    """The network's probability, window by window."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raw = raw + bytes(max(0, quality.CHUNK - len(raw)))
    starts = [*range(0, len(raw) - quality.CHUNK, quality.CHUNK - quality.WIDTH + 1), len(raw) - quality.CHUNK]
    pooled, seen = [], set()
    for s in starts:
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(s, s + quality.CHUNK - quality.WIDTH + 1):
            seen.add(at)
            best = np.maximum(best, p["embed"][list(raw[at : at + quality.WIDTH])].ravel() @ p["filter"] + p["filter_b"])
        pooled.append(np.maximum(best, 0))
    assert seen == set(range(len(raw) - quality.WIDTH + 1))
    f = np.concatenate([np.mean(pooled, 0), np.max(pooled, 0)])
    z = np.maximum(f @ p["dense"] + p["dense_b"], 0) @ p["out"] + p["out_b"]
    return 1 / (1 + np.exp(-z[0]))


def test_quality_forward_against_plain_loops():
    r = np.random.default_rng(4)
    bodies = [r.integers(0, 256, n, dtype=np.uint8).tobytes() for n in (0, 1, 7, 1_023, 1_024, 1_025, 2_041, 2_042, 5_000)]
    net = quality.Network(3)
    assert net.scores(bodies) == pytest.approx([plain_score(net, x) for x in bodies], abs=1e-5)


def test_quality_scores_do_not_depend_on_the_batch():
    r = np.random.default_rng(6)
    bodies = [r.integers(32, 127, int(n), dtype=np.uint8).tobytes() for n in r.integers(0, 6_000, 150)]
    net = quality.Network(5)
    alone = [float(net.scores([b])[0]) for b in bodies]
    assert net.scores(bodies).tolist() == alone == net.scores(bodies[::-1])[::-1].tolist()


def test_quality_sample_passes_over_texts_that_do_not_fit(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 1_000)
    rows = [(i, 1, "x" * 100) for i in range(30)] + [(i, 0, "y" * 5_000) for i in range(100, 103)] + [(103, 0, "z" * 2_000), (5, 1, "w" * 900), (6, 1, "v" * 50_000)]
    kept = quality.that_fit(spark.createDataFrame(rows, "doc_id long, good int, text string"))
    sizes = {i: sum(len(t) for k, _, t in rows if k == i) for i, _, _ in rows}
    assert [i for i, good in kept if good == 0] == [103]
    good = [i for i, g in kept if g == 1]
    assert 5 <= len(good) <= 10 and 6 not in good and sum(sizes[i] for i in good) <= 1_000


@given(st.binary(max_size=5_000))
@settings(max_examples=40, deadline=None)
def test_quality_chunks_cover_everything(raw):
    cut = quality.chunks(raw)
    assert cut.shape[1] == quality.CHUNK
    if len(raw) > quality.CHUNK:
        starts = [max(0, min(i * (quality.CHUNK - quality.WIDTH + 1), len(raw))) for i in range(len(cut))]
        assert bytes(cut[0]) == raw[: quality.CHUNK] and bytes(cut[-1]) == raw[-quality.CHUNK :] and len(starts) == len(cut)
    else:
        assert bytes(cut[0][: len(raw)]) == raw


@pytest.mark.parametrize("module", [toxicity, quality])
def test_classifiers_on_odd_tables(spark, module):
    d, labels = labelled(spark, 120)
    model = module.fit(d, labels)
    odd = docs(spark, extra=False)
    scores = [r.score for r in module.with_scores(odd, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert module.with_scores(empty(spark), model).count() == 0
    nobody = labels.limit(0)
    assert module.with_scores(odd, module.fit(odd, nobody)).count() == odd.count()
    nulls = labels.withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    assert module.with_scores(odd, module.fit(odd, nulls)).count() == odd.count()


@pytest.mark.parametrize(("module", "step"), [(toxicity, "drop_toxic"), (quality, "keep_good")])
def test_filters_keep_columns(spark, module, step):
    d, labels = labelled(spark, 200)
    clash = d.withColumn("score", F.lit("mine"))
    kept = getattr(module, step)(clash, labels)
    assert kept.columns == clash.columns and 0 < kept.count() < 200
    assert {r.score for r in kept.select("score").distinct().collect()} == {"mine"}


def test_samples_are_bounded_and_not_held_out(spark):
    _, labels = labelled(spark)
    ids = [r.doc_id for r in sampling.first_by_hash(sampling.learnable(labels).select("doc_id"), 50, 1).collect()]
    assert len(set(ids)) == 50 and all(zlib.crc32(str(i).encode()) % 3 != 1 for i in ids)


# ---- transport streams
@given(st.binary(max_size=70_000))
@settings(max_examples=60, deadline=None)
def test_mpegts_round_trip(payload):
    media = mpegts.mux(payload)
    back = mpegts.demux(media)
    assert back["payload"] == payload and back["continuity_errors"] == 0 and len(media) % 188 == 0
    assert len(back["pts"]) == -(-len(payload) // mpegts.UNIT) == len(back["random_access"])
    assert back["streams"] == {mpegts.DATA_PID: mpegts.PRIVATE_DATA}


@pytest.mark.parametrize("size", [0, 1, 155, 156, 157, 158, 159, 160, 161, 162, 163, 164, 339, 340, 341, 342, 343, 344, 345, 346, 16_384, 16_385])
def test_mpegts_sizes(size):
    payload = bytes(i % 251 for i in range(size))
    assert mpegts.demux(mpegts.mux(payload))["payload"] == payload


def test_mpegts_finds_damage():
    media = bytearray(mpegts.mux(bytes(5_000)))
    lost = bytes(media[: 188 * 5] + media[188 * 6 :])
    assert mpegts.demux(lost)["continuity_errors"] == 1
    media[10] ^= 1
    with pytest.raises(ValueError):
        mpegts.demux(bytes(media))


def test_mpegts_ends_a_damaged_unit_at_the_next():
    payload = bytes(i * i % 251 for i in range(3 * mpegts.UNIT))
    media = mpegts.mux(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    starts = mpegts.demux(media)["random_access"]
    gone = starts[1] + 40
    back = mpegts.demux(b"".join(packets[:gone] + packets[gone + 1 :]))
    assert back["damaged"] == [1] and back["continuity_errors"] == 1
    assert len(back["payload"]) == len(payload) - 184
    assert back["payload"][: mpegts.UNIT] == payload[: mpegts.UNIT] and back["payload"][-mpegts.UNIT :] == payload[-mpegts.UNIT :]
    last = mpegts.demux(b"".join(packets[: starts[1] - 3] + packets[starts[1] - 2 :]))  # the last packet of the first unit
    assert last["damaged"] == [0] and last["payload"][-2 * mpegts.UNIT :] == payload[-2 * mpegts.UNIT :]


def test_mpegts_can_be_entered_at_each_random_access_point():
    payload = bytes(i * i % 251 for i in range(3 * mpegts.UNIT + 100))
    media = mpegts.mux(payload)
    for i, packet in enumerate(mpegts.demux(media)["random_access"]):
        back = mpegts.demux(media[188 * (packet - 2) :])  # with the tables before it
        assert back["payload"] == payload[i * mpegts.UNIT :] and not back["damaged"] and not back["continuity_errors"]


def test_mpegts_duplicates_and_table_counters():
    payload = bytes(2 * mpegts.UNIT)
    media = mpegts.mux(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    twice = mpegts.demux(b"".join(packets[:9] + packets[8:]))
    assert twice["payload"] == payload and twice["continuity_errors"] == 0 and not twice["damaged"]
    thrice = mpegts.demux(b"".join(packets[:9] + [packets[8]] + packets[8:]))
    assert thrice["continuity_errors"] == 1
    table = mpegts.demux(media)["random_access"][1] - 2
    wrong = bytearray(packets[table])
    wrong[3] ^= 4
    assert mpegts.demux(b"".join(packets[:table] + [bytes(wrong)] + packets[table + 1 :]))["continuity_errors"] == 1


def test_mpegts_query(spark, tmp_path):
    path = str(tmp_path)
    docs(spark).write.parquet(f"{path}/documents.parquet")
    want = sorted((str(i), len(raw := (t or "").encode()), (p := raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))) and hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for i, t in docs(spark).select("doc_id", "text").collect())
    got = mpegts.op3_mpegts(spark, path).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.media_bytes % 188 == 0 and r.payload_bytes % 64 == 0 for r in got)


# ---- near-duplicates
def brute_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, radius=3):
    near = np.bitwise_count(values[:, None] ^ values) <= radius
    label = np.arange(len(values))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def test_simhash_against_brute_force(spark, tmp_path):
    path = str(tmp_path)
    docs(spark).write.parquet(f"{path}/documents.parquet")
    got = simhash.op4_simhash(spark, path).collect()
    assert len(got) == docs(spark).count()
    texts = dict(enumerate(docs(spark).select("doc_id", "text").collect()))
    values = np.array([brute_fingerprint(t) for _, t in texts.values()], np.uint64)
    label = brute_components(values)
    ids = [r[0] for r in texts.values()]
    want = sorted((str(ids[k]), f"{int(values[k]):016x}", str(min(i for i, o in zip(ids, label, strict=True) if o == label[k] and i is not None))) for k in texts)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("shard", [8_192, 7])
def test_simhash_links_all_that_are_near(spark, monkeypatch, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (60, 6, 2), dtype=np.uint64), axis=2)
    values = np.unique(np.concatenate([base, (base[:, None] ^ flips).ravel(), base ^ np.uint64(0xF0)]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = {r.node: r.label for r in components.components(simhash.near_links(df)).collect()}
    label = brute_components(values)
    signed = values.view(np.int64)
    want = {int(signed[k]): int(signed[label == label[k]].min()) for k in range(len(values)) if (label == label[k]).sum() > 1}
    assert found == want


@pytest.mark.parametrize("n", [1, 2, 3, 500, 3_000])
def test_bk_trees_agree(n):
    rng = np.random.default_rng(n)
    values = np.unique(np.uint64(0xABCDEF) ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 3), dtype=np.uint64), axis=1))
    want = brute_components(values)
    for roots in (simhash.large_group(values, 3), simhash.small_groups(values, np.zeros(len(values), int), 3)):
        assert len(set(zip(roots.tolist(), want.tolist(), strict=True))) == len(set(roots.tolist())) == len(set(want.tolist()))


@pytest.mark.parametrize("nodes", [10, 10**7, 10**9, 10**12])
def test_masks_leave_no_link_out(nodes):
    rng = np.random.default_rng(0)
    found = simhash.masks(nodes, 3)
    for _ in range(300):
        x = int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3, dtype=np.uint64)))
        assert any(x & m == 0 for m in found)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(200, 260)] + [(300, 300), (5, 4), (5, 4)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {k: 100 for k in (100, *range(200, 260))}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first(spark):
    kept = simhash.keep_first(docs(spark))
    assert kept.columns == docs(spark).columns
    ids = sorted(str(r.doc_id) for r in kept.select("doc_id").collect())
    assert "None" in ids and ids.count("15") == 2 and "18" not in ids and "0" in ids and "3" not in ids
    assert simhash.near_duplicates(empty(spark)).count() == 0


# ---- archives
def pages(spark):
    body = "<html>" + "x" * 200 + "</html>"
    rows = [(5, "http://a b/%\r\n<é>", body), (2, None, body), (9, "", body), (1, "u", None), (3, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", body), (2, "v", body), (8, "u", LONG), (None, "n", "y" * 150), (None, "n", "y" * 150)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("mine"), "payload": F.lit("mine"), "first": F.lit(1)})


def test_warc_roles_and_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 2_000)
    back = warc.read_archives(warc.archives(pages(spark))).collect()
    assert len(back) == 12
    by = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in back)
    n = len(pages(spark).where("page_id = 5").first().html)
    assert ("5", "revisit", 2, n) in by and ("9", "revisit", 2, n) in by and ("None", "revisit", 2, n) in by
    assert by.count(("2", "response", None, n)) == 2 and ("4", "response", None, 5) in by and ("6", "response", None, 5) in by and by.count(("None", "response", None, 150)) == 2
    urls = {(r.page_id, r.url) for r in back}
    assert (5, "http://a b/%\r\n<é>") in urls and (2, None) in urls and (9, "") in urls
    assert all(r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in back)


def test_warc_frames():
    records = [warc.record(i, "u", f"<p>{i}</p>".encode() * 40, None, hashlib.sha256(f"<p>{i}</p>".encode() * 40).hexdigest()) for i in range(60)]
    content = warc.write_archive(records)
    assert content[:4] == bytes.fromhex("5d2a4d18") and sum(1 for _ in warc.read_archive(content)) == 60
    with pytest.raises(ValueError):
        next(warc.read_archive(content[8:]))


def test_warc_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.archives(none)).count() == 0


# ---- substrings
def brute_removed(rows):
    least = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - 12):
            key = tuple(w[s : s + 13])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {p for s in range(len(w) - 12) if i is not None and least[tuple(w[s : s + 13])] < i for p in range(s, s + 13)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("group", [8_192, 25, 1])
def test_substrings_against_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP", group)
    rng = np.random.default_rng(9)
    shared = [" ".join(f"s{x}" for x in rng.integers(0, 30, n)) for n in (12, 13, 14, 40)]
    texts = [" ".join([" ".join(f"r{x}" for x in rng.integers(0, 9, rng.integers(0, 20))), shared[k % 4], " ".join(f"q{x}" for x in rng.integers(0, 9, rng.integers(0, 20)))]) for k in range(40)]
    df = docs(spark, TEXTS + texts)
    got = substrings.deduplicated(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted((str(a), b, c, d) for a, b, c, d in got) == brute_removed([tuple(r) for r in df.select("doc_id", "text").collect()])


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\x0b\x1c\xa0\n", max_size=12)), max_size=8), st.integers(0, 3))
@settings(max_examples=150, deadline=None)
def test_word_hashes_tell_words_apart(texts, skip):
    import pyarrow as pa

    kept = texts[skip:]
    hashes, at = substrings.word_hashes(pa.array(texts, pa.string())[skip:])
    flat = [w for t in kept for w in words(t)]
    assert np.diff(at).tolist() == [len(words(t)) for t in kept] and len(hashes) == len(flat)
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))


@pytest.mark.parametrize("order", [5, 10, 11])
def test_substrings_tell_hostile_words_apart(spark, order):
    """A Thue-Morse word and its complement hash alike under polynomials modulo a power of two."""
    bits = "".join(str(i.bit_count() & 1) for i in range(1 << order))
    a, z = bits.translate(str.maketrans("01", "ab")), bits.translate(str.maketrans("01", "ba"))
    same = " ".join(f"s{i}" for i in range(12))
    rows = [(1, f"{same} {a}"), (2, f"{same} {z}"), (3, f"{same} {a} x"), (4, f"{z} {same} {z}"), (5, f"{same}\n{z}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.deduplicated(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted((str(a), b, c, d) for a, b, c, d in got) == brute_removed(rows)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 4), st.lists(st.integers(0, 1), min_size=13, max_size=13)), max_size=60), st.booleans())
@settings(max_examples=150, deadline=None)
def test_substrings_trees(suffixes, wide):
    """Deep internal nodes of suffixes in few letters, with codes so large that a key holds one word and so small that it holds two."""
    group, doc = (np.array([s[k] for s in suffixes], np.int64) for k in (0, 1))
    codes = np.array([c for s in suffixes for c in s[2]], np.int64) * ((1 << 31) - 1 if wide else 1)
    got = substrings.repeats(group, codes, np.arange(len(suffixes)) * 13, doc)
    assert got.tolist() == [any(g == h and w == x and e < d for h, e, x in suffixes) for g, d, w in suffixes]


def test_substrings_of_rows_that_share_an_id(spark):
    """They are one document, but each loses its own words."""
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(1, f"a b c {shared} d"), (7, f"x {shared}"), (7, f"{shared} y z"), (7, f"x {shared}"), (7, "q " * 30), (7, "q " * 14), (9, "q " * 14), (9, f"a b c {shared} d"), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.deduplicated(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted((str(a), b, c, d) for a, b, c, d in got) == brute_removed(rows)


def test_substrings_keep_columns(spark):
    df = docs(spark).withColumn("n_chars", F.length("text").cast("long"))
    out = substrings.without_repeats(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[0].text is None and rows[6].text == " \t\n" and rows[9].text == "one" and rows[30].text == LONG
    assert rows[33].text.split()[-1] == "end" and rows[33].n_chars == len(rows[33].text)
    assert substrings.without_repeats(empty(spark)).count() == 0


# ---- SentencePiece
def test_sentencepiece_parity(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = sentencepiece_codec.check(docs(spark), path).collect()
    assert all(r.parity and r.decoded == (r.text or "") for r in rows)
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(docs(spark, extra=False), path), path)
    assert all(r.decoded == (r.text or "") for r in both.collect())
    assert sentencepiece_codec.encode(empty(spark), path).count() == 0


@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
@settings(max_examples=150, deadline=None)
def test_sentencepiece_parity_on_any_text(text):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    codec = test_sentencepiece_parity_on_any_text.__dict__.setdefault("codec", sentencepiece_codec.Codec(path))
    sp = test_sentencepiece_parity_on_any_text.__dict__.setdefault("sp", sentencepiece.SentencePieceProcessor(model_file=path))
    ids = codec.encode([text])[0]
    assert ids.tolist() == sp.encode(text)


# ---- packing
@given(st.lists(st.integers(1, 60), max_size=80))
@settings(max_examples=80, deadline=None)
def test_packing_places_every_piece_once(lengths):
    sequence, offset = packing.pack_lengths(np.array(lengths, np.int64), 60)
    by = {}
    for n, s, o in zip(lengths, sequence.tolist(), offset.tolist(), strict=True):
        by.setdefault(s, []).append((o, n))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 60
    assert len(by) <= (2 * sum(lengths)) // 60 + 1


@given(st.lists(st.integers(1, 40), min_size=1, max_size=12), st.integers(0, 60))
@settings(max_examples=80, deadline=None)
def test_packing_fill_is_the_best(lengths, room):
    counts = np.bincount(lengths, minlength=61)
    found = packing.fill(counts, room)
    best = max(s for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if (s := sum(c)) <= room)
    assert sum(a * n for a, n in found) == best and all(n <= counts[a] for a, n in found)


def test_packing_ids(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.pack(packing.cut(docs(spark), path).cache()).collect()
    want = sorted((str(i), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()), a, len(ids)) for i, t in docs(spark).select("doc_id", "text").collect() for ids in [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]] for a in range(0, len(ids), 2048))
    assert sorted((str(r.doc_id), r.ids_crc32, r.start, r.doc_tokens) for r in pieces) == want
    assert packing.pack_documents(empty(spark), path).count() == 0


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from("aAbBçÇİ.,;:!?' \n\t<|>1²Σςẞ́̌\x1c\xa0")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_packing_encoder_is_exact(text):
    encoder = packing.WordEncoder.of(public_tokenizers.path("word_bpe_49k.json"))
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


# ---- chat
@given(st.lists(st.sampled_from(["<", "s", ">", "/", "[", "INST", "]", "~", "<s>", "</s>", "[/INST]", "<<SYS>>", "[ROLE]", "[TEXT]", "<|endoftext|>", "é"]), max_size=30))
def test_chat_escape_round_trip(parts):
    text = "".join(parts)
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROL)


def test_chat_masks(spark):
    rows = [(1, 2, "assistant", " ok\n"), (1, 1, "user", "<s>"), (1, 3, None, None), (1, 3, "tool</s>", "x"), (1, 4, "assistant", "é" * 9), (2, 0, "assistant", None), (None, 0, "user", "a"), (1, 2, "assistant", " ok\n"), (3, 0, "user", LONG), (3, 1, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    for key in (1, 2, 3, None):
        turns = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == key))
        assert got[key].n_turns == len(turns)
        assert got[key].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


# ---- against SQL
@pytest.mark.parametrize(("name", "module"), [("op5_warc", warc), ("op6_substrings", substrings), ("op10_chat", chat)])
def test_against_sql(spark, name, module):
    assert_same(getattr(module, name)(spark, SF).toPandas(), run_sql(module.ORACLE[name], SF))
