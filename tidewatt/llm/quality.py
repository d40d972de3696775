"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded and cut into chunks that overlap by the filters' width less one, so the window
that begins at each byte of the whole text is seen. The filters' responses are max-pooled within each chunk, and the
mean and the maximum over chunks go through a dense layer to one probability. Weights come from a bounded sample of
labelled rows by Adam; only the pooled positions carry gradients.

Null and empty texts are one chunk of padding and get a score. Without labels of both kinds the score is the
share of good labels (1 without labels). A row with both labels is learned under both. Equal texts have equal scores,
whatever they are scored with: products are taken chunk by chunk and text by text. Sampled texts that don't fit into
the sample's bytes are passed over; of a label none of whose texts fits the shortest is taken. An empty table gives an
empty result; further columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from .common import held_out, map_batches, small_batches, table, texts
from .sampling import first_by_hash, learnable, with_texts

#: Bounds of the sample, for each label: rows, and bytes of their texts.
ROWS, SAMPLE_BYTES = 1_500, 12 << 20
CHUNK, WIDTH, EMBED, FILTERS, HIDDEN = 1_024, 8, 8, 48, 16
EPOCHS, BATCH, RATE = 8, 32, 0.004
#: Chunks whose windows are laid out at once, 260 KB each.
AT_ONCE = 32
THRESHOLD = 0.5


def chunks(text: bytes) -> np.ndarray:
    """Overlapping chunks that cover all bytes; a short text is padded with zeros, else the last chunk ends with it."""
    raw = np.frombuffer(text, np.uint8)
    if len(raw) <= CHUNK:
        return np.pad(raw, (0, CHUNK - len(raw)))[None]
    starts = np.append(np.arange(0, len(raw) - CHUNK, CHUNK - WIDTH + 1), len(raw) - CHUNK)
    return np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[starts]


class Network:
    """Parameters and the forward and backward passes."""

    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        normal = lambda *shape: (r.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "embed": r.normal(size=(256, EMBED)).astype(np.float32), "filter": normal(WIDTH * EMBED, FILTERS), "filter_b": np.zeros(FILTERS, np.float32),
            "dense": normal(2 * FILTERS, HIDDEN), "dense_b": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, 1), "out_b": np.zeros(1, np.float32),
        }

    def pooled(self, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk, and the byte where its window starts."""
        best, where = [], []
        for a in range(0, len(bytes_), AT_ONCE):
            x = self.p["embed"][bytes_[a : a + AT_ONCE]].reshape(-1, CHUNK * EMBED)
            windows = np.lib.stride_tricks.sliding_window_view(x, WIDTH * EMBED, axis=1)[:, ::EMBED]
            y = np.ascontiguousarray(windows) @ self.p["filter"]
            if self.training:
                at = y.argmax(1)
                where.append(at)
                best.append(np.take_along_axis(y, at[:, None], 1)[:, 0])
            else:
                best.append(y.max(1))
        return np.concatenate(best), np.concatenate(where) if self.training else None

    training = False

    def forward(self, bytes_: np.ndarray, of: np.ndarray, n: int) -> tuple:
        """Logits of ``n`` texts; ``of`` names the text of each chunk, in order."""
        raw, where = self.pooled(bytes_)
        h = np.maximum(raw + self.p["filter_b"], 0)
        first = np.searchsorted(of, np.arange(n))
        count = np.diff(np.append(first, len(of)))[:, None]
        f = np.concatenate([np.add.reduceat(h, first) / count, np.maximum.reduceat(h, first)], 1).astype(h.dtype)
        hidden = np.maximum((f[:, None] @ self.p["dense"])[:, 0] + self.p["dense_b"], 0)
        return (hidden[:, None] @ self.p["out"])[:, 0, 0] + self.p["out_b"], (h, where, count, f, hidden)

    def gradients(self, bytes_: np.ndarray, of: np.ndarray, held: tuple, g: np.ndarray) -> dict:
        """Gradients of the parameters, ``g`` being those of the logits."""
        h, where, count, f, hidden = held
        g = g[:, None].astype(np.float32)
        d_hidden = (g @ self.p["out"].T) * (hidden > 0)
        d_f = d_hidden @ self.p["dense"].T
        top = (h == f[of, FILTERS:]).astype(h.dtype)
        top /= np.add.reduceat(top, np.searchsorted(of, np.arange(len(g))))[of]  # chunks overlap, so ties occur
        d_h = (d_f[:, :FILTERS] / count)[of] + d_f[of, FILTERS:] * top
        d_h *= h > 0
        window = bytes_[np.arange(len(h))[:, None, None], where[:, :, None] + np.arange(WIDTH)]  # chunk, filter, byte
        x = self.p["embed"][window].reshape(*d_h.shape, WIDTH * EMBED)
        d_x = (d_h[:, :, None] * self.p["filter"].T).reshape(-1, EMBED)
        at = window.reshape(-1)
        return {
            "embed": np.stack([np.bincount(at, d_x[:, k], 256) for k in range(EMBED)], 1), "filter": np.einsum("cf,cfk->kf", d_h, x), "filter_b": d_h.sum(0),
            "dense": f.T @ d_hidden, "dense_b": d_hidden.sum(0), "out": hidden.T @ g, "out_b": g.sum(0),
        }

    def train(self, bodies: list[bytes], good: np.ndarray, weight: np.ndarray, seed: int = 0) -> None:
        r, cut = np.random.default_rng(seed), [chunks(t) for t in bodies]
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        self.training = True
        for epoch in range(EPOCHS):
            order = r.permutation(len(bodies))
            for a in range(0, len(order), BATCH):
                part = order[a : a + BATCH]
                bytes_, of = np.concatenate([cut[i] for i in part]), np.repeat(np.arange(len(part)), [len(cut[i]) for i in part])
                z, held = self.forward(bytes_, of, len(part))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                grads = self.gradients(bytes_, of, held, (p - good[part]) * weight[part] / len(part))
                step += 1
                rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, g in grads.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
        self.training = False

    def scores(self, bodies: list[bytes]) -> np.ndarray:
        cut, out = [chunks(t) for t in bodies], []
        a = 0
        while a < len(cut):  # long texts alone, short ones together
            z, size = a, 0
            while z < len(cut) and (z == a or size + len(cut[z]) <= 4 * AT_ONCE):
                size += len(cut[z])
                z += 1
            out.append(self.forward(np.concatenate(cut[a:z]), np.repeat(np.arange(z - a), [len(c) for c in cut[a:z]]), z - a)[0])
            a = z
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out).astype(np.float64), -30, 30))) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame) -> Network | float:
    """A trained network, or the score of all rows where there is nothing to tell apart."""
    small_batches(docs.sparkSession)
    known = learnable(labels).where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("good"))
    n = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    if len(n) < 2:
        return 1.0 if not n else float(next(iter(n)))
    chosen = [first_by_hash(known.where(F.col("good") == k).select("doc_id"), ROWS, k).withColumn("good", F.lit(k)) for k in (0, 1)]
    sample = with_texts(docs, chosen[0].unionByName(chosen[1]), "quality-sample")
    fitting = sample.sparkSession.createDataFrame(that_fit(sample), "doc_id long, good int")
    rows = sample.join(F.broadcast(fitting), ["doc_id", "good"]).toPandas().sort_values(["good", "doc_id", "text"])
    scratch.discard(sample)
    found = rows.good.value_counts()
    if len(found) < 2:
        return float((rows.good == 1).mean()) if len(rows) else 1.0
    weight = rows.good.map({k: (n[k] / sum(n.values())) * len(rows) / found[k] for k in found.index}).to_numpy(np.float32)
    net = Network()
    net.train([t.encode() for t in rows.text], rows.good.to_numpy(np.float32), weight)
    return net


def that_fit(sample: DataFrame) -> list[tuple[int, int]]:
    """Id and label of the sampled rows, in the order of their hashes, whose texts fit into ``SAMPLE_BYTES`` a label."""
    sizes = sample.groupBy("doc_id", "good").agg(F.sum(F.octet_length("text")).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    kept = []
    for label in {r.good for r in sizes}:
        mine, held, some = [r for r in sizes if r.good == label], 0, False
        for r in mine:
            if held + r["size"] <= SAMPLE_BYTES:
                held, some = held + r["size"], True
                kept.append((r.doc_id, label))
        if not some:
            kept.append((min(mine, key=lambda r: r["size"]).doc_id, label))
    return kept


def with_scores(docs: DataFrame, model: Network | float) -> DataFrame:
    """Add ``score``, the probability that a text is good."""
    if isinstance(model, float):
        return docs.withColumn("score", F.lit(model))
    net = docs.sparkSession.sparkContext.broadcast(model)
    return map_batches(docs, lambda b: [net.value.scores([t.encode() for t in texts(b)])], [("score", T.DoubleType())])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; held-out rows are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are predicted good."""
    clash = [F.col("score").alias("__score")] if "score" in docs.columns else []
    kept = with_scores(docs.select("*", *clash), fit(docs, labels)).where(F.col("score") >= THRESHOLD).drop("score")
    return kept.withColumnRenamed("__score", "score").select(docs.columns)
