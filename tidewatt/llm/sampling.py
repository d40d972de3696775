"""Bounded samples of labelled rows for fitting; everything else runs over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .common import held_out


def first_by_hash(ids: DataFrame, limit: int, seed: int) -> DataFrame:
    """At most ``limit`` distinct ids, chosen by their hash and so alike at every size."""
    ids = ids.where(F.col("doc_id").isNotNull()).distinct()
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(limit)


def learnable(labels: DataFrame) -> DataFrame:
    """Labelled rows that may be learned from."""
    return labels.where(~held_out(F.col("doc_id")))


def with_texts(docs: DataFrame, chosen: DataFrame, tag: str) -> DataFrame:
    """The texts of the chosen rows, written once. ``chosen`` is bounded by the samples' limits, so it is broadcast."""
    return scratch.written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id"), tag)
