"""The corpus pipeline: each stage works on all that the stage before it kept.

Toxic documents go, then documents of low quality, then all but the first of each group of near-duplicates: operator
4 with five-word shingles, whose candidates are linked where their Jaccard similarity is 0.8 or more. Words that an
earlier document's windows cover are cut, and what is left is packed into token sequences. The classifiers learn from labels that aren't held out; nulls, empty and repeated rows fare as in the operators.
All stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatt import scratch
from tidewatt.llm import packing, quality, similar, substrings, toxicity
from tidewatt.llm.common import small_batches, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near-duplicates", drop_near_duplicates), ("substrings", cut_repeats), ("packing", pack)]
#: SQL cannot train the classifiers, so the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again by the next."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
