"""Each stage of the pipeline against a plainer account of what it should keep."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import brute_removed
from test_similar import brute_first

import corpus_pipeline
from tidewatt.llm.common import table

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def documents(spark):
    df = table(spark, SF, "documents")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (None, "x y z", "en", "src0", 5)], df.schema)
    return df.unionByName(odd).cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_schema(spark, documents, name):
    out = STAGES[name](spark, documents, SF)
    assert out.dtypes == documents.dtypes
    assert 0 < out.count() <= documents.count()
    assert STAGES[name](spark, documents.limit(0), SF).count() == 0


@pytest.mark.parametrize(("name", "label", "bad"), [("toxicity", "toxic", 1), ("quality", "quality", 0)])
def test_filters(spark, name, label, bad):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    kept = STAGES[name](spark, docs, sf).select("doc_id").withColumn("kept", F.lit(1))
    rows = docs.join(table(spark, sf, "labels"), "doc_id").join(kept, "doc_id", "left").groupBy(label).agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()
    share = {r[label]: r.share for r in rows}
    assert share[1 - bad] > 0.95 and share[bad] < 0.5


def test_near_duplicates(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    want = sorted([str(i) for i in brute_first([r for r in rows if r[0] is not None])] + ["None"])
    assert sorted(str(r.doc_id) for r in STAGES["near-duplicates"](spark, documents, SF).collect()) == want


def test_substrings(spark, documents):
    removed = {i: n for i, _, n, _ in brute_removed([tuple(r) for r in documents.select("doc_id", "text").collect()])}
    out = STAGES["substrings"](spark, documents, SF).select("doc_id", "text", "n_chars").collect()
    before = {str(r.doc_id): r.text for r in documents.select("doc_id", "text").collect()}
    for r in out:
        if removed[str(r.doc_id)]:
            assert len(r.text.split()) == len(before[str(r.doc_id)].split()) - removed[str(r.doc_id)] and r.n_chars == len(r.text)
        else:
            assert r.text == before[str(r.doc_id)]


def test_packing(spark, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in documents.collect())
    out = STAGES["packing"](spark, documents, SF).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n for r in out) == total and max(r.n for r in out) <= 2048


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count()
