"""Batches with few words in all."""

import numpy as np
import pytest

from tidewatt.llm import substrings


@pytest.mark.parametrize("words", range(1, 16))
def test_smallest_of_few_words(words):
    grams = substrings.rolled(np.random.default_rng(words).integers(0, 1 << 63, words).astype(np.uint64), substrings.GRAM)
    want = [min(grams[i : i + substrings._GRAMS]) for i in range(len(grams) - substrings._GRAMS + 1)]
    assert substrings.smallest(grams).tolist() == want


def test_table_of_ten_words(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    assert [r.text for r in substrings.without_repeats(df).collect()] == ["a b c d e f g h i j"]
