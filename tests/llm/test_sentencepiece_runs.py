"""Rows put together from runs that were encoded, compared and decoded once, against both libraries on whole rows."""

import io

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatt.llm.sentencepiece_codec import MARK, Codec

TEXTS = ["", " ", "  two  spaces ", "a", " a", f"a{MARK}b {MARK}{MARK} c", "tab\tand\nline\r\n", "a\0b", "日本 語", "é è é", "x" * 300, " ".join(f"w{i}" for i in range(3000)), "🙂 🙂🙂", "a <unk> <s> </s> <0x41> b", "   ", "end "]


@pytest.fixture(scope="module", params=["public", "no fallback", "fallback", "unigram"])
def codec(request, tmp_path_factory):
    if request.param == "public":
        return Codec.checked(public_tokenizers.path("piece_bpe_32k.model"))
    path, model = tmp_path_factory.mktemp("model") / "m.model", io.BytesIO()
    kind = "unigram" if request.param == "unigram" else "bpe"
    options = {"vocab_size": 340, "byte_fallback": True} if request.param == "fallback" else {"vocab_size": 60}
    sentences = [f"bad cab dab {a}{b} aab bba  {b}{c}{a} fed bead" for a in "abcdefg" for b in "abcdefg" for c in "abcdefg"]
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(sentences), model_writer=model, model_type=kind, normalization_rule_name="identity", remove_extra_whitespaces=False, hard_vocab_limit=False, minloglevel=2, **options)
    path.write_bytes(model.getvalue())
    return Codec.checked(str(path))


def same(codec, bodies):
    runs = codec.runs(bodies)
    ids = codec.encode(bodies, runs)
    assert codec.decoded(runs, ids) == codec.decode(ids)
    whole = [np.array(x, "<u4") for x in codec.theirs.encode(bodies)]
    assert codec.parity(bodies, runs, ids) == [np.array_equal(x, y) for x, y in zip(ids, whole, strict=True)]
    return runs, ids


def test_rows(codec):
    same(codec, TEXTS)
    same(codec, TEXTS[::-1] * 2)


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(f" {MARK}abcé\n"), st.characters(exclude_categories=("Cs",))), max_size=30), max_size=5))
@settings(max_examples=100, deadline=None)
def test_any_rows(codec, bodies):
    same(codec, bodies)


def test_repeated_runs_are_decoded_once(monkeypatch):
    codec = Codec(public_tokenizers.path("piece_bpe_32k.model"))
    codec.theirs = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    bodies = ["some words come again and again"] * 300
    runs = codec.runs(bodies)
    ids = codec.encode(bodies, runs)
    monkeypatch.setattr(codec, "decode", lambda _: pytest.fail("a row was decoded as a whole"))
    assert codec.decoded(runs, ids) == bodies
