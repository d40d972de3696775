"""Operator 9's encoder: texts are parted into runs, each encoded once, with the tokenizer's ids."""

import sys

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatt.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def same(texts):
    encoder = packing.WordEncoder.of(PATH)
    return [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_run_is_encoded_once_whatever_stands_beside_it(monkeypatch):
    encoder, learned = packing.WordEncoder(PATH), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda new: (learned.extend(w.decode() if isinstance(w, bytes) else w for w in new), learn(new))[1])
    texts = ["Fjord fjord, fjord*** (fjord) fjord7 7fjord\tÉTÉ été. été-été", "FJORD fjord\x00fjord 1234567890 2109876543 fjord&&&", "fjord###\nfjord"]
    ids = encoder.encode(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in ids] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(learned) == len(set(learned)) and learned.count("fjord") == 1
    assert not {"fjord***", "fjord7", "fjord&&&", "fjord###", "Fjord", "ÉTÉ", "1234567890"} & set(learned)
    assert encoder.encode(texts) == ids and len(learned) == len(set(learned))


@pytest.mark.parametrize("beside", ["a", "Z", "é", "É", "ÿ", "ß", "×", "÷", "ª", "7", "٣", "²", "'", "’", "-", "_", "…", "<", "=", "~", "\x00", "\x1c", "\x7f", "\x85", "\xa0", " ", "　", "ж", "Σ", "ς", "语", "한", "각", "क़", "K", "Å", "İ", "ı", "ſ", "ẞ", "ﬁ", "ǅ", "́", "̸", "ͅ", "़", "゙", "‍", "😀", "\U00010400", "𝟗", " ", "\n"])
def test_runs_beside_any_character_have_the_tokenizers_ids(beside):
    known = ["", "a", "B", "é", "Ü", "5", ".", "'", "'s", "'LL", "don't", "!'re", "<", " ", "\r"]
    assert same([x + beside + y + z for x in known for y in known for z in ("", "e", "'", beside)])


def test_every_character_between_letters_signs_and_digits():
    # All characters below U+3100 and each 37th above, surrogates left out.
    some = [chr(c) for c in [*range(0x3100), *range(0x3100, sys.maxunicode, 37)] if not 0xD800 <= c < 0xE000]
    for form in ("a{}b", "A{}'s", ".{}.", "5{}5", "É{}é", "'{}'t"):
        assert same([form.format(c) for c in some])


@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from("aZéÉß×÷ÿsStTlLmMdDvVeErR''''’.,-!…<|>=059٣²Σς̸́  \n\t\x1c\x85\xa0İKÅж语")), max_size=40), max_size=6))
@settings(max_examples=300, deadline=None)
def test_texts_encoded_together_have_the_tokenizers_ids(texts):
    assert same(texts)


def test_ids_stay_right_when_the_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    for _ in range(3):
        assert same(["one two three four five", "", "one café <|endoftext|> two", " ", "six, seven"])
