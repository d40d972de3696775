"""Packing of token sequences by minimum bin slack.

Documents are tokenised whole, cut into full windows and a remainder, and the remainders are packed: the
largest remaining length opens a window, a bitset subset-sum over the multiset of the other remaining
lengths finds the fill closest to the capacity, and backtracking gives how many pieces of each length it
takes; the pattern is used as often as the counts allow. Pieces are packed in groups of bounded size, dealt
by hash; a group wastes about one window.

Null texts count as empty: such a document is its end token alone. Rows with null or repeated ids are packed
like any other; a piece is told by its position in its row. Equal lengths are taken in order of doc_id and
start. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from .common import WORD, small_batches, table, texts

CAPACITY, END_ID = 2_048, 1
#: Pieces of a group on average; its lengths and ids are all that a task holds.
GROUP = 16_384
#: Encoded runs that a Python worker remembers.
REMEMBERED = 1 << 19
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


_MARKS = re.compile("[\u0130\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f]|<\\|")
#: First bytes of what ``_MARKS`` finds, and of more.
_MARK_BYTES = np.isin(np.arange(256), list(b"<\xc4\xcc\xcd\xe1\xe2\xef"))
#: Lower-case ASCII and Latin-1 letters: one piece to the tokenizer, which its normalisation leaves as it is.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
_SPACE, _LETTER, _DIGIT, _SIGN, _APOSTROPHE, _OTHER = range(6)


def _kinds() -> np.ndarray:
    kinds = np.full(256, _OTHER, np.uint8)
    for c in range(33, 127):
        kinds[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _SIGN
    kinds[ord("'")] = _APOSTROPHE
    kinds[[9, 10, 11, 12, 13, 32]] = _SPACE
    return kinds


def _parts() -> np.ndarray:
    """By 8 times the kind of a byte and that of the next: whether a run begins at the next. Others than ASCII and Latin-1
    are only parted by white space; signs stay together, and a letter stays with an apostrophe before it."""
    parts = np.zeros((8, 8), bool)
    parts[_SPACE, _LETTER : _OTHER + 1] = True
    parts[_LETTER, _DIGIT : _APOSTROPHE + 1] = True
    parts[_DIGIT, _LETTER : _APOSTROPHE + 1] = True
    parts[_SIGN, _LETTER : _DIGIT + 1] = True
    parts[_APOSTROPHE, _DIGIT] = True
    return parts.ravel()


_KINDS, _PARTS = _kinds(), _parts()
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _byte_letters() -> str:
    """The letter that byte-level models have for each byte, but a space stays one."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in own else next(rest)) for b in range(256)).replace(chr(288), " ")


_LETTERS = _byte_letters()


class WordEncoder:
    """Ids of whole texts as little-endian uint32. The tokenizer lower-cases and never joins characters across white
    space, beside a digit or between a letter and a sign after it, so the ids of a text are those of its runs in turn.
    Runs are told on the bytes of many texts at once; each different one is encoded once, and remembered as long as the
    worker lives."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        # The model alone, for plain runs: the last token of each is told by its suffix.
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        vocab, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    @classmethod
    @functools.cache
    def of(cls, path: str) -> "WordEncoder":
        return cls(path)

    @staticmethod
    def runs(bodies: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The runs of the texts in turn, and how many the texts have up to the end of each."""
        raw = np.frombuffer(b"".join(bodies), np.uint8)
        lengths = np.array([len(t) for t in bodies], np.int64)
        ends = np.cumsum(lengths)
        low, kinds = _LOWER[raw], _KINDS[raw]
        at = np.flatnonzero(raw[:-1] == 0xC3) + 1  # the second bytes of Latin-1's letters and of two signs
        at = at[(raw[at] | 0x20) != 0xB7]
        kinds[at] = kinds[at - 1] = _LETTER
        low[at] |= np.where(raw[at] < 0x9F, 0x20, 0).astype(np.uint8)
        begins = np.empty(len(raw), bool)
        begins[:1] = True
        np.take(_PARTS, kinds[:-1] << 3 | kinds[1:], out=begins[1:])
        begins[(ends - lengths)[lengths > 0]] = True
        black = kinds != _SPACE
        begins &= black
        starts = np.flatnonzero(begins[black])
        low = low[black]
        offsets = np.append(starts, len(low))
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(low)])
        return found.dictionary_encode(), np.searchsorted(np.flatnonzero(begins), ends)

    def _learn(self, new: list[bytes]) -> None:
        """Remember the ids of different runs that hold no white space."""
        plain = [w for w in new if _PLAIN.fullmatch(w)]
        for a in range(0, len(plain), 256):
            some = plain[a : a + 256]
            joined = codecs.charmap_decode(b" ".join(some), "strict", _LETTERS)[0]
            ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(self.last[ids]) + 4).tolist()
            self.known.update((w, raw[a:z]) for w, a, z in zip(some, [0, *ends[:-1]], ends, strict=True))
        rest = [w.decode() for w in new if w not in self.known]
        for a in range(0, len(rest), 1_024):
            self._learn_words(rest[a : a + 1_024])

    def _learn_words(self, new: list[str]) -> None:
        joined = " ".join(new)
        if not unicodedata.is_normalized("NFC", joined) or "<|" in joined:
            self.known.update((w.encode(), np.array(e.ids, "<u4").tobytes()) for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True))
            return
        e = self.tokenizer.encode(joined, add_special_tokens=False)
        raw, starts = np.array(e.ids, "<u4").tobytes(), np.array(e.offsets, np.int64).reshape(-1, 2)[:, 0]
        ends = 4 * np.searchsorted(starts, np.cumsum([len(w) + 1 for w in new]))
        self.known.update((w.encode(), raw[a:z]) for w, a, z in zip(new, [0, *ends.tolist()], ends.tolist(), strict=False))

    def _ids(self, runs: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        ids = list(map(self.known.get, runs))
        if None in ids:
            self._learn(list({w for w, i in zip(runs, ids, strict=True) if i is None}))
            ids = list(map(self.known.__getitem__, runs))
        return ids

    def encode(self, bodies: list[str]) -> list[bytes]:
        raw = [t.encode() for t in bodies]
        # Neither lowered nor parted but by white space: texts with combining marks, which normalisation may join to
        # letters, with the start of a special token, or with the one letter that lowers to a letter and a mark.
        marked = {i: WORD.findall(t) for i, t in enumerate(bodies) if _MARK_BYTES[np.frombuffer(raw[i], np.uint8)].any() and _MARKS.search(t)}
        found, counts = self.runs([b"" if i in marked else t for i, t in enumerate(raw)])
        ids = pa.array(self._ids(found.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(found.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1)[counts].tolist() if len(ids) else [0] * len(bodies)
        data = memoryview(data) if data else b""
        return [b"".join(self._ids([w.encode() for w in marked[i]])) if i in marked else bytes(data[a:z]) for i, (a, z) in enumerate(zip([0, *ends], ends, strict=False))]


def cut(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs(doc_id, text)``: full windows and a remainder; ``with_ids`` adds their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, step = WordEncoder.of(tokenizer_path), np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in batches:
            out, ids = [], []
            for key, raw in zip(b.column("doc_id").to_pylist(), encoder.encode(texts(b)), strict=True):
                raw += end
                for a in range(0, len(raw), step):
                    piece = raw[a : a + step]
                    out.append((key, a // 4, len(piece) // 4, zlib.crc32(piece), len(raw) // 4))
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").view(np.int32))
            cols = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 5
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=names + ["ids"] * with_ids)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def fill(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """Lengths and how many of each, from those that ``counts`` still has, whose sum is closest to ``room``."""
    reach, whole, before = 1, (1 << room + 1) - 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left, take = min(int(counts[length]), room // length), 1
        while left:  # bounded multiples as powers of two
            take = min(take, left)
            before.append((length, take, reach))
            reach |= reach << length * take & whole
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, held in reversed(before):
        if not held >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return list(used.items())


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; pieces of one length are taken in the order given."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    next_ = np.cumsum(counts) - counts  # position in order of the next piece of each length
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    for largest in range(capacity, 0, -1):
        while counts[largest]:
            counts[largest] -= 1
            pattern = dict(fill(counts, capacity - largest))
            counts[largest] += 1
            pattern[largest] = pattern.get(largest, 0) + 1
            times = min(int(counts[k]) // n for k, n in pattern.items())
            at = 0
            for length, n in sorted(pattern.items(), reverse=True):
                pieces = order[next_[length] : next_[length] + n * times].reshape(times, n)
                sequence[pieces] = made + np.arange(times)[:, None]
                offset[pieces] = at + length * np.arange(n)
                next_[length] += n * times
                counts[length] -= n * times
                at += n * length
            made += times
    return sequence, offset


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to written ``pieces``."""
    groups = max(1, -(-pieces.count() // GROUP))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "doc_tokens"), F.lit(groups)))
    dealt = dealt.repartition("pack_group").sortWithinPartitions("pack_group", "length", "doc_id", "start", "ids_crc32")

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        sequence, offset = pack_lengths(t["length"].to_numpy(), capacity)
        t = t.append_column("sequence_id", pa.array(sequence + (t["pack_group"][0].as_py() << 32))).append_column("offset", pa.array(offset))
        return t.drop_columns(["pack_group"]).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            group = b.column("pack_group").to_numpy()
            for part in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1):
                if not len(part):
                    continue
                rows = b.slice(part[0], len(part))
                if held and held[0].column("pack_group")[0].as_py() != group[part[0]]:
                    yield packed(held)
                    held = []
                held.append(rows)
        if held:
            yield packed(held)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces of ``docs`` with their places in sequences of at most ``CAPACITY`` tokens."""
    small_batches(docs.sparkSession)
    return pack(scratch.written(cut(docs, tokenizer_path), "pieces"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
