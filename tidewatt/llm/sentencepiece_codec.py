"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; its normaliser, white-space marker, scores (as a unigram model, or as the
merges that the scores of a BPE model stand for) and byte fallback are rebuilt with the library. Where no
piece has the marker after another character, text is encoded by the runs between markers, which are encoded
once in batches and remembered; else whole texts are encoded. ``parity`` says whether the
SentencePiece library finds the same ids: by runs, each distinct run is compared when it is learned and a row has
parity if all of its runs have; else whole rows are compared. A distinct run's ids are decoded then too: a row whose
runs all come back is what they make up, any other is decoded as a whole.

Null and empty texts have no ids. Rows are handled one by one, so repeated rows, ties and empty tables need no
care; existing columns with an output's name are replaced, all others are kept.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, small_batches, table, texts

MARK = "▁"
# Fixed values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Encoded runs that a Python worker remembers, and runs encoded at once.
REMEMBERED, AT_ONCE = 1 << 19, 1_024


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, raw[at : at + n]
            at += n


@dataclass
class Model:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True

    @classmethod
    def load(cls, path: str) -> "Model":
        model = cls()
        with open(path, "rb") as f:
            for number, value in fields(f.read()):
                if number == 1:
                    p = dict(fields(value))
                    model.pieces.append((p.get(1, b"").decode(), struct.unpack("<f", p.get(2, bytes(4)))[0], p.get(3, NORMAL)))
                elif number == 2:
                    t = dict(fields(value))
                    model.kind, model.byte_fallback = t.get(3, UNIGRAM), bool(t.get(35, 0))
                elif number == 3:
                    n = dict(fields(value))
                    model.charsmap, model.dummy_prefix, model.trim_spaces, model.escape_spaces = n.get(2, b""), bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
        if model.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        return model

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs whose union is a piece, best score first; earlier pieces first among equals."""
        plain = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED)}
        found = [(-self.pieces[i][1], i, p[:k], p[k:]) for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
        return [(a, b) for *_, a, b in sorted(found, key=lambda x: x[:2])]


class Codec:
    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        self.model = m = Model.load(path)
        unknown = m.pieces[m.unknown][0]
        if m.kind == UNIGRAM:
            core = models.Unigram([(p, s) for p, s, _ in m.pieces], m.unknown, m.byte_fallback)
        else:
            core = models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, m.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=m.byte_fallback)
        self.tokenizer = Tokenizer(core)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.trim_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if m.dummy_prefix:
            steps.append(normalizers.Prepend(MARK if m.escape_spaces else " "))
        if m.escape_spaces:
            steps.append(normalizers.Replace(" ", MARK))
        self.normalizer = normalizers.Sequence(steps)
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.by_runs = not any(inner.search(p) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))
        self.run = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+") if self.by_runs else re.compile(r"(?s).+")
        if self.by_runs:
            self.tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(self.run.pattern), "isolated")
        #: Without a character map and trimming the normaliser only marks spaces, which a string can do itself.
        self.plain = m.escape_spaces and not m.charsmap and not m.trim_spaces
        self.compares_runs = self.by_runs and self.plain and m.dummy_prefix
        self.known: dict[str, bytes] = {}
        #: With ``theirs``, the SentencePiece library's model, runs whose ids differ, and runs that ids don't bring back.
        self.theirs, self.unlike, self.odd = None, set(), set()
        self.marked = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        self.letter = self.tokenizer.encode(MARK + "a", add_special_tokens=False).ids

    @classmethod
    @functools.cache
    def of(cls, path: str) -> "Codec":
        """One codec for the worker's life, so that it keeps what it knows."""
        return cls(path)

    @classmethod
    @functools.cache
    def checked(cls, path: str) -> "Codec":
        """One that compares with the SentencePiece library."""
        import sentencepiece

        codec = cls(path)
        codec.theirs = sentencepiece.SentencePieceProcessor(model_file=path)
        return codec

    def _compare_joined(self, part: list[str], ids: np.ndarray) -> bool:
        """Whether both libraries agree on runs with one mark each, joined, and their ids, after a letter's, bring them back.
        Only the runs' first ids are marked, so what is equal joined is equal by runs."""
        body = "".join(part).replace(MARK, " ")
        theirs = np.array(self.theirs.encode(body[1:]), "<u4")  # the library puts a mark before a text
        return np.array_equal(theirs, ids) and self.tokenizer.decode(self.letter + ids.tolist(), skip_special_tokens=False) == "a" + body

    def _compare(self, new: list[str]) -> None:
        """The library puts a mark before a text, so a run goes without its first; runs of marks alone follow a letter."""
        bare = [r for r in new if not r.strip(MARK)]
        full = [r for r in new if r.strip(MARK)]
        for part in (full[a : a + AT_ONCE] for a in range(0, len(full), AT_ONCE)):
            found = self.theirs.encode([r[1:].replace(MARK, " ") for r in part], num_threads=1)
            self.unlike.update(r for r, x in zip(part, found, strict=True) if np.array(x, "<u4").tobytes() != self.known[r])
        letter = self.theirs.encode("a")
        for r in bare:
            found = self.theirs.encode("a" + r.replace(MARK, " "))
            if found[: len(letter)] != letter or np.array(found[len(letter) :], "<u4").tobytes() != self.known[r]:
                self.unlike.add(r)
        for part in (new[a : a + AT_ONCE] for a in range(0, len(new), AT_ONCE)):
            back = self.tokenizer.decode_batch([self.letter + np.frombuffer(self.known[r], "<u4").tolist() for r in part], skip_special_tokens=False)
            self.odd.update(r for r, x in zip(part, back, strict=True) if x != "a" + r.replace(MARK, " "))

    def parity(self, bodies: list[str], runs: list[list[str]], ids: list[np.ndarray]) -> list[bool]:
        if self.compares_runs:
            return [not self.unlike or self.unlike.isdisjoint(r) for r in runs]
        theirs = self.theirs.encode(bodies, num_threads=1)
        return [len(x) == len(y) and bool((x == np.array(y, "<u4")).all()) for x, y in zip(ids, theirs, strict=True)]

    def normalize(self, text: str) -> str:
        if self.plain:
            return (MARK if self.model.dummy_prefix and text else "") + text.replace(" ", MARK)
        return self.normalizer.normalize_str(text) if text else ""

    def _learn(self, new: list[str]) -> None:
        """Runs with one mark, before other characters, stay apart when joined, and are told apart by their first ids."""
        compares = self.theirs and self.compares_runs
        joined, apart = [], [] if self.by_runs else new
        for r in new if self.by_runs else []:
            (joined if r[0] == MARK and r[-1] != MARK and r.count(MARK) == 1 else apart).append(r)
        parts = [joined[a : a + AT_ONCE] for a in range(0, len(joined), AT_ONCE)]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(["".join(p) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            starts = np.flatnonzero(self.marked[ids])
            if len(starts) != len(part):  # the model has no piece for the mark
                apart += part
                continue
            raw, ends = ids.tobytes(), [*(4 * starts[1:]).tolist(), 4 * len(ids)]
            self.known.update((r, raw[a:z]) for r, a, z in zip(part, [0, *ends[:-1]], ends, strict=True))
            if compares and not self._compare_joined(part, ids):
                self._compare(part)
        for a in range(0, len(apart), AT_ONCE):
            part = apart[a : a + AT_ONCE]
            self.known.update((r, np.array(e.ids, "<u4").tobytes()) for r, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True))
        if compares and apart:
            self._compare(apart)

    def runs(self, bodies: list[str]) -> list[list[str]]:
        return [self.run.findall(self.normalize(t)) for t in bodies]

    def encode(self, bodies: list[str], runs: list[list[str]] | None = None) -> list[np.ndarray]:
        runs = self.runs(bodies) if runs is None else runs
        if len(self.known) > REMEMBERED or not self.by_runs:
            self.known.clear()
            self.unlike.clear()
            self.odd.clear()
        self._learn(list(set().union(*runs).difference(self.known)))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, r)), "<u4") for r in runs]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.tokenizer.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def decoded(self, runs: list[list[str]], ids: list[np.ndarray]) -> list[str]:
        """``decode`` of rows that have just been encoded and compared: those without odd runs are the runs after the first mark."""
        if not (self.theirs and self.compares_runs):
            return self.decode(ids)
        whole = [bool(self.odd) and not self.odd.isdisjoint(r) for r in runs]
        back = iter(self.decode([x for x, w in zip(ids, whole, strict=True) if w]) if any(whole) else ())
        return [next(back) if w else "".join(r)[1:].replace(MARK, " ") for r, w in zip(runs, whole, strict=True)]


def encode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Add ``ids``."""
    held: list[Codec] = []

    def run(b: pa.RecordBatch) -> list:
        if not held:
            held.append(Codec.of(model_path))
        return [pa.array([x.view(np.int32) for x in held[0].encode(texts(b, text))], pa.list_(pa.int32()))]

    return map_batches(df, run, [("ids", T.ArrayType(T.IntegerType()))])


def decode(df: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """Add ``decoded``; null ids count as none."""
    held: list[Codec] = []

    def run(b: pa.RecordBatch) -> list:
        if not held:
            held.append(Codec.of(model_path))
        return [held[0].decode([np.array(x or [], np.int64) for x in b.column(ids).to_pylist()])]

    return map_batches(df, run, [("decoded", T.StringType())])


def check(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Encode and decode in one pass: ``n_ids, ids_crc32, decoded`` and ``parity`` with the SentencePiece library."""
    held: list[Codec] = []

    def run(b: pa.RecordBatch) -> list:
        if not held:
            held.append(Codec.checked(model_path))
        bodies = texts(b, text)
        runs = held[0].runs(bodies)
        ids = held[0].encode(bodies, runs)
        return [[len(x) for x in ids], [zlib.crc32(x.tobytes()) for x in ids], held[0].decoded(runs, ids), held[0].parity(bodies, runs, ids)]

    return map_batches(df, run, [("n_ids", T.LongType()), ("ids_crc32", T.LongType()), ("decoded", T.StringType()), ("parity", T.BooleanType())])


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents; parity is checked on every row."""
    import public_tokenizers

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    done = check(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return done.select("doc_id", "n_ids", "ids_crc32", F.sha2("decoded", 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"), "parity")
