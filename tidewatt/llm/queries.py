"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import chat, minhash, mpegts, packing, quality, sentencepiece_codec, simhash, substrings, toxicity, warc

QUERIES = {f.__name__: f for f in (minhash.op1_minhash, toxicity.op2_toxicity, mpegts.op3_mpegts, simhash.op4_simhash, warc.op5_warc, substrings.op6_substrings, quality.op7_quality, sentencepiece_codec.op8_sentencepiece, packing.op9_packing, chat.op10_chat)}
ORACLE_SQL: dict[str, str] = {**warc.ORACLE, **substrings.ORACLE, **chat.ORACLE}
