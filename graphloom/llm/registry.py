"""The queries of this subpackage, for the driver."""

from __future__ import annotations

from graphloom.llm import chat_format, license_scan, lm_scoring, minhash, mixing, quality, sentencepiece_codec, simhash, suffix_dedup, url_filter

MODULES = (lm_scoring, license_scan, quality, sentencepiece_codec, suffix_dedup, simhash, url_filter, mixing, chat_format, minhash)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict:
    return {k: q for m in MODULES for k, q in getattr(m, "ORACLES", {}).items()}
