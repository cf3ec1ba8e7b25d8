"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from inkfall.llm import audio, bpe, embed_dup, html_text, license_scan, mixing, near_dup, quality, sharding, url_filter

_MODULES = (url_filter, license_scan, sharding, mixing, quality, bpe, html_text, near_dup, embed_dup, audio)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
