"""The queries of the corpus operators, and their SQL."""

from __future__ import annotations

from . import bpe, chat, chunks, fill_middle, hard_negatives, html_text, language, lines, near_dup, neighbours, packing, quality, toxicity

_MODULES = [chunks, packing, quality, neighbours, bpe, toxicity, chat, lines, near_dup, html_text, fill_middle, language, hard_negatives]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in getattr(m, "ORACLES", {}).items()}
