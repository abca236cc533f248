"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from locusframe.llm import decontaminate, embeddings, html_text, jaccard, langid, line_dedup, mixing, secrets, sharding, warc

_MODULES = (decontaminate, secrets, warc, line_dedup, langid, mixing, html_text, embeddings, jaccard, sharding)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
