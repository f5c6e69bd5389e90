"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from causerie.llm import chat, fingerprints, language, mixing, packing, sharding, simhash, topk, url_filter, warc

_MODULES = [fingerprints, packing, url_filter, sharding, topk, warc, chat, simhash, mixing, language]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
