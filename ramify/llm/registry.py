"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import clusters, embeddings, fingerprints, language, lines, minhash, mixing, search, secrets, sentencepiece, shards, suffixes, toxicity

MODULES = [lines, mixing, embeddings, secrets, fingerprints, toxicity, language, sentencepiece, minhash, suffixes, clusters, shards, search]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in MODULES for name, sql in m.SQL.items()}
