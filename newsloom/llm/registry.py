"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat_format, exact_dedup, lattice_lm, minhash_dedup, packing, quality_classifier, quality_rules, sharding, substring_dedup

MODULES = [lattice_lm, quality_rules, packing, exact_dedup, substring_dedup, chat_format, sharding, bpe, quality_classifier, minhash_dedup]
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
