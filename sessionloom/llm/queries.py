"""The registered queries of this subpackage, and their reference SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import (
    op1_quality, op2_bpe, op3_fingerprint, op4_html, op5_chat, op6_suffix, op7_langid, op8_decontam, op9_toxicity, op10_minhash, op11_exact,
    op12_runs, op13_whitening,
)

MODULES = [
    op1_quality, op2_bpe, op3_fingerprint, op4_html, op5_chat, op6_suffix, op7_langid, op8_decontam, op9_toxicity, op10_minhash, op11_exact,
    op12_runs, op13_whitening,
]
QUERIES = {name: build for m in MODULES for name, build in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()} | (
    {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
