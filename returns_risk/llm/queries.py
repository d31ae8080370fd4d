"""Registered queries of the subpackage, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from returns_risk.llm import (
    decontaminate, licenses, lm_scoring, mixing, near_dedup, packing, personal_data, phrases, quality, secrets,
    token_counts, trie, warc,
)
from returns_risk.llm.oracle import ORACLE_SQL

QUERIES = {
    "op1_secret_scans": secrets.op1_secret_scans,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
    "op4_mixing_sources": mixing.op4_mixing_sources,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_warc": warc.op7_warc,
    "op8_license_scans": licenses.op8_license_scans,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_pii": personal_data.op10_pii,
    "op11_conversation_trie": trie.op11_conversation_trie,
    "op12_best_fit_packing": packing.op12_best_fit_packing,
    "op13_phrase_collocations": phrases.op13_phrase_collocations,
}
