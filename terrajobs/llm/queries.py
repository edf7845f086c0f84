"""Registered queries of the subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from terrajobs.llm import bpe_trie, exact_dedup, fingerprints, hard_negatives, language, line_dedup, mixing, quality, quality_rules, simhash_segments, source_audit, url_filter, warc

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_simhash_near_dedup": simhash_segments.op4_simhash_near_dedup,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_document_fingerprints": fingerprints.op6_document_fingerprints,
    "op7_mix_sources": mixing.op7_mix_sources,
    "op8_warc": warc.op8_warc,
    "op9_bpe": bpe_trie.op9_bpe,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_source_audit": source_audit.op13_source_audit,
}

SQL = {
    "op3_line_dedup": line_dedup.SQL,
    "op5_url_filter": url_filter.SQL,
    "op8_warc": warc.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_source_audit": source_audit.SQL,
}
