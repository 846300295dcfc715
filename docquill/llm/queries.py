"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from docquill.llm import decontaminate, licenses, line_crf, line_dedup, packing, quality_rules, secret_scan, simhash, spelling, token_counts, token_files, toxicity, whitening

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op1_line_dedup_by_length": line_dedup.query_by_length,
    "op2_secrets": secret_scan.query,
    "op3_simhash": simhash.query,
    "op4_packing": packing.query,
    "op5_token_counts": token_counts.query,
    "op6_token_files": token_files.query,
    "op7_licenses": licenses.query,
    "op7_licenses_in_prose": licenses.query_in_prose,
    "op8_decontaminate": decontaminate.query,
    "op9_line_crf": line_crf.query,
    "op10_quality_rules": quality_rules.query,
    "op11_toxicity": toxicity.query,
    "op12_spelling": spelling.query,
    "op13_whitening": whitening.query,
}

ORACLE = {
    "op7_licenses": licenses.ORACLE,
    "op1_line_dedup": line_dedup.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
}
