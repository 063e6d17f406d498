"""Corpus operators for training-data pipelines, and their registered queries."""

from __future__ import annotations

from . import automata, decontamination, exact_dedup, hard_negatives, license_scan, line_dedup, mixing, ngram_join, quality, spelling, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_warc": warc.op2_warc,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_mixing": mixing.op5_mixing,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_spelling": spelling.op12_spelling,
    "op13_substring_dedup": automata.op13_substring_dedup,
}
# SQL exists where it can state the result; the other queries are tested against brute force.
ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op4_decontamination": decontamination.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op8_license_scan": license_scan.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
}
