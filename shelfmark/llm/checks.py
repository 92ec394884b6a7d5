"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from shelfmark.llm import chat, decontam, jaccard, language, licenses, linededup, packing, periodic, quality, secrets, sharding, tokencount, whitening

QUERIES = {f.__name__: f for f in (
    packing.op1_best_fit, secrets.op2_forest, chat.op3_tool_calls, quality.op4_ngram_llr, decontam.op5_templates,
    licenses.op6_sentence_rules, tokencount.op7_offset_counts, sharding.op8_jump_hash, jaccard.op9_prefix_join,
    linededup.op10_winnowing, language.op11_profiles, periodic.op12_runs, whitening.op13_whitening,
)}

SQL: dict[str, str] = {"op6_sentence_rules": licenses.SQL}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
