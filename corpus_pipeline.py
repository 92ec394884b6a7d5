"""The corpus pipeline: rules, line dedup, near duplicates, benchmark leaks, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns the documents for the next stage (the last one: the packed pieces). Each
stage's result is written and read again, so a lost executor costs a reread.
"""

from __future__ import annotations

from shelfmark.llm import decontam, jaccard, linededup, packing, quality
from shelfmark.llm.common import table, written

STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", linededup.stage),
    ("near_duplicates", jaccard.stage),
    ("decontamination", decontam.stage),
    ("packing", packing.stage),
]

# Hashes and a tokenizer are outside SQL; tests/llm compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
