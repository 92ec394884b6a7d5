"""Headline timings: one JSON line with seconds per query.

Every query runs once untimed, so JIT and file-system caches are warm, and then
once timed on a freshly built DataFrame into the no-op sink. The keyword queries
read a stored index, whose build is an entry of its own (``index_build``).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shelfmark.plans import checks  # noqa: E402
from shelfmark.plans.checks.search import build_index  # noqa: E402
from shelfmark.session import local_session  # noqa: E402

HEADLINE = (
    "jon_1_hybrid_mode", "jon_2_semantic_mode", "rnk_6_keyword_mode", "rnk_5_bm25_postings", "rnk_4_nearest",
    "snk_2_postings", "chk_5_parents", "chk_5_children", "txt_10_full_cleanup", "txt_9_quality_score",
    "stg_1_triage", "stg_3_meta_log", "src_9_probe", "agg_11_ordered_concat", "src_5_book_metadata", "jsn_4_map_warnings",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("shelfmark-bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    known = checks.queries()
    timings: dict[str, float] = {}
    for timed in (False, True):
        begin = time.perf_counter()
        build_index(spark, sf_dir)
        if timed:
            timings["index_build"] = round(time.perf_counter() - begin, 3)
    for name in HEADLINE:
        for timed in (False, True):
            begin = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if timed:
                timings[name] = round(time.perf_counter() - begin, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
