"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores; BENCH_QUERIES (comma separated key
prefixes, or "all") chooses the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "p1_explode_lines", "p2_parse_entries", "p4_faces", "p13_art_briefs", "p17_file_stems",
    "j1_resolve_names", "j3_three_way_plan", "j4_plan_faces", "j5_art_reference", "j7_expected_and_read", "j10_held_out",
    "a1_corpus_summary", "a3_credits", "a4_compliance", "a5_job_progress", "a8_colour_profile",
    "w1_ordered_distinct", "w2_request_batches", "w4_longest_run", "w9_rules_tokens",
    "g1_layout_audit", "g2_text_proof", "g6_colour_identity", "g8_matte_gate", "g9_obstruction_gate", "g11_audit_by_mode",
    "i1_structure_metrics", "i4_trim_rectangle", "i5_ink_components", "i6_band_energy",
    "f1_normalised_texts", "s6_latest_write", "t1_live_progress",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES", "")

    from deckloom.plans import QUERIES
    from deckloom.session import local_session

    spark = local_session("deckloom-bench", cpus, os.environ.get("BENCH_MEMORY", "12g"))
    names = HEADLINE
    if chosen:
        names = [n for n in QUERIES if chosen == "all" or any(n.startswith(p) for p in chosen.split(","))]
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": sf, "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
