"""Time the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from markspan.plans.catalog import spark_queries  # noqa: E402
from markspan.session import build_session, set_local_folder  # noqa: E402

HEADLINE = (
    "x4_marked_candidates",
    "j2_key_driven_marks",
    "a7_marking_report",
    "f4_mcq_answer",
    "f7_normalised_answers",
    "u1_drawing_overlay",
    "f10_json_recovery",
    "f11_choice_extraction",
    "a1_submission_summary",
    "a2_status_counters",
    "a11_strict_summary",
    "f18_text_report",
    "f19_document_envelopes",
    "j11_exam_details",
    "w1_marked_options",
    "f23_layout_hash",
    "w4_latest_ten_events",
    "w5_running_progress",
    "w10_page_numbers",
    "x1_page_extraction",
    "r2_live_status",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    spark = build_session("markspan-bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    set_local_folder(spark, tempfile.mkdtemp)
    builds = spark_queries()
    cold, warm = {}, {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        for times in (cold, warm):
            start = time.perf_counter()
            builds[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(name, cold[name], warm[name], file=sys.stderr, flush=True)
    out = {
        "metric": "headline queries, warm seconds in total",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
