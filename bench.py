"""Headline queries, timed warm; prints one JSON line.

Documents are rendered and stored before the clock starts, so a query's time is
the time from stored documents to its result.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from packetcheck.catalog import QUERIES  # noqa: E402
from packetcheck.session import build_session  # noqa: E402

HEADLINES = {
    "q1_rule_suite": "rule_verdicts",
    "q2_documents_to_verdicts": "documents_to_verdicts",
    "q3_registry_sheets": "registry_fields",
    "q4_stamps": "stamped_packets",
    "q5_ledger": "ledger_split",
    "q6_attachments": "attachment_choice",
    "q7_log_classes": "log_classes",
    "q8_summary_texts": "summary_records",
    "q9_report_rows": "report_rows",
    "q10_todo_items": "todo_items",
    "q11_recognition": "recognition_records",
}
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "packetcheck-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    times = {}
    for name, query in HEADLINES.items():
        if only and name not in only:
            continue
        QUERIES[query](spark, sf_dir)  # stores the documents the query reads
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[query](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(min(taken) if RUNS < 3 else statistics.median(taken), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
