"""Times the headline queries and prints one JSON line.

Sources are derived once and timed apart. Results are forgotten before every
query, so each computes all of its own stages, and a query's time covers the
write of its full result.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerloom.plans.catalog import QUERIES, forget, tables  # noqa: E402
from ledgerloom.runtime import build_session  # noqa: E402

HEADLINE = (
    "candidate_edges", "edge_audit", "greedy_assignment", "mutual_best_match", "exact_id_match", "fuzzy_match",
    "reconcile_cascade", "exception_reasons_coarse", "replay_dedup", "idempotent_increment", "review_queue",
    "ledger_duplicates", "case_types", "blocking_efficiency",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "ledgerloom-bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"), spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    started = time.perf_counter()
    source = tables(spark, folder)
    for name in ("legs", "lines", "ledger", "truth"):
        getattr(source, name)
    seconds = {"derive_sources": round(time.perf_counter() - started, 3)}
    for name in HEADLINE:
        forget()
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "reconciliation_headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
