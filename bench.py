"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is timed from the given tables: the stages of the event pipeline are their own
entry (`pipeline_stages`), and what reads them afterwards is timed on top of it.
"""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracewell.plans import catalog  # noqa: E402
from tracewell.session import local_session  # noqa: E402

HEADLINE = (
    "citation_units", "unit_offsets", "section_slice", "bind_quotes", "ambiguous_quotes", "quote_candidates", "stitched_quotes", "row_fingerprints",
    "integrity_flags", "stability_class", "reconcile_issues", "progress_upsert", "history_cap", "flag_multiset_diff", "quote_grounding", "idle_gaps",
    "pipeline_stages", "payload_violations", "row_claim", "review_rows", "ledger_rows", "ledger_order", "run_metrics",
)


def stages(spark, folder):
    catalog.reset()
    for name in ("claims", "units", "bound", "flags"):
        catalog.staged(spark, folder, name)
    catalog.event_graph(spark, folder)
    return catalog.staged(spark, folder, "review")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus), app="bench")
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not a query
    times: dict[str, float] = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        query = stages if name == "pipeline_stages" else catalog.QUERIES[name]
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
