"""Benchmark: headline queries at one scale factor, one JSON line on stdout.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default: all cores), BENCH_RUNS (timed runs per query, default 3),
BENCH_QUERIES (comma-separated names; default: every registered query).
Each query runs once to warm up, then BENCH_RUNS times; the median is kept.
Results are written to Spark's no-op sink, so the whole plan executes but
nothing is collected to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from churnlab.plans.catalog import queries  # noqa: E402
from churnlab.session import local_session  # noqa: E402

HEADLINE = (
    "q02_sale_to_ticket_churn",
    "q06_repeat_ticket_3_segments_churn",
    "q19_reversal_ticket_churn",
    "q20a_reversal_no_call_churn",
    "q22_credit_note_resolution_churn",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    registry = queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(registry)
    unknown = [n for n in names if n not in registry]
    if unknown:
        print(f"bench: skipping unknown queries {unknown}", file=sys.stderr)
    names = [n for n in names if n in registry]

    spark = local_session(cores=cpus, shuffle_partitions=max(cpus, 2), driver_memory="16g")
    timings: dict[str, float] = {}
    for name in names:
        def once() -> float:
            t0 = time.perf_counter()
            registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once()  # warm-up: JIT, file listing, broadcast of small dimensions
        timings[name] = round(statistics.median(once() for _ in range(runs)), 3)

    head = [timings[n] for n in HEADLINE if n in timings]
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_query_latency_sum",
                "value": round(sum(head), 3),
                "unit": "sec",
                "queries": timings,
                "total_all_queries": round(sum(timings.values()), 3),
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
