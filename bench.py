"""Benchmark the headline queries.

Runs every query registered with ``bench=True`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]``.  Each query is executed to
completion through the ``noop`` sink (full computation, nothing collected), once
as warm-up and then ``$BENCH_REPS`` times; the median is reported.  Prints one
JSON line.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerlens.plans.registry import entries  # noqa: E402
from ledgerlens.session import get_session  # noqa: E402


#: Queries that do their work while they are built (they run a stream); building counts for them.
WORK_WHEN_BUILT = ("t3_live_summary",)


def run_once(name: str, build) -> float:
    t0 = time.perf_counter()
    df = build()
    if name not in WORK_WHEN_BUILT:
        t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus, app_name="ledgerlens-bench")
    selected = {n: e for n, e in entries().items() if (n in only if only else e.bench)}
    timings = {}
    for name, e in sorted(selected.items()):
        def build(e=e):
            return e.fn(spark, sf_dir)
        run_once(name, build)  # warm-up (JIT, file listing, Python workers)
        timings[name] = round(statistics.median(run_once(name, build) for _ in range(reps)), 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total_median",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf,
        "cpus": cpus,
        "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
        "reps": reps,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
