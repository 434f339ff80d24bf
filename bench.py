"""Seconds per headline query, printed as one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Each query runs once to warm up and then twice;
the faster run counts. All result columns are computed (written to a sink that discards them).
"""

from __future__ import annotations

import json
import os
import time

from rillstone import session
from rillstone.plans import catalog

HEADLINE = [
    "lr_parse_positions",
    "lr_average_speed",
    "lr_lav",
    "lr_lav_running",
    "lr_count_vehicles",
    "lr_segment_changes",
    "lr_toll",
    "lr_last_toll",
    "lr_as_run_total",
    "vs_new_callee",
    "vs_global_acd",
    "vs_ecr",
    "vs_ct24",
    "vs_rcr",
    "vs_acd",
    "vs_fofir",
    "vs_score",
    "vs_variant_reordering",
    "vs_variant_forwarding",
    "syn_chain_counts",
    "met_count_per_second",
    "met_summary",
    "ana_trim",
    "ana_latency_percentiles",
    "ana_two_level_mean",
    "ana_weighted_latency",
]


def seconds(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = session.local(cpus)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    registered = catalog.queries()
    times = {}
    for name in HEADLINE:
        seconds(spark, registered[name], sf_dir)
        times[name] = round(min(seconds(spark, registered[name], sf_dir) for _ in range(2)), 3)
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "events_per_second": {name: round(events / t) for name, t in times.items()},
        "events": events,
        "cpus": cpus,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
