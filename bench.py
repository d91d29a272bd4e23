"""Benchmark: headline catalogue queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built fresh and executed in full with a ``noop`` write (no rows
are pulled into Python); the median of three timed runs after one warm-up is
reported. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tradetally.plans.registry import all_queries  # noqa: E402
from tradetally.session import build_session  # noqa: E402

HEADLINE = ["recon_summary", "recon_breaks", "duplicates_b", "dedup_first_b", "missing_in_b",
            "matched_pairs", "validate_rows", "validation_counts", "run_summary",
            "security_master", "content_sha256", "missing_trades", "duplicate_rows_b", "side_breaks",
            "severity_counts", "asset_class_tolerance"]


def run_once(spark, fn, sf_dir) -> float:
    t = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def exchanges(spark, fn, sf_dir) -> dict:
    """Exchanges of the physical plan by kind."""
    plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    kinds = {"hash": r"Exchange hashpartitioning", "range": r"Exchange rangepartitioning",
             "round_robin": r"Exchange RoundRobinPartitioning", "single": r"Exchange SinglePartition",
             "broadcast": r"BroadcastExchange"}
    return {k: len(re.findall(v, plan)) for k, v in kinds.items() if re.search(v, plan)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    driver_mem = os.environ.get("BENCH_DRIVER_MEM", "16g")
    spark = build_session(f"local[{cpus}]", int(cpus), extra={"spark.driver.memory": driver_mem})
    qs = all_queries()
    names = [n for n in HEADLINE if n in qs]
    run_once(spark, qs[names[0]], sf_dir)          # JVM / code cache warm-up
    out, ex = {}, {}
    for n in names:
        run_once(spark, qs[n], sf_dir)
        out[n] = round(statistics.median(run_once(spark, qs[n], sf_dir) for _ in range(reps)), 3)
        ex[n] = exchanges(spark, qs[n], sf_dir)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_median_query_sec", "value": round(sum(out.values()), 3),
                      "unit": "sec", "queries": out, "sf": sf, "cpus": int(cpus),
                      "shuffle_partitions": int(cpus), "driver_memory": driver_mem,
                      "reps": reps, "exchanges": ex}))
    spark.stop()


if __name__ == "__main__":
    main()
