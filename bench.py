"""

Each query runs once to warm up, then $BENCH_RUNS times; the median wall
time per query is reported (result written to the ``noop`` sink, so the
full plan executes without collecting to the driver). Prints one JSON line.
Variants of these queries (missing keys, more fields) run once each and are
listed beside the sum, under ``variants``.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillspark.plans.registry import all_queries  # noqa: E402
from quillspark.session import build_session, clear_scratch  # noqa: E402


def is_variant(key: str) -> bool:
    return key not in ("e1-listing", "e2-prep") and re.fullmatch(r"[a-z]+-[a-z]?\d+", key) is None


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=2 * cpus)
    qs = all_queries()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for key in sorted(only or qs):
        samples = []
        try:
            for i in range(2 if is_variant(key) else runs + 1):
                t0 = time.perf_counter()
                qs[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
                if i > 0:
                    samples.append(time.perf_counter() - t0)
            times[key] = round(statistics.median(samples), 3)
        except Exception as e:  # noqa: BLE001
            failed[key] = f"{type(e).__name__}: {str(e)[:200]}"
        clear_scratch(spark)
        print(f"{key}: {times.get(key)}", file=sys.stderr, flush=True)
    sf = sf_dir.rsplit("sf", 1)[-1]
    variants = {k: t for k, t in times.items() if is_variant(k)}
    times = {k: t for k, t in times.items() if k not in variants}
    out = {"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "variants": variants, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir,
           "runs": runs, "spark": spark.version, "master": f"local[{cpus}]",
           "shuffle_partitions": 2 * cpus}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
