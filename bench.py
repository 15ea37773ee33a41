"""Benchmark: run the registered queries on one scale factor and print one
JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_QUERIES (comma list; default every registered query).
Each query runs to completion with a ``noop`` write (the whole plan
executes, nothing is collected to the driver)."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans.registry import load_all  # noqa: E402
from quarry.session import build_session  # noqa: E402
from quarry.sources.tables import SPREAD_CONF  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus)
    spark.conf.set(SPREAD_CONF, str(cpus))
    reg = load_all()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(reg)
    # warm the JVM and the Python workers once (not timed)
    reg["topic_sizes"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001
            failed[name] = type(e).__name__
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf.group(1)) if sf else sf_dir, "cpus": cpus,
           "n_queries": len(times)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))


if __name__ == "__main__":
    main()
