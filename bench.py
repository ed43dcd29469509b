"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS].

The domain tables are bound from the driver tables and stored once
(``store_tables``, reported as its own entry); each query then runs on
the stored tables.

Each query is fully computed with the ``noop`` sink (no collect to the
driver).  Prints ONE JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from innkeep.registry import registry  # noqa: E402
from innkeep.session import build_session  # noqa: E402
from innkeep.sources.bindings import load_tables  # noqa: E402
from innkeep.sources.store import load_stored, store_tables  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    spark = build_session(cpus=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")),
                          app="innkeep-bench")
    T = load_tables(spark, sf_dir)
    times = {}
    errors = {}
    # bind the driver tables to the domain model once and store them (timed);
    # queries then read the stored tables, as they would in a deployment.
    # BENCH_STORED=0 runs every query on the lazily bound tables instead.
    if os.environ.get("BENCH_STORED", "1") != "0":
        t0 = time.time()
        base = store_tables(spark, T)
        T = load_stored(spark, base, T["_raw"])
        times["store_tables"] = round(time.time() - t0, 3)
    for name, (fn, _sql) in registry().items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            fn(T).write.format("noop").mode("overwrite").save()
        except Exception as e:  # noqa: BLE001 - one failing query must not hide the others
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
            print(f"# {name}: FAILED {errors[name]}", file=sys.stderr)
            continue
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus, "errors": errors,
                      "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}))


if __name__ == "__main__":
    main()
