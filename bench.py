"""Time the registered queries over ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``$BENCH_QUERIES`` (names separated by commas) limits the run while iterating.
"""

from __future__ import annotations

import json
import os
import time

from sparkweft.plans.catalog import QUERIES
from sparkweft.session import build_session

def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(QUERIES)
    spark = build_session("bench", f"local[{cpus}]", int(cpus) * 2, **{"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start-up is not part of the first query
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
