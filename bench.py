"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR  tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
Each query runs once to warm up and then twice; the better time counts. Results are written to
Spark's no-op sink, so every column of every row is computed and none passes the driver.
"""

from __future__ import annotations

import json
import os
import time

from checks.compare import session
from checks.queries import QUERIES

HEADLINE = ["vector_topk", "chunk_text", "token_bucket", "mask_pii", "ingest_documents"]


def run(fn, spark, sf) -> float:
    start = time.time()
    fn(spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = session(int(os.environ.get("BENCH_CPUS", "8")))
    times = {}
    for name in names:
        run(QUERIES[name], spark, sf)
        times[name] = round(min(run(QUERIES[name], spark, sf) for _ in range(2)), 3)
    spark.stop()
    print(json.dumps({"metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
