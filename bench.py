"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "sam_scan", "pileup_expand", "coverage_depth", "joint_counts", "quality_histogram", "reference_lookup",
    "positions_semi", "region_overlap", "region_reads",
    "score_binomial", "score_beta_binomial", "score_quality", "somatic_calls", "classify_reads",
    "systematic_sample", "ess_binomial", "ess_quality", "train_binomial", "train_beta_binomial", "train_quality",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    from workload.compare import spark_session
    from workload.queries import QUERIES

    spark = spark_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the executors
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    line = {
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name,
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
