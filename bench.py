"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and executed into Spark's ``noop`` sink (the full plan
runs, nothing is pulled to the driver).  The session start and a warm-up
(the search and a text query on the smallest tables, to start the JIT and the
Python workers) are excluded; every timed query recomputes its inputs from
the parquet tables (no reuse between queries).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["mips_topk", "gaussian_topk", "score_matrix", "hard_negatives", "score_groups", "eval_all",
            "train_groups", "distill_kl", "token_offsets", "ngram_counts", "entity_groups", "encode_hashed",
            "mining_round"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]] or HEADLINE
    from dpmine.session import get_spark
    from dpmine.plans.catalog import QUERIES
    spark = get_spark(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, app="dpmine-bench",
                      extra={"spark.driver.memory": "16g", "dpmine.text.partitions": cpus if cpus.isdigit() else "8"})
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in ("mips_topk", "hard_negatives", "token_count"):                            # warm-up
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
