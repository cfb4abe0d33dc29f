"""Times the headline queries once each on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = ["decisions_gate_on", "run_summary", "resolve_batch", "fuzzy_company", "fuzzy_authority", "name_country_company", "successor", "knn_embedding", "node_similarity", "wcc_collapse", "bm25_topk", "perturbation_recall", "event_dispatch", "homonyms"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from kinfold.plans.queries import QUERIES

    names = sys.argv[1:] or HEADLINE
    QUERIES["event_dispatch"](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
