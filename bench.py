"""Times the headline queries, all rows written to the noop sink.

One warm-up run, then the median of two; queries that train a model run once.
"""

import json
import os
import statistics
import time

from check import session
from returns_risk.plans.queries import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = (
    "retail_summary", "keyword_counts", "ticket_sentiment", "keyword_counts_long_text", "link_tickets",
    "features", "features_linked", "scored", "score_new", "reasons_rules", "stratified_split", "roc_auc",
    "linear_shapley", "gbt_scored", "gbt_shapley",
)


def seconds(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = [seconds(spark, name) for _ in range(1 if name.startswith("gbt") else 3)]
        times[name] = round(statistics.median(runs[1:] or runs), 3)
    print(json.dumps({
        "metric": "sum of headline query times", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
