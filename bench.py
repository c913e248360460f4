"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from blendspark.plans import QUERIES
from blendspark.session import local_session

HEADLINES = (
    "recipe_facts", "volume_fraction", "recipe_matrix", "parse_lines", "extract_brand", "match_taxonomy",
    "suggest_matches", "apply_mapping", "batch_gate", "ingredient_usage", "jaccard_pairs", "manhattan_pairs",
    "edit_distance_pairs", "knn_recipes", "tree_distance_pairs", "tree_emd_given_pairs",
    "substitution_weighted_given_pairs", "entropic_ot_pairs", "recipe_lines", "find_miss_runs", "negative_edges", "auc",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").count()  # start the executors
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
