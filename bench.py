"""Seconds per headline query: prints one JSON line.

Each query runs to completion into the noop sink. Stage tables that several queries share
are built inside the first query that needs them, as in a pipeline run.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from workload import QUERIES

HEADLINE = [
    "run_preprocessing", "dedup_keep_last", "kcore_filter", "temporal_split", "build_id_map", "mean_center",
    "dataset_stats", "support_summary_user_id", "top_share_movie_id", "lorenz_curve_movie_id", "coverage_funnel",
    "build_imdb_features", "text_embed", "popularity", "history_embedding", "recency_history", "user_sequences",
    "sym_normalise", "propagate", "score_pairs", "top_k", "evaluate_popularity", "evaluate_model",
    "sample_triplets", "bpr_loss", "ease_gram", "als_fit", "als_half_step", "bpr_fit", "lightgcn_fit",
    "pairwise_ranker_fit",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_PARTITIONS", cpus))
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, seconds[name], flush=True)
    print(json.dumps({
        "metric": "total query time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
