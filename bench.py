"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from graphloom.queries import QUERIES

HEADLINE = ["match_4cycle", "match_star", "match_anchored_count", "match_typed_labelled", "undirected_adj", "graph_context", "degree_bucket", "bfs_ball_capped", "triangle_count", "clustering_coeff", "components", "esu_size4", "wl_hash_nodes", "iso_classes", "order_violation_pairs", "auroc", "size_rank_topk", "greedy_mine", "gnn_embed", "stream_sessions"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["graph_context"](spark, sf).count()  # the JVM's start is not a query's time
    took = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
