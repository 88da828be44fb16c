"""Times the headline queries once each after a warm-up and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "fmax", "fmax_by_aspect", "ia_fmax", "micro_macro_f1", "samples_f1", "threshold_sweep", "error_table", "fuse_scores", "fusion_grid",
    "label_vocab", "eligible_by_scenario", "pos_weight", "numeric_summary", "hash_split", "top_terms", "weighted_rollup", "best_residue",
    "best_edge", "contact_edges", "edge_features", "graph_summary", "kmer_freq", "alphabet_filter", "chunk_windows", "mean_pool",
    "standardise", "linear_scores", "best_epoch", "early_stop", "fasta_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from protlake.catalog import QUERIES
    from protlake.session import build_session

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
