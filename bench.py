"""Times the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

NAMES = ["lexical_search", "bm25_content", "bm25_path", "knn_batch", "hybrid_search", "tokenize_tf", "chunk_text_windows", "chunk_markdown_sections", "inspect_profile", "graph_bfs", "change_detection", "change_feed_dedup"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quarry.plans import registry

    took = {}
    for name in NAMES:
        best = 1e9
        for _ in range(2):
            began = time.time()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took[name] = round(best, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    due = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    extra = {"index_docs_per_s": round(docs / (took["chunk_text_windows"] + took["tokenize_tf"])), "knn_queries_per_s": round(due / took["knn_batch"], 1)}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
