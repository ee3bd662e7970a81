"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "scan_concat_json",
    "token_normalize",
    "sample_per_file",
    "build_vocab",
    "tfidf_smooth",
    "document_search",
    "vocab_growth",
    "duplicate_vectors",
    "covariance",
    "whiten_transform",
    "tlda_top_words",
    "infer_doc_topics",
    "coherence_npmi",
    "lexicon_in_docs",
    "anchored_weeks",
    "kmeans",
    "lda_online",
    "knn_distances",
    "dbscan",
)


def main() -> None:
    from murmuration.plans import all_queries
    from murmuration.session import clear_scratch, local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        start = time.perf_counter()
        all_queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
        clear_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
