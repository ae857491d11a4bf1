"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "r1_dense_topk",
    "r2_sparse_topk",
    "r3_rrf",
    "r6_hybrid_search",
    "r7_hybrid_search_no_rerank",
    "r9_scoped_search",
    "r10_search_approx",
    "e4_lexical_weights",
    "e2_encode",
    "c6_line_windows",
    "c11_token_count",
    "c12_chunk_markdown",
    "c13_chunk_code",
    "p1_symbol_outline",
    "j1_detect_changes",
    "j7_index_corpus",
    "a1_context_window",
    "a7_trim_newest",
    "st1_rate_limit",
    "st1_rate_limit_stream",
    "st4_idle_timeouts",
    "st7_parse_event_log",
    "m1_duration_histogram",
    "m2_latency_quantiles",
]


def index_runs(spark, sf_dir: str) -> dict[str, float]:
    """First indexing run over all documents, then the same scan again."""
    from pyspark.sql import functions as F

    from corpusq.functions.encoders import hashed_encoder
    from corpusq.operators import indexing
    from corpusq.plans.indexing import scanned
    from corpusq.session import cut_lineage

    files = scanned(spark, sf_dir).drop("content_hash")
    tables, took = indexing.empty_tables(spark), {}
    for name in ("index_first_run", "index_unchanged_rerun"):
        start = time.perf_counter()
        tables, results = indexing.index_files(
            files, tables, hashed_encoder(), "hashed-64", F.lit("main")
        )
        results.write.format("noop").mode("overwrite").save()
        for part in ("files", "chunks", "vectors", "cache"):
            setattr(tables, part, cut_lineage(getattr(tables, part)))
        took[name] = time.perf_counter() - start
    return took


def main() -> None:
    from corpusq import build_session, plans

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    registered = plans.queries()
    # Start the JVM's compiler and the Python workers before the clock runs.
    registered["r2_sparse_topk"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = time.perf_counter() - start
    took |= index_runs(spark, sf_dir)
    took = {name: round(seconds, 3) for name, seconds in took.items()}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
