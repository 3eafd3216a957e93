"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

The index is built and written first, as its own figure. Rankings then run over the written index,
as they would in use. Every result is fully computed (noop sink), names and scores included.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def run(df):
    df.write.format("noop").mode("overwrite").save()


def seconds(action, repeats=REPEATS):
    """Median time after one warm-up run."""
    action()
    times = []
    for _ in range(repeats):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return statistics.median(times)


def main():
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    from termspire.operators import duplicates, lookup, rank, tokens
    from termspire.registered import fixtures

    timings = {}
    start = time.perf_counter()
    index = fixtures.document_index(spark, SF_DIR)
    timings["build_and_write_index_cold"] = time.perf_counter() - start
    plain = fixtures.hashed_index(spark, SF_DIR)
    raw, fixed = fixtures.raw_index(spark, SF_DIR), fixtures.fixed_index(spark, SF_DIR)
    # A second build, now that the virtual machine is warm.
    fixtures._made.clear()
    start = time.perf_counter()
    index = fixtures.document_index(spark, SF_DIR)
    timings["build_and_write_index"] = time.perf_counter() - start

    probes = fixtures.probe_queries(spark)
    passages = fixtures.benchmark_queries(spark, SF_DIR)
    turns = fixtures.table(spark, SF_DIR, "conversations").select(
        (tokens.F.col("conv_id") * 1000 + tokens.F.col("turn")).alias("qno"), "text"
    )
    # The same ten queries in one job, and in a job each.
    numbers = [row["qno"] for row in passages.select("qno").distinct().orderBy("qno").limit(10).collect()]
    ten = passages.where(tokens.F.col("qno").isin(numbers))
    each = [passages.where(tokens.F.col("qno") == n) for n in numbers]
    headline = {
        "rank_probe_top20": lambda: run(rank.bm25(index, probes, k=20)),
        "rank_probe_all": lambda: run(rank.bm25(index, probes)),
        "rank_probe_join_pruning": lambda: run(rank.bm25(index, probes, k=20, prune="join")),
        "rank_probe_no_pruning": lambda: run(rank.bm25(index, probes, k=20, prune=None)),
        "rank_probe_hash_layout": lambda: run(rank.bm25(plain, probes, k=20)),
        "rank_probe_term_lists": lambda: run(
            rank.bm25(index, probes, k=20, collapse_equal_scores=True)
        ),
        "rank_probe_filtered": lambda: run(rank.bm25_from_filtered(index, probes, k=20)),
        "rank_passages_top20": lambda: run(rank.bm25(index, passages, k=20)),
        "rank_passages_top20_docs_join": lambda: run(
            rank.bm25(index, passages, k=20, use_docs=True)
        ),
        "ten_passages_one_job": lambda: run(rank.bm25(index, ten, k=20)),
        "ten_passages_a_job_each": lambda: [run(rank.bm25(index, one, k=20)) for one in each],
        "rank_raw_copies_top20": lambda: run(rank.bm25(raw, probes, k=20)),
        "lookup_passages": lambda: run(lookup.lookup_terms(index, passages)),
        "tokenize_turns": lambda: run(tokens.tokenize_queries(turns, text="text")),
        "changed_lengths": lambda: run(duplicates.changed_lengths(raw, fixed)),
        "shrunk_terms": lambda: run(duplicates.shrunk_terms(raw, fixed)),
    }
    for name, action in headline.items():
        timings[name] = seconds(action)
    ranking = sum(v for k, v in timings.items() if k.startswith("rank_"))
    print(
        json.dumps(
            {
                "metric": "total_seconds_of_rankings",
                "value": round(ranking, 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in timings.items()},
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
