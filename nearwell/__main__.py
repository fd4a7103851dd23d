"""Benchmark of search methods on TEXMEX files: python -m nearwell BASE QUERIES TRUTH [-k 100] [--methods linear,kdtree] ..."""

from __future__ import annotations

import argparse
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import ship
from .operators import evaluate
from .operators.index import SearchParams, create
from .sources import records


def main(argv: list[str] | None = None) -> list[tuple[str, float, float]]:
    """(method, recall against the truth file, seconds) per method; also printed, and appended to --output as CSV lines."""
    p = argparse.ArgumentParser(prog="nearwell")
    p.add_argument("base")
    p.add_argument("queries")
    p.add_argument("truth")
    p.add_argument("-k", type=int, default=100)
    p.add_argument("--trees", type=int, default=4)
    p.add_argument("--checks", type=int, default=1000)
    p.add_argument("--limit", type=int, default=None, help="number of queries")
    p.add_argument("--methods", default="linear,kdtree", help="comma-separated index methods")
    p.add_argument("--output", default=None)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    read = lambda path, limit=None: records.read_texmex(spark, path, limit=limit).withColumn("v", F.col("v").cast("array<double>"))
    base, queries = read(a.base), read(a.queries, a.limit)
    truth = records.read_texmex(spark, a.truth, limit=a.limit).select(F.col("id").alias("qid"), F.posexplode("v").alias("rank", "id")).select("qid", (F.col("rank") + 1).alias("rank"), F.col("id").cast("long").alias("id"))
    out = []
    for method in a.methods.split(","):
        index = create(base, method, trees=a.trees).build()
        began = time.perf_counter()
        found = index.knn(queries, a.k, SearchParams(checks=a.checks)).cache()
        found.count()
        elapsed = time.perf_counter() - began
        out.append((method, evaluate.recall(found, truth, a.k).first()["recall"], elapsed))
        found.unpersist()
        print(f"{method}: recall {out[-1][1]:.4f}, {elapsed:.3f} s")
        if a.output:
            records.append_benchmark(a.output, os.cpu_count() or 1, method, elapsed)
    return out


if __name__ == "__main__":
    main()
