"""How good found neighbours and labels are. Found and true neighbours are (qid, rank, id, dist)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distances import ratio


def recall(found: DataFrame, true: DataFrame, k: int | None = None) -> DataFrame:
    """One row (hits, total, recall): the share of true neighbours (of the first k) that were found."""
    if k is not None:
        found, true = found.where(F.col("rank") <= k), true.where(F.col("rank") <= k)
    hits = true.join(found.select("qid", "id", F.lit(1).alias("hit")).distinct(), ["qid", "id"], "left")
    return hits.agg(F.count("hit").alias("hits"), F.count("*").alias("total")).withColumn("recall", F.col("hits") / F.col("total"))


def precision(found: DataFrame, true: DataFrame) -> DataFrame:
    """(qid, precision): the overlap of the id sets over the number of true ones."""
    a = found.groupBy("qid").agg(F.collect_set("id").alias("f"))
    b = true.groupBy("qid").agg(F.collect_set("id").alias("t"))
    return b.join(a, "qid", "left").select("qid", (F.size(F.array_intersect(F.coalesce("f", F.array().cast("array<bigint>")), "t")) / F.size("t")).alias("precision"))


def positional_accuracy(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row (same, total, accuracy): ranks at which found and true neighbour are the same."""
    both = true.select("qid", "rank", "id").join(found.select("qid", "rank", F.col("id").alias("found")), ["qid", "rank"], "left")
    return both.agg(F.count(F.when(F.col("id") == F.col("found"), 1)).alias("same"), F.count("*").alias("total")).withColumn("accuracy", F.col("same") / F.col("total"))


def distance_ratio(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row (ratio): mean of found over true distance at equal rank; 0 over 0 is 1."""
    both = true.select("qid", "rank", F.col("dist").alias("t")).join(found.select("qid", "rank", F.col("dist").alias("f")), ["qid", "rank"])
    return both.agg(F.avg(ratio(F.col("f"), F.col("t"))).alias("ratio"))


def found_total(found: DataFrame) -> DataFrame:
    """One row (n): the number of found neighbours, a row each, or counted by query in a column n."""
    return found.agg((F.coalesce(F.sum("n"), F.lit(0)) if "n" in found.columns else F.count("*")).alias("n"))


def label_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (mismatches, total) of two tables (id, label)."""
    both = a.select("id", F.col("label").alias("x")).join(b.select("id", F.col("label").alias("y")), "id")
    return both.agg(F.count(F.when(~F.col("x").eqNullSafe(F.col("y")), 1)).alias("mismatches"), F.count("*").alias("total"))


def accuracy(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (accuracy) in percent: predicted is (qid, label), labels (id, label)."""
    both = predicted.select(F.col("qid").alias("id"), F.col("label").alias("p")).join(labels.select("id", "label"), "id")
    return both.agg((F.avg((F.col("p") == F.col("label")).cast("double")) * 100).alias("accuracy"))


def checks_for_precision(search: Callable[[int], DataFrame], true: DataFrame, targets: list[float], first: int = 1, most: int = 1 << 20, within: float = 0.001) -> list[tuple[float, int, float]]:
    """(target, checks, reached) per target: the budget is doubled until the recall suffices and then bisected."""
    known: dict[int, float] = {}

    def reached(checks: int) -> float:
        if checks not in known:
            known[checks] = recall(search(checks), true).first()["recall"] or 0.0
        return known[checks]

    out = []
    for target in targets:
        high = first
        while reached(high) < target and high < most:
            high = min(2 * high, most)
        low = high // 2
        while high - low > 1 and abs(reached(high) - target) > within:
            middle = (low + high) // 2
            low, high = (low, middle) if reached(middle) >= target else (middle, high)
        out.append((target, high, reached(high)))
    return out
