"""Classification by the votes of neighbours. Neighbours are (qid, rank, id, dist); labels are (id, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    return neighbours.join(labels.select("id", "label"), "id")


def with_payload(neighbours: DataFrame, base: DataFrame, *columns: str) -> DataFrame:
    """The neighbours themselves: further columns of the base beside (qid, rank, id, dist)."""
    return neighbours.join(base.select("id", *columns), "id").select("qid", "rank", "id", "dist", *columns)


def _first(scored: DataFrame, *order) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(*order)
    return scored.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def majority(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, label, votes): the most frequent label, ties to the smallest."""
    votes = labelled(neighbours, labels).groupBy("qid", "label").agg(F.count("*").alias("votes"))
    return _first(votes, F.desc("votes"), "label").select("qid", "label", "votes")


def majority_first_seen(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, label, votes): the most frequent label, ties to the one seen first in the training set (by id)."""
    seen = labels.groupBy("label").agg(F.min("id").alias("seen"))
    votes = labelled(neighbours, labels).groupBy("qid", "label").agg(F.count("*").alias("votes")).join(seen, "label")
    return _first(votes, F.desc("votes"), "seen").select("qid", "label", "votes")


def three_classes(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """(qid, c1, c2, c3, label, votes): the votes for label 1, label 2 and any other, and the winner (1, 2 or 3, ties to the smallest)."""
    counts = labelled(neighbours, labels).groupBy("qid").agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("c1", F.col("label") == 1), ("c2", F.col("label") == 2), ("c3", ~F.col("label").isin(1, 2)))])
    top = F.greatest("c1", "c2", "c3")
    label = F.when(F.col("c1") == top, 1).when(F.col("c2") == top, 2).otherwise(3)
    return counts.select("qid", "c1", "c2", "c3", label.alias("label"), top.alias("votes"))


def inverse_distance(neighbours: DataFrame, labels: DataFrame, squared: bool = True) -> DataFrame:
    """(qid, label, weight): votes weighted by 1 / distance; where a neighbour is at distance 0 only such ones vote, by 1 each."""
    d = F.sqrt("dist") if squared else F.col("dist")
    hits = labelled(neighbours, labels).withColumn("nearest", F.min("dist").over(Window.partitionBy("qid")))
    weight = F.when(F.col("nearest") == 0, F.when(F.col("dist") == 0, 1.0)).otherwise(F.try_divide(F.lit(1.0), d))
    scored = hits.groupBy("qid", "label").agg(F.sum(weight).alias("weight")).where("weight is not null")
    return _first(scored, F.desc(F.round("weight", 12)), "label").select("qid", "label", "weight")
