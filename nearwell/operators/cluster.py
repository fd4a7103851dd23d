"""Clustering: seeding, assignment, updates and statistics. Centres are few and live on the driver as (cluster, centre) rows.

Every step over the data is one job of Column expressions; only centres and per-cluster sums come back.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distances
from ..sources.scratch import scratch

MAX_CENTRES = 65_536  # bound of what is broadcast and collected
ROUNDS = 16  # centres after which the nearest distances so far are written as a table


def centre_table(spark, centres: list[list[float]]) -> DataFrame:
    if len(centres) > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres")
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cluster int, centre array<double>")


def assign(base: DataFrame, centres: DataFrame, distance="l2", dim: int | None = None) -> DataFrame:
    """base with cluster and dist: the nearest centre, ties to the lower number.

    The centres stand in every row's expression as one array (at most MAX_CENTRES of them), so no pair becomes a row and nothing is shuffled.
    """
    rows = centres.orderBy("cluster").limit(MAX_CENTRES + 1).collect()
    if len(rows) > MAX_CENTRES:
        raise ValueError(f"more than {MAX_CENTRES} centres")
    d = distances.get(distance)
    if len(rows) * len(rows[0]["centre"]) <= 2048:
        options = [F.struct(d.expression(F.array(*[F.lit(x) for x in r["centre"]]), F.col("v")).alias("dist"), F.lit(r["cluster"]).alias("cluster")) for r in rows]
        best = F.array_min(F.array(*options))
    else:
        table = F.broadcast(base.sparkSession.createDataFrame([([(r["cluster"], r["centre"]) for r in rows],)], "centres array<struct<cluster:int,centre:array<double>>>"))
        base = base.join(table, F.lit(True))
        best = F.array_min(F.transform("centres", lambda c: F.struct(d.expression(c["centre"], F.col("v")).alias("dist"), c["cluster"].alias("cluster"))))
    return base.withColumn("_b", best).select(*[c for c in base.columns if c != "centres"], F.col("_b.cluster").alias("cluster"), F.col("_b.dist").alias("dist"))


def update(assigned: DataFrame) -> DataFrame:
    """(cluster, dim, x): the mean of every cluster, component by component; sums are combined before the shuffle."""
    return assigned.select("cluster", F.posexplode("v").alias("dim", "x")).groupBy("cluster", "dim").agg(F.avg("x").alias("x"))


def cost(assigned: DataFrame) -> DataFrame:
    """One row (cost): the sum of the distances to the nearest centre."""
    return assigned.agg(F.sum("dist").alias("cost"))


def node_statistics(assigned: DataFrame) -> DataFrame:
    """(cluster, size, radius, variance): the largest and the mean squared distance of a cluster's vectors to their mean."""
    means = update(assigned).groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("mean"))
    d = distances.get("l2").expression(F.col("mean"), F.col("v"))
    return assigned.join(F.broadcast(means.limit(MAX_CENTRES)), "cluster").groupBy("cluster").agg(F.count("*").alias("size"), F.max(d).alias("radius"), F.avg(d).alias("variance"))


def lloyd(base: DataFrame, centres: list[list[float]], iterations: int = 11, distance="l2") -> list[list[float]]:
    """Centres after at most so many rounds (all until nothing moves below 0); an empty cluster takes the vector farthest from its centre."""
    spark, done = base.sparkSession, 0
    while iterations < 0 or done < iterations:
        near = assign(base, centre_table(spark, centres), distance)
        sums = near.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(len(centres[0]))]).collect()
        new = [list(c) for c in centres]
        for r in sums:
            new[r["cluster"]] = [r[f"s{i}"] / r["n"] for i in range(len(centres[0]))]
        empty = sorted(set(range(len(centres))) - {r["cluster"] for r in sums})
        if empty:
            for c, r in zip(empty, near.orderBy(F.desc("dist"), "id").select("v").limit(len(empty)).collect(), strict=False):
                new[c] = list(r["v"])
        done += 1
        if np.allclose(new, centres, rtol=0, atol=0):
            return new
        centres = new
    return centres


def random_centres(base: DataFrame, k: int, seed: int = 0) -> list[list[float]]:
    """k different vectors, the first ones in an order by seeded hash; all different ones if there are fewer."""
    take = 4 * k
    while True:
        rows = base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(take).select("v").collect()
        found = list(dict.fromkeys(tuple(r["v"]) for r in rows))
        if len(found) >= k or len(rows) < take:
            return [list(v) for v in found[:k]]
        if take >= 64 * k:  # a table of few different vectors: they are grouped instead
            rows = base.groupBy("v").agg(F.min("id").alias("id")).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).collect()
            return [list(r["v"]) for r in rows]
        take *= 4


def _nearest(base: DataFrame, centres: list[list[float]], distance) -> DataFrame:
    return assign(base, centre_table(base.sparkSession, centres), distance)


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class _Running:
    """The distance of every vector to the nearest centre so far. A round looks at the last ROUNDS centres at most: what came of those before
    is kept as a table, so k centres cost k passes of bounded work and k / ROUNDS tables."""

    def __init__(self, base: DataFrame, distance, first: list[float]):
        self.d, self.table, self.last = distances.get(distance), base.select("id", "v").withColumn("dist", F.lit(float("inf"))), [first]

    def near(self) -> DataFrame:
        """(id, v, dist)."""
        new = [self.d.expression(F.array(*[F.lit(float(x)) for x in c]), F.col("v")) for c in self.last]
        return self.table.withColumn("dist", F.least("dist", *new))

    def add(self, centre: list[float]) -> None:
        if len(self.last) == ROUNDS:
            self.table, self.last = _kept(self.near(), "near"), []
        self.last.append(centre)


def gonzales(base: DataFrame, k: int, first: int | None = None, distance="l2") -> list[tuple[int, list[float]]]:
    """(id, v) of k centres, each the vector farthest from those before it (ties to the smaller id), from id first or the smallest."""
    start = base.where(F.col("id") == first) if first is not None else base
    chosen = [(r["id"], list(r["v"])) for r in start.orderBy("id").limit(1).select("id", "v").collect()]
    running = _Running(base, distance, chosen[0][1]) if chosen else None
    while chosen and len(chosen) < k:
        far = running.near().orderBy(F.desc("dist"), "id").limit(1).collect()
        if far[0]["dist"] <= 0:
            break
        chosen.append((far[0]["id"], list(far[0]["v"])))
        running.add(chosen[-1][1])
    return chosen


def kmeans_plus_plus(base: DataFrame, k: int, seed: int = 0, distance="l2") -> list[list[float]]:
    """k centres, each drawn with a chance in proportion to its squared distance from those before: the smallest of -ln(u) / d wins."""
    centres = [list(r["v"]) for r in base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).select("v").collect()]
    running = _Running(base, distance, centres[0]) if centres else None
    while centres and len(centres) < k:
        u = (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(len(centres))), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
        d = distances.squared(distance, F.col("dist"))
        row = running.near().where("dist > 0").orderBy(-F.ln(u) / d, "id").limit(1).collect()
        if not row:
            break
        centres.append(list(row[0]["v"]))
        running.add(centres[-1])
    return centres


def groupwise(base: DataFrame, k: int, seed: int = 0, distance="l2", trials: int = 10) -> list[list[float]]:
    """k centres, each of several tried farthest-third vectors the one that lowers the total distance most."""
    centres = [list(r["v"]) for r in base.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).select("v").collect()]
    running = _Running(base, distance, centres[0]) if centres else None
    while centres and len(centres) < k:
        near = running.near()
        edge = near.approxQuantile("dist", [2 / 3], 0.01)
        tried = near.where((F.col("dist") >= (edge or [0.0])[0]) & (F.col("dist") > 0)).orderBy(F.xxhash64("id", F.lit(seed), F.lit(len(centres))), "id").limit(trials).select("v").collect()
        if not tried:
            break
        d = distances.get(distance)
        gain = near.agg(*[F.sum(F.least(F.col("dist"), d.expression(F.array(*[F.lit(x) for x in r["v"]]), F.col("v")))).alias(str(i)) for i, r in enumerate(tried)]).first()
        centres.append(list(tried[min(range(len(tried)), key=lambda i: gain[str(i)])]["v"]))
        running.add(centres[-1])
    return centres


CHOOSERS = {"random": random_centres, "gonzales": lambda base, k, seed=0, distance="l2": [v for _, v in gonzales(base, k, None, distance)], "kmeanspp": kmeans_plus_plus, "groupwise": groupwise}


def kmeans(base: DataFrame, k: int, iterations: int = 11, chooser: str = "random", seed: int = 0, distance="l2") -> list[list[float]]:
    if chooser == "random":
        start = random_centres(base, k, seed)
    else:
        start = CHOOSERS[chooser](base, k, seed, distance)
    return lloyd(base, start, iterations, distance)


def cluster_centres(base: DataFrame, most: int, branching: int = 2, iterations: int = 11, seed: int = 0) -> list[list[float]]:
    """Centres of the best cut of a k-means tree with at most `most` clusters, their number being (branching - 1) m + 1.

    Every cluster of the cut is split on trial once, and the split that leaves the least sum of squared distances to centres is taken next;
    a cluster of fewer different vectors than branching stays.
    """
    first = base.first()
    if first is None:
        return []
    means = list(base.agg(*[F.avg(F.col("v")[i]) for i in range(len(first["v"]))]).first())

    def spread(part: DataFrame, centres: list[list[float]]) -> list[float]:
        sums = {r["cluster"]: r["s"] for r in _nearest(part, centres, "l2").groupBy("cluster").agg(F.sum("dist").alias("s")).collect()}
        return [sums.get(i, 0.0) for i in range(len(centres))]

    def trial(part: DataFrame, own: float):
        """(gain, children with their parts and sums) of a split, None if there is none."""
        start = random_centres(part, branching, seed) if own > 0 else []
        if len(start) < branching:
            return None
        centres = lloyd(part, start, iterations)
        near = _kept(_nearest(part, centres, "l2").select("id", "v", "cluster"), "parts")  # a part is a filter of one table, not of all before
        sums = spread(part, centres)
        return own - sum(sums), [(c, near.where(F.col("cluster") == i).select("id", "v"), s) for i, (c, s) in enumerate(zip(centres, sums, strict=True))]

    whole = base.select("id", "v")
    cut = [(means, whole, spread(whole, [means])[0])]
    splits = [trial(*cut[0][1:])]
    while len(cut) + branching - 1 <= most:
        open_ = [i for i, t in enumerate(splits) if t is not None]
        if not open_:
            break
        best = max(open_, key=lambda i: (splits[i][0], -i))
        parts = splits[best][1]
        last = len(cut) + branching - 1 + branching - 1 > most
        cut[best : best + 1] = parts
        splits[best : best + 1] = [None if last else trial(p, s) for _, p, s in parts]
    return [c for c, _, _ in cut]


def best_cut(nodes: DataFrame, most: int) -> DataFrame:
    """The rows of a tree's nodes (node, parent, size, variance and whatever else) that make its best cut of at most `most` nodes.

    From the root on, the node whose split leaves the least sum of variance times size (ties: the smallest node) is replaced by its children,
    until none is left or the next one would make too many. nodes is a tree's table, of twice MAX_CENTRES
    rows at most; a node without parent is the root, and there is one.
    """
    rows = nodes.select("node", "parent", "size", "variance").limit(2 * MAX_CENTRES + 1).collect()
    if len(rows) > 2 * MAX_CENTRES:
        raise ValueError(f"more than {2 * MAX_CENTRES} nodes")
    cost = {r["node"]: r["variance"] * r["size"] for r in rows}
    kids: dict[int, list[int]] = {}
    for r in rows:
        kids.setdefault(r["parent"], []).append(r["node"])
    if len(roots := kids.get(None, [])) != 1:
        raise ValueError(f"a tree has one root, not {len(roots)}")
    cut, open_ = set(roots), []

    def offer(node: int) -> None:
        if node in kids:
            heapq.heappush(open_, (sum(cost[k] for k in kids[node]) - cost[node], node))

    offer(roots[0])
    while open_:
        _, node = heapq.heappop(open_)
        if len(cut) + len(kids[node]) - 1 > most:
            break
        cut.remove(node)
        cut.update(kids[node])
        for k in kids[node]:
            offer(k)
    chosen = nodes.sparkSession.createDataFrame([(n,) for n in sorted(cut)], nodes.select("node").schema)
    return nodes.join(F.broadcast(chosen), "node", "left_semi")
