"""A k-d tree over all points, level by level in Spark, down to single points.

No sample is involved. While nodes have more than `block` points a level is two aggregations (extremes of every dimension, then the pivot of
the chosen one; both combined before the shuffle) and a pass that moves rows to their child; what is left below a node of at most `block`
points is built in one task from all of them. Top nodes are numbered as in a heap (root 1, children 2 i and 2 i + 1); node j below a
block's root b is (b << 32) + j.

Defined cases: points that are equal in every component stay in one leaf; pivot "median" takes an approximate median (within 1/10,000 of
the ranks) at the top and the exact one in blocks, "mean" and "middle" the mean and the middle of the extremes; a pivot that would leave one
side empty gives way to the least value above the lowest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.vectors import profile
from ...sources.scratch import scratch
from ..knn import matrix
from .trees import KdTree

BLOCK = 20_000
MAX_TOP = 30  # levels above the blocks
SPLITS = 65_536  # splits of a level that are broadcast
NODES = "node long, parent long, depth int, split_dim int, split_value double, left long, right long, size long"


@dataclass
class FullTree:
    """nodes: NODES, with nulls where there is none; leaves: (id, leaf)."""

    nodes: DataFrame
    leaves: DataFrame


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _chosen(choose: str, depth: int, dims: int) -> Column:
    """The dimension to split: from arrays low and high."""
    span = F.zip_with("high", "low", lambda a, b: a - b)
    if choose == "span":
        return (F.array_position(span, F.array_max(span)) - 1).cast("int")
    # cyclic: the first one from depth on in which the points differ
    order = F.array(*[F.lit((depth + i) % dims) for i in range(dims)])
    return F.element_at(F.filter(order, lambda i: F.get(span, i) > 0), 1).cast("int")


def build(points: DataFrame, leaf_size: int = 1, pivot: str = "median", choose: str = "span", block: int = BLOCK) -> FullTree:
    """The tree of points (id, v)."""
    if choose not in ("span", "cyclic") or pivot not in ("median", "mean", "middle"):
        raise ValueError(f"no split by {choose!r} at {pivot!r}")
    spark = points.sparkSession
    n, dims = profile(points)
    if not n:
        raise ValueError("a tree needs points")
    of = {"median": F.percentile_approx("x", 0.5, 10000), "mean": F.avg("x"), "middle": (F.min("x") + F.max("x")) / 2}[pivot]
    open_ = points.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"), F.lit(1).cast("long").alias("node"))
    small, same, inner = [], [], []
    for depth in range(MAX_TOP):
        ends = [f(F.col("v")[i]) for f in (F.min, F.max) for i in range(dims)]
        stats = open_.groupBy("node").agg(F.count("*").alias("size"), F.array(*ends[:dims]).alias("low"), F.array(*ends[dims:]).alias("high"))
        large = F.col("size") > max(block, leaf_size)
        stats = _kept(stats.withColumn("equal", F.col("low") == F.col("high")).withColumn("dim", F.when(large & ~F.col("equal"), _chosen(choose, depth, dims))), "stats")
        count = stats.count()
        hint = F.broadcast if count <= SPLITS else lambda df: df
        rows = open_.join(hint(stats.select("node", "size", "equal", "dim", F.get("low", F.col("dim")).alias("least"))), "node")
        if stats.where(~large).take(1):
            small.append(_kept(rows.where(F.col("dim").isNull() & ~(large & F.col("equal"))).select("id", "v", "node", F.lit(depth).alias("depth")), "small"))
        if stats.where(large & F.col("equal")).take(1):
            same.append(_kept(rows.where(large & F.col("equal")).select("id", "node", F.lit(depth).alias("depth")), "same"))
        if not stats.where("dim is not null").take(1):
            break
        rows = rows.where("dim is not null").withColumn("x", F.element_at("v", F.col("dim") + 1))
        split = rows.groupBy("node", "dim").agg(of.alias("at"), F.min("x").alias("low"), F.min(F.when(F.col("x") > F.col("least"), F.col("x"))).alias("above"), F.count("*").alias("size"))
        split = _kept(split.select("node", "dim", F.when(F.col("at") > F.col("low"), F.col("at")).otherwise(F.col("above")).alias("value"), "size"), "split")
        inner.append(split.withColumn("depth", F.lit(depth)))
        moved = open_.join(hint(split.select("node", "dim", "value")), "node")
        open_ = _kept(moved.select("id", "v", (F.col("node") * 2 + (F.element_at("v", F.col("dim") + 1) >= F.col("value")).cast("long")).alias("node")), "level")
    else:
        small.append(open_.withColumn("depth", F.lit(MAX_TOP)))
    root = spark.createDataFrame([], NODES)
    top = [s.select("node", _parent(), F.col("depth").cast("int").alias("depth"), F.col("dim").alias("split_dim"), F.col("value").alias("split_value"), (F.col("node") * 2).alias("left"), (F.col("node") * 2 + 1).alias("right"), "size") for s in inner]
    alike = reduce(DataFrame.unionByName, same) if same else None
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("split_dim", "int"), ("split_value", "double"), ("left", "long"), ("right", "long"))]
    if alike is not None:
        top.append(alike.groupBy("node", "depth").agg(F.count("*").alias("size")).select("node", _parent(), F.col("depth").cast("int").alias("depth"), *nothing, "size"))
    leaves = [alike.select("id", F.col("node").alias("leaf"))] if alike is not None else []
    if small:
        below = _kept(_blocks(reduce(DataFrame.unionByName, small), leaf_size, pivot, choose), "blocks")
        top.append(below.where("id is null").drop("id", "leaf"))
        leaves.append(below.where("id is not null").select("id", "leaf"))
    return FullTree(reduce(DataFrame.unionByName, top, root), reduce(DataFrame.unionByName, leaves))


def _parent() -> Column:
    return F.when(F.col("node") > 1, F.floor(F.col("node") / 2).cast("long")).alias("parent")


def _blocks(rows: DataFrame, leaf_size: int, pivot: str, choose: str) -> DataFrame:
    """The nodes of every block (NODES) and its points' leaves (id, leaf), one after the other."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def of(t: pa.Table) -> pa.RecordBatch:
        block, depth = t["node"][0].as_py(), t["depth"][0].as_py()
        ids, x = t["id"].to_numpy(), matrix(t["v"].combine_chunks())
        tree = KdTree(x, leaf_size, None, pivot, choose, depth)
        shape, at = tree.shape(), tree.descend(x)
        name = lambda i: block if i == 0 else (block << 32) + i
        leaf = np.empty(tree.cells, np.int64)
        leaf[tree.cell[shape.leaves]] = [name(i) for i in shape.leaves]
        size = np.zeros(len(shape.first), np.int64)
        size[shape.leaves] = np.bincount(at, minlength=tree.cells)[tree.cell[shape.leaves]]
        for i in range(len(size) - 1, 0, -1):  # children come behind their parents
            size[shape.parent[i]] += size[i]
        k = range(len(size))
        inner = [shape.count[i] > 0 for i in k]
        up = [(block // 2 or None) if i == 0 else name(shape.parent[i]) for i in k]
        columns = {
            "node": [name(i) for i in k], "parent": up, "depth": [depth + shape.depth[i] for i in k],
            "split_dim": [int(tree.dim[i]) if inner[i] else None for i in k], "split_value": [float(tree.value[i]) if inner[i] else None for i in k],
            "left": [name(shape.first[i]) if inner[i] else None for i in k], "right": [name(shape.first[i] + 1) if inner[i] else None for i in k],
            "size": size.tolist(),
        }
        m = len(ids)
        kinds = {"depth": pa.int32(), "split_dim": pa.int32(), "split_value": pa.float64()}
        made = [pa.array(v + [None] * m, kinds.get(c, pa.int64())) for c, v in columns.items()]
        return pa.record_batch([*made, pa.array([None] * len(size) + ids.tolist(), pa.int64()), pa.array([None] * len(size) + leaf[at].tolist(), pa.int64())], names=[*columns, "id", "leaf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            node = b.column(2).to_numpy()
            edge = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), b.num_rows]
            if held and held[-1].column(2)[-1].as_py() != node[0]:
                yield of(pa.Table.from_batches(held))
                held = []
            for a, z in zip(edge, edge[1:], strict=False):
                held.append(b.slice(a, z - a))
                if z < b.num_rows:
                    yield of(pa.Table.from_batches(held))
                    held = []
        if held:
            yield of(pa.Table.from_batches(held))

    sorted_rows = rows.select("id", "v", "node", "depth").repartition(parts, "node").sortWithinPartitions("node", "id")
    return sorted_rows.mapInArrow(run, NODES + ", id long, leaf long")
