"""Bit-sampling LSH over packed bits (arrays of longs), all of it relational."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.vectors import sampled_key
from ...sources.scratch import scratch
from ..knn import knn_join, ranked
from . import cells
from .base import SearchParams, VectorIndex, register

BITS = 8  # bits used of every long


def xor_masks(key_size: int, level: int) -> list[int]:
    """All keys with at most level bits set, fewest first."""
    return [sum(1 << i for i in bits) for n in range(level + 1) for bits in itertools.combinations(range(key_size), n)]


def tables(total_bits: int, number: int, key_size: int, seed: int = 0) -> list[list[int]]:
    """Bit positions of every table, drawn without replacement within a table."""
    return [random.Random(f"{seed}:{t}").sample(range(total_bits), min(key_size, total_bits)) for t in range(number)]


def buckets(points: DataFrame, positions: list[list[int]], bits: int = BITS) -> DataFrame:
    """(table_no, key, id): the bucket of every point in every table."""
    keys = F.array(*[F.struct(F.lit(t).alias("table_no"), sampled_key(F.col("v"), p, bits).alias("key")) for t, p in enumerate(positions)])
    return points.select("id", F.explode(keys).alias("b")).select("b.table_no", "b.key", "id")


def probe_buckets(queries: DataFrame, positions: list[list[int]], masks: list[int], bits: int = BITS) -> DataFrame:
    """(qid, table_no, key): a query's buckets and those whose keys differ by a mask."""
    own = buckets(queries, positions, bits)
    flips = F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
    return own.select(F.col("id").alias("qid"), "table_no", "key", flips.alias("mask")).select("qid", "table_no", F.col("key").bitwiseXOR(F.col("mask")).alias("key"))


def _with_codes(points: DataFrame, positions: list[list[int]]) -> DataFrame:
    """(table_no, key, id, v) of points (id, v): their buckets, with their codes as numbers."""
    code = F.col("v").cast("array<bigint>")
    keys = F.array(*[F.struct(F.lit(t).alias("table_no"), sampled_key(code, p, BITS).alias("key")) for t, p in enumerate(positions)])
    return points.select("id", F.col("v").cast("array<double>").alias("v"), F.explode(keys).alias("b")).select("b.table_no", "b.key", "id", "v")


@register("lsh")
class LshIndex(VectorIndex):
    """v holds packed bits; probes are the same for every budget, and checks=-1 is an exact scan. Fewer than k may lie in the probed buckets:
    then fewer are returned.

    Buckets are written once, at build, with their points' codes. A search brings the queries of a bucket to its points, which meet as
    matrices there; only the k best per query and bucket are shuffled on. A bucket of more than CELL_BYTES of points, or queries, is dealt
    over several tasks.
    """

    exact = False
    buckets: list[str] = []  # folders

    @property
    def cells(self) -> DataFrame | None:
        if not self.buckets:
            return None
        return self.spark.read.schema("table_no int, cell long, id long, v array<double>").parquet(*self.buckets)

    def store(self) -> None:
        self.buckets = []
        self.placed(self.points)

    def placed(self, points: DataFrame) -> None:
        path = scratch(self.spark, "buckets")
        self.place(points).write.parquet(path)
        self.buckets = [*self.buckets, path]

    def entries(self) -> int:
        return self.cells.count()

    def save_cells(self, folder: str) -> None:
        self.alive_cells().write.mode("overwrite").option("compression", "lz4").parquet(f"{folder}/cells")

    def load_cells(self, folder: str) -> None:
        self.buckets = [f"{folder}/cells"]

    def train(self) -> None:
        self.positions = tables(self.dim * BITS, self.params.table_number, self.params.key_size, self.params.seed)

    def place(self, points: DataFrame) -> DataFrame:
        return _with_codes(points, self.positions).select("table_no", F.col("key").alias("cell"), "id", "v")

    def knn(self, queries: DataFrame, k: int, params: SearchParams | None = None) -> DataFrame:
        if params is not None and params.checks == -1:
            return knn_join(queries, self.alive(), k, self.distance)
        return ranked(self.scored(queries, k), k)

    def scored(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, dist) of at least the k nearest points in the probed buckets, each once."""
        masks = xor_masks(min(self.params.key_size, self.dim * BITS), self.params.multi_probe_level)
        flips = F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))
        asked = _with_codes(queries, self.positions).select("table_no", "key", "id", "v", flips.alias("mask"))
        asked = asked.select("table_no", F.col("key").bitwiseXOR(F.col("mask")).alias("cell"), "id", "v")
        points = self.alive_cells().select("table_no", "cell", "id", "v")
        most = max(1, cells.CELL_BYTES // (8 * self.dim))

        def crowded(rows: DataFrame, name: str) -> DataFrame | None:
            """How many parts a bucket with more than `most` rows is dealt into: of all rows, one in `most` at most."""
            n = rows.groupBy("table_no", "cell").agg(F.count("*").alias("n")).where(F.col("n") > most)
            found = n.select("table_no", "cell", F.ceil(F.col("n") / most).alias(name)).toArrow()
            return F.broadcast(self.spark.createDataFrame(found)) if found.num_rows else None

        many = {name: crowded(rows, name) for name, rows in (("pp", points), ("qp", asked))}
        every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))

        def dealt(rows: DataFrame, side: int, own: str, other: str) -> DataFrame:
            for name, table in many.items():
                if table is not None:
                    rows = rows.join(table, ["table_no", "cell"], "left")
                rows = rows.withColumn(name, F.coalesce(name, F.lit(1).cast("long")) if table is not None else F.lit(1).cast("long"))
            rows = rows.withColumn(own, F.pmod(F.xxhash64("id"), F.col(own)))
            return rows.select("table_no", "cell", F.lit(side).alias("side"), "id", "v", own, every(other).alias(f"_{other}")).withColumnRenamed(f"_{other}", other)

        return cells.brought_together(dealt(asked, 0, "qp", "pp"), dealt(points, 1, "pp", "qp"), self.distance, self.dim, k)

    def state(self) -> dict:
        return {"positions": self.positions}

    def restore(self, state: dict) -> None:
        self.positions = state["positions"]
