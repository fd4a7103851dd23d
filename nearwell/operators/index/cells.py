"""Indexes whose points are stored by cell.

build() places every point in a leaf of each tree and writes the points once, as tables partitioned by (table_no, shelf) and files sorted
by cell; a shelf is a run of consecutive cells with about shelf_points points. Up to DIRECT_BYTES the tasks that place points write them,
beyond that a shuffle brings shelves together. Components that are the same in single precision are stored in it. A saved index is these
cells: its points are read from them. What the leaves really hold (number, box or radius) is then
read off the stored points, so bounds are as tight as the points allow. A search first asks the trees which cells each query looks into
(`nodes.py`, bounded work per query), then reads the shelves of those cells alone: Spark lists no other folder.

Queries that fit BROADCAST_BYTES are sent to the tasks that read the cells, and only the k best per query and task are shuffled. Up to
PROBES (query, cell) pairs are sent as well; more are shuffled to the points of their cells, as lists of query numbers. Without that the
pairs are written as a table and queries and points of a cell are brought together by a shuffle. A cell of more than CELL_BYTES of points or
queries is dealt over several tasks.

Of a radius search with so many pairs that asks for all points nearer, every task holds the points of a tree (up to WHOLE_BYTES) and ranks
what its queries find: found pairs, which grow with the square of the tables, aren't shuffled.

A search that would look at SCAN of all points or more, by its budget or (exact ones) by what a few of its queries look at, scans the stored
cells of one tree: a pair of query and cell costs more than the points that are left out save.

Added points are written as a further table and make numbers, boxes and radii grow. A leaf that outgrows its size is split there and then:
its points are read, placed in the new leaves and written again; no other cell changes. The old number is never asked for again.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.vectors import VectorError, profile, slim, survey
from ...sources.scratch import scratch
from .. import knn as exact
from ..knn import SCHEMA, best_of, knn_join, matrix, ranked
from .base import MAX_CELLS, TRAIN, SearchParams, VectorIndex
from .nodes import Forest, Shape, root

SHELF_BYTES = 16 << 20  # vectors of a shelf
MAX_SHELVES = 4096  # of a tree
CELL_BYTES = 64 << 20  # vectors of a cell, and of a cell's queries, that one task takes
PROBES = 1 << 22
PACKED = 1 << 21  # (query, cell) pairs that are made lists by cell at a time
RUN = 16  # consecutive cells that a task takes together
TOGETHER = 1024  # points of several cells that meet queries at once
MASK = 1 << 25  # bytes of the mask that says which of them meet
DIRECT_BYTES = 1 << 30  # vectors of a table that tasks write where they place them: each has a file a shelf
PLAIN = {"parquet.enable.dictionary#v.list.element": "false"}  # components hardly repeat: a dictionary of them only takes room
STORED = "table_no int, shelf int, cell long, id long, v array<{}>"
OUTGROWN = 2  # a leaf of more than so many times its size is split
SCAN = 0.45  # share of all points: a search that looks at more of them scans the cells of one tree instead
FEW_PROBES = 1 << 20  # (query, cell) pairs below which an exact search isn't weighed first
WEIGHED = 64  # queries that tell how much an exact search looks at


def _together(met: list[tuple]) -> Iterator[list[tuple]]:
    """Consecutive cells (first and end of who asks for it, first and end of its points) with TOGETHER points at most, or one larger one."""
    held: list[tuple] = []
    for m in met:
        if held and m[3] - held[0][2] > TOGETHER:
            yield held
            held = []
        held.append(m)
    if held:
        yield held


def _meet(d, best, qids: np.ndarray, q: np.ndarray, row: np.ndarray, some: list[tuple], ids: np.ndarray, x: np.ndarray, radius: float | None) -> Iterator[pa.RecordBatch]:
    """The points of some cells meet the queries that ask for them: all at once if most of the pairs are asked for, else cell by cell."""
    if len(some) > 1:
        who, place = np.unique(np.concatenate([row[a:z] for a, z, _, _ in some]), return_inverse=True)
        points = np.concatenate([np.arange(a, z) for _, _, a, z in some])
        size = len(who) * len(points)
        if size <= MASK and 4 * sum((m[1] - m[0]) * (m[3] - m[2]) for m in some) >= size:
            hide, at, to = np.ones((len(who), len(points)), bool), 0, 0
            for a, z, first, end in some:
                hide[place[at : at + z - a], to : to + end - first] = False
                at, to = at + z - a, to + end - first
            for s in range(0, len(who), 256):
                part = who[s : s + 256]
                yield from exact.meet(d, best, part, qids[part], q[part], ids[points], x[points], radius, True, hide[s : s + 256])
            return
    for a, z, first, end in some:
        for s in range(a, z, 256):
            part = row[s : min(s + 256, z)]
            for c in range(first, end, 2048):
                last = min(c + 2048, end)
                yield from exact.meet(d, best, part, qids[part], q[part], ids[c:last], x[c:last], radius, True)


def brought_together(left: DataFrame, right: DataFrame, name, dim: int, k: int | None, radius: float | None = None) -> DataFrame:
    """(qid, id, dist) of the k best (or all within radius) of every query in each group it meets, each pair once.

    Both sides have (table_no, cell, pp, qp, side, id, v), side 0 the queries. A group is one task's work: its two sides meet as matrices.
    """
    group = ["table_no", "cell", "pp", "qp"]

    def nearest(t: pa.Table) -> Iterator[pa.RecordBatch]:
        side, ids = t["side"].to_numpy(), t["id"].to_numpy()
        if side.all() or not side.any():  # nobody asks, or nothing is there
            return
        x = matrix(t["v"].combine_chunks(), dim)
        yield from best_of(ids[side == 0], x[side == 0], ids[side == 1], x[side == 1], name, k, radius).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by group, one group at a time."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy() for i in range(4)]
            new = np.any([x[1:] != x[:-1] for x in keys], axis=0)
            if held and any(held[-1].column(i)[-1].as_py() != keys[i][0] for i in range(4)):
                yield from nearest(pa.Table.from_batches(held))
                held = []
            edges = [0, *(np.flatnonzero(new) + 1).tolist()]
            for a, z in zip(edges, edges[1:], strict=False):
                yield from nearest(pa.Table.from_batches([*held, batch.slice(a, z - a)]))
                held = []
            held.append(batch.slice(edges[-1]))
        if held:
            yield from nearest(pa.Table.from_batches(held))

    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = left.select(*group, "side", "id", "v").unionByName(right.select(*group, "side", "id", "v"))
    return rows.repartition(parts, *group).sortWithinPartitions(*group).mapInArrow(run, SCHEMA).dropDuplicates(["qid", "id"])


@dataclass
class _Queries:
    """Queries on the driver, in order of their ids."""

    ids: np.ndarray
    x: np.ndarray


class CellIndex(VectorIndex):
    """A forest over the points. Subclasses train its trees."""

    exact = False  # searches within a budget unless checks is -1
    cb_index = 0.0

    def __init__(self, *args, **kw):
        super().__init__(*args, **kw)
        self.forest: Forest | None = None
        self.tables: list[tuple[str, str]] = []  # folders and types of components, oldest first

    # training

    def trees_wanted(self) -> int:
        return 1

    def blank(self) -> Forest:
        """An empty forest of the method's kind."""
        raise NotImplementedError

    def shape(self, x: np.ndarray, leaf: float, tree: int, depth: int, room: int) -> Shape:
        """A tree over sampled vectors with leaves of at most leaf of them, and at most room leaves."""
        raise NotImplementedError

    def leaf_points(self) -> float:
        """Points of a leaf: as asked, and more where MAX_CELLS leaves or 64 MiB of node geometry would not do."""
        room = min(MAX_CELLS, (64 << 20) // (16 * self.dim)) / (2 * self.trees_wanted())
        return max(self.params.leaf_size, self.built_size / room)

    def train(self) -> None:
        if self.trees_wanted() < 1:
            raise ValueError("an index has at least one tree")
        _, x = self.sample()
        self.limit = self.leaf_points()
        self.forest = self.blank()
        share = len(x) / self.built_size
        for t in range(self.trees_wanted()):
            self.forest.plant(self.shape(x, self.limit * share, t, 0, MAX_CELLS))
        # cells of a shelf, and over how many tasks the points of each leaf are dealt (of equal points there may be very many)
        wanted = self.params.shelf_points or max(1, SHELF_BYTES // (8 * self.dim))
        self.widths = [max(1, round(c * wanted / self.built_size), -(-c // MAX_SHELVES)) for c in self.forest.cells]
        most = max(1, CELL_BYTES // (8 * self.dim))
        self.crowds = []
        for t in range(self.trees_wanted()):
            n = np.bincount(self.forest.cell[self.forest.descend(self.distance, x, t)], minlength=self.forest.cells[t]) / share
            self.crowds.append({int(c): int(-(-n[c] // most)) for c in np.flatnonzero(n > most)})

    # storing

    def store(self) -> None:
        self.tables = []
        self._append(self.points, known=(self.built_size, self.single))

    def place(self, points: DataFrame, tree: int | None = None, kind: str = "double") -> DataFrame:
        """(table_no, shelf, cell, id, v, part) of points in all trees or in one; part deals the points of a crowded leaf."""
        shared = self.spark.sparkContext.broadcast((self.forest, self.widths, self.crowds))
        d, trees = self.distance, list(range(len(self.forest.roots))) if tree is None else [tree]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest, widths, crowds = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                ids, x = b.column(0).to_numpy(), matrix(b.column(1))
                for t in trees:
                    cell = forest.cell[forest.descend(d, x, t)]
                    parts = np.array([crowds[t].get(int(c), 1) for c in cell], np.int64) if crowds[t] else 1
                    columns = [np.full(len(x), t, np.int32), (cell // widths[t]).astype(np.int32), cell]
                    yield pa.record_batch([*map(pa.array, columns), b.column(0), b.column(1), pa.array((np.abs(ids) % parts).astype(np.int32))], names=["table_no", "shelf", "cell", "id", "v", "part"])

        return points.select("id", F.col("v").cast(f"array<{kind}>").alias("v")).mapInArrow(run, STORED.format(kind) + ", part int")

    def _append(self, points: DataFrame, tree: int | None = None, known: tuple[int, bool] | None = None) -> None:
        """Place points in all trees or in one, write them as a further table, and let their leaves hold them. known: their number, and
        whether single precision holds them."""
        path = scratch(self.spark, "cells")
        n, single = known or survey(points, single=True)[::2]
        kind = "float" if single else "double"
        size, cores = n * self.dim * (4 if single else 8), self.spark.sparkContext.defaultParallelism
        if size <= DIRECT_BYTES:
            tasks = min(max(cores, -(-size // SHELF_BYTES)), exact.TASKS * cores)
            dealt = self.place(points.coalesce(tasks), tree, kind)
        else:
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            dealt = self.place(points, tree, kind).repartition(parts, "table_no", "shelf", "part")
        dealt.sortWithinPartitions("table_no", "shelf", "cell").drop("part").write.options(**PLAIN).partitionBy("table_no", "shelf").parquet(path)
        self.tables = [*self.tables, (path, kind)]
        self._measure(self._table(path, kind))

    def _table(self, path: str, kind: str) -> DataFrame:
        """A stored table, its components as doubles."""
        out = self.spark.read.schema(f"cell long, id long, v array<{kind}>, table_no int, shelf int").parquet(path)
        return out.withColumn("v", F.col("v").cast("array<double>"))

    def _measure(self, stored: DataFrame) -> None:
        """Numbers, boxes and radii of leaves from stored points: combined by each task, and a row per leaf and task comes back."""
        forest = copy.deepcopy(self.forest)  # a clone keeps its own
        of = forest.leaf_of()
        shared = self.spark.sparkContext.broadcast((forest, of))
        d, balls = self.distance, hasattr(forest, "radius")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest, of = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                table, cell, x = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2))
                order = np.lexsort((cell, table))
                table, cell, x = table[order], cell[order], x[order]
                at = np.concatenate(([0], np.flatnonzero((table[1:] != table[:-1]) | (cell[1:] != cell[:-1])) + 1))
                n = np.diff(np.concatenate((at, [len(x)])))
                node = np.array([of[t][c] for t, c in zip(table[at].tolist(), cell[at].tolist(), strict=True)])
                if balls:
                    far = root(d, d.pairs(x, forest.centre[np.repeat(node, n)]))
                    radius, low, high = (np.zeros(len(at)) if far is None else np.maximum.reduceat(far, at)), *(np.zeros((len(at), 0)),) * 2
                else:
                    radius, low, high = np.zeros(len(at)), np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel())) for y in (low, high)]
                yield pa.record_batch([pa.array(node), pa.array(n), *lists, pa.array(radius)], names=["node", "n", "low", "high", "radius"])

        wide = "node long, n long, low array<double>, high array<double>, radius double"
        got = stored.select("table_no", "cell", "v").mapInArrow(run, wide).toArrow()
        if got.num_rows:
            low, high = (got[c].combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1) for c in ("low", "high"))
            forest.widen(got["node"].to_numpy(), got["n"].to_numpy(), low, high, got["radius"].to_numpy())
        forest.settle(d)
        self.forest = forest

    def shelves_read(self, asked: dict[int, np.ndarray] | None = None) -> DataFrame:
        """(table_no, cell, id, v) as stored, of the shelves with the cells asked for, by tree; of all without."""
        out = reduce(DataFrame.unionByName, [self._table(*t) for t in self.tables])
        if asked is not None:
            wanted = [(F.col("table_no") == t) & F.col("shelf").isin(*map(int, np.unique(c // self.widths[t]))) for t, c in asked.items() if len(c)]
            out = out.where(reduce(lambda a, b: a | b, wanted) if wanted else F.lit(False))
        return out.select("table_no", "cell", "id", "v")

    @property
    def cells(self) -> DataFrame | None:
        if self.forest is None:
            return None
        out = self.shelves_read()
        gone = [(t, c) for t, nodes in enumerate(self.forest.leaf_of()) for c in np.flatnonzero(nodes < 0).tolist()]
        if gone:  # cells that have been split: at most MAX_CELLS
            out = out.join(F.broadcast(self.spark.createDataFrame(gone, "table_no int, cell long")), ["table_no", "cell"], "left_anti")
        return out

    def entries(self) -> int:
        return int(self.forest.held[self.forest.roots].sum())

    # growth

    def placed(self, points: DataFrame) -> None:
        self._append(points)
        self._split()

    def _split(self) -> None:
        """Split the leaves that have outgrown their size, each over its own points."""
        forest = self.forest
        for tree in range(len(forest.roots)):
            nodes = forest.leaves(tree)
            nodes = nodes[forest.held[nodes] > OUTGROWN * self.limit]
            if not len(nodes):
                continue
            cells = forest.cell[nodes]
            old = self.shelves_read({tree: cells}).where((F.col("table_no") == tree) & F.col("cell").isin(*cells.tolist())).select("cell", "id", "v")
            some = old.orderBy(F.xxhash64("id", F.lit(self.params.seed)), "id").limit(TRAIN).toArrow()
            at, x = some["cell"].to_numpy(), matrix(some["v"].combine_chunks(), self.dim)
            grown = copy.deepcopy(forest)
            split = []
            for node, cell in zip(nodes.tolist(), cells.tolist(), strict=True):
                mine = x[at == cell]
                shape = self.shape(mine, self.limit * len(mine) / forest.held[node], tree, int(forest.depth[node]), MAX_CELLS - len(forest.leaves())) if len(mine) > 1 else None
                if shape is not None and len(shape.leaves) > 1:  # equal points stay together
                    grown.graft(node, shape)
                    split.append(cell)
            if split:
                self.forest = forest = grown
                self._append(old.where(F.col("cell").isin(*split)).select("id", "v"), tree)
                forest = self.forest

    # search

    def _cells_of(self, queries: DataFrame, checks: int, k: int, worst: bool = False, eps: float = 0.0) -> DataFrame:
        """(qid, table_no, cell) where queries look: best first within a budget, or (with a column worst) all that may hold something as near."""
        shared, d, cb = self.spark.sparkContext.broadcast(self.forest), self.distance, self.cb_index
        trees = [0] if self.exact or checks == -1 else list(range(len(self.forest.roots)))
        budget = float(max(checks, k) * len(trees))  # a point lies in every tree: so many places are `checks` points at least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            forest = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                ids, x = b.column(0).to_numpy(), matrix(b.column(1))
                for a in range(0, len(ids), 512):
                    q = x[a : a + 512]
                    if worst:
                        row, node = forest.within(d, q, b.column(2).to_numpy()[a : a + 512], eps)
                    else:
                        row, node = forest.best_first(d, q, budget, cb, trees)
                    yield pa.record_batch([pa.array(ids[a + row]), pa.array(forest.tree[node].astype(np.int32)), pa.array(forest.cell[node])], names=["qid", "table_no", "cell"])

        columns = ["id", "v", *(["worst"] if worst else [])]
        return queries.select(*columns).mapInArrow(run, "qid long, table_no int, cell long")

    def _held(self, queries: DataFrame, n: int) -> _Queries | None:
        """The queries on the driver if they fit BROADCAST_BYTES."""
        if n * (self.dim + 1) * 8 > exact.BROADCAST_BYTES:
            return None
        table = queries.select("id", "v").toArrow()
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        return _Queries(table["id"].to_numpy()[order], matrix(table["v"].combine_chunks(), self.dim)[order] if n else np.zeros((0, self.dim)))

    def _spread(self, held: _Queries, worst: np.ndarray | None = None) -> DataFrame:
        """Held queries (numbered by their places) dealt over tasks."""
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(held.ids) + 1, dtype=np.int32) * self.dim), pa.array(held.x.ravel()))
        columns = {"id": pa.array(np.arange(len(held.ids))), "v": flat} | ({} if worst is None else {"worst": pa.array(worst)})
        return self.spark.createDataFrame(pa.table(columns))

    def _read_for(self, held: _Queries, asked: pa.Table, k: int | None, radius: float | None = None) -> DataFrame:
        """(qid, id, dist) of at least the k nearest points in the cells asked for, or of all within radius: read where they lie.

        asked has (place of the query, table_no, cell).
        """
        row, trees, cell = (asked[c].to_numpy() for c in ("qid", "table_no", "cell"))
        order = np.lexsort((row, cell, trees))
        trees, cell, row = trees[order], cell[order], row[order]
        at = np.flatnonzero(np.concatenate((np.ones(min(len(row), 1), bool), (trees[1:] != trees[:-1]) | (cell[1:] != cell[:-1]))))
        edge = np.concatenate((at, [len(row)])).tolist()
        wanted = {(t, c): (a, z) for t, c, a, z in zip(trees[at].tolist(), cell[at].tolist(), edge, edge[1:], strict=False)}
        shared = self.spark.sparkContext.broadcast((held.ids, held.x, row, wanted))
        d, dim, several = self.distance, self.dim, len(np.unique(trees)) > 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q, row, wanted = shared.value
            best = exact._Best(len(qids), k, unique=several) if k is not None else None
            for b in batches:
                if not b.num_rows:
                    continue
                tree, cell = b.column(0).to_numpy(), b.column(1).to_numpy()
                edge = [0, *(np.flatnonzero((tree[1:] != tree[:-1]) | (cell[1:] != cell[:-1])) + 1).tolist(), b.num_rows]
                met = [(*who, a, z) for a, z in zip(edge, edge[1:], strict=False) if (who := wanted.get((int(tree[a]), int(cell[a])))) is not None]
                ids, x = b.column(2).to_numpy(), matrix(b.column(3), dim)
                for some in _together(met):
                    yield from _meet(d, best, qids, q, row, some, ids, x, radius)
            if best is not None:
                yield best.found(qids, radius)

        points = self.shelves_read({int(t): np.unique(cell[trees == t]) for t in np.unique(trees)})
        if self.removed is not None:
            points = points.join(self.removed, "id", "left_anti").select("table_no", "cell", "id", "v").sortWithinPartitions("table_no", "cell")
        found = points.mapInArrow(run, SCHEMA)
        return found.dropDuplicates(["qid", "id"]) if several else found

    def _shuffled_for(self, held: _Queries, asked: DataFrame, k: int | None, radius: float | None = None) -> DataFrame:
        """As _read_for, for any number of pairs: lists of query numbers meet the points of their cells by a shuffle, vectors of queries don't."""
        shared = self.spark.sparkContext.broadcast((held.ids, held.x))
        d, dim, several = self.distance, self.dim, k is not None and len(self.forest.roots) > 1

        def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            row, tree, cell = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
            order = np.lexsort((row, cell, tree))
            row, tree, cell = row[order].astype(np.int32), tree[order], cell[order]
            at = np.flatnonzero(np.concatenate(([True], (tree[1:] != tree[:-1]) | (cell[1:] != cell[:-1]))))
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(row)).astype(np.int32)), pa.array(row))
            return pa.record_batch([pa.array(tree[at]), pa.array(cell[at]), lists], names=["table_no", "cell", "who"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            for b in batches:
                if b.num_rows:
                    held.append(b)
                if sum(x.num_rows for x in held) >= PACKED:
                    yield packed(held)
                    held = []
            if held:
                yield packed(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows sorted by cell, who asks for it before its points."""
            qids, q = shared.value
            best = exact._Best(len(qids), k, unique=several) if k is not None else None
            last, who = None, np.zeros(0, np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                tree, cell, side = (b.column(i).to_numpy() for i in range(3))
                points = b.filter(pa.array(side == 1))
                ids, x = points.column(3).to_numpy(), matrix(points.column(4), dim)
                place = np.cumsum(side == 1) - (side == 1)
                edge = [0, *(np.flatnonzero((tree[1:] != tree[:-1]) | (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), b.num_rows]
                rows, met, n = [], [], 0
                for a, z in zip(edge, edge[1:], strict=False):
                    key = (tree[a], cell[a], b.column(6)[a].as_py())
                    if key != last:
                        last, who = key, np.zeros(0, np.int64)
                    if side[a] == 0:
                        who = np.concatenate((who, b.column(5).slice(a, z - a).flatten().to_numpy()))
                    elif len(who):
                        rows.append(who)
                        met.append((n, n + len(who), int(place[a]), int(place[a]) + z - a))
                        n += len(who)
                row = np.concatenate(rows) if rows else who
                for some in _together(met):
                    yield from _meet(d, best, qids, q, row, some, ids, x, radius)
            if best is not None:
                yield best.found(qids, radius)

        lists = asked.select("qid", "table_no", "cell").mapInArrow(pack, "table_no int, cell long, who array<int>")
        points = self.shelves_read()
        if self.removed is not None:
            points = points.join(self.removed, "id", "left_anti")
        most, of = max(1, CELL_BYTES // (8 * dim)), self.forest.leaf_of()
        crowded = [(t, int(c), int(-(-self.forest.held[nodes[c]] // most))) for t, nodes in enumerate(of) for c in np.flatnonzero((nodes >= 0) & (self.forest.held[nodes] > most))]
        if crowded:
            tasks = F.broadcast(self.spark.createDataFrame(crowded, "table_no int, cell long, parts long"))
            parts = F.coalesce("parts", F.lit(1).cast("long"))
            points = points.join(tasks, ["table_no", "cell"], "left").withColumn("part", F.pmod(F.xxhash64("id"), parts))
            lists = lists.join(tasks, ["table_no", "cell"], "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        else:
            points, lists = (df.withColumn("part", F.lit(0).cast("long")) for df in (points, lists))
        columns = ["table_no", "cell", "side", "id", "v", "who", "part"]
        left = lists.select("table_no", "cell", F.lit(0).alias("side"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), "who", "part")
        right = points.select("table_no", "cell", F.lit(1).alias("side"), "id", "v", F.lit(None).cast("array<int>").alias("who"), "part")
        tasks = exact.TASKS * self.spark.sparkContext.defaultParallelism
        rows = left.unionByName(right).select(*columns).repartition(tasks, "table_no", F.floor(F.col("cell") / RUN), "part")
        found = rows.sortWithinPartitions("table_no", "cell", "part", "side").mapInArrow(run, SCHEMA)
        return found.dropDuplicates(["qid", "id"]) if several else found

    def _scored(self, queries: DataFrame, held: _Queries | None, asked: DataFrame, most: float, k: int | None, radius: float | None = None) -> DataFrame:
        """As _read_for, for asked (qid, table_no, cell): of held queries by their places, else by their ids. At most `most` pairs."""
        if held is not None and most <= PROBES:
            return self._read_for(held, asked.toArrow(), k, radius)
        if held is not None:
            return self._shuffled_for(held, asked, k, radius)
        path = scratch(self.spark, "asked")
        asked.write.parquet(path)
        asked = self.spark.read.schema(asked.schema).parquet(path)
        return self._joined(queries, asked, k, radius)

    def _joined(self, queries: DataFrame, asked: DataFrame, k: int | None, radius: float | None) -> DataFrame:
        """As scored, with queries and points brought together by cell; only a cell's k best leave a task. asked is a stored table."""
        pairs = asked.groupBy("table_no", "cell").agg(F.count("*").alias("q")).toArrow()  # at most MAX_CELLS rows a tree
        of = self.forest.leaf_of()
        trees, cell, q = (pairs[c].to_numpy() for c in ("table_no", "cell", "q"))
        held = np.array([self.forest.held[of[t][c]] for t, c in zip(trees.tolist(), cell.tolist(), strict=True)])
        most = max(1, CELL_BYTES // (8 * self.dim))
        tasks = self.spark.createDataFrame(pa.table({"table_no": pa.array(trees, pa.int32()), "cell": cell, "pp": -(-np.maximum(held, 1) // most), "qp": -(-q // most)}))
        tasks = F.broadcast(tasks)
        every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.col(m) - 1))
        left = asked.distinct().join(queries.select(F.col("id").alias("qid"), F.col("v").cast("array<double>").alias("v")), "qid").join(tasks, ["table_no", "cell"])
        left = left.select("table_no", "cell", F.lit(0).alias("side"), F.col("qid").alias("id"), "v", F.pmod(F.xxhash64("qid"), "qp").alias("qp"), every("pp").alias("pp"))
        points = self.shelves_read({int(t): cell[trees == t] for t in np.unique(trees)})
        if self.removed is not None:
            points = points.join(self.removed, "id", "left_anti")
        right = points.join(tasks, ["table_no", "cell"])
        right = right.select("table_no", "cell", F.lit(1).alias("side"), "id", "v", F.pmod(F.xxhash64("id"), "pp").alias("pp"), every("qp").alias("qp"))
        return brought_together(left, right, self.distance, self.dim, k, radius)

    def bounded(self) -> bool:
        """Have nodes a bound under the distance, so that exact searches can leave cells out?"""
        return True

    def _count(self, queries: DataFrame) -> int:
        n, dim = profile(queries)
        if n and dim != self.dim:
            raise VectorError(f"queries of {dim} components, points of {self.dim}")
        return n

    def _asked(self, queries: DataFrame, held: _Queries | None, n: int, k: int, params: SearchParams) -> tuple[DataFrame, float]:
        """((qid, table_no, cell) that a search looks into, a bound of their number)."""
        look = self._spread(held) if held is not None else queries
        if not self.exact and params.checks != -1:
            return self._cells_of(look, params.checks, k), n * float(min(max(params.checks, k) * len(self.forest.roots), len(self.forest.leaves())))
        # exact: what isn't beyond the k-th point of the first leaves met
        one = len(self.forest.leaves(0))
        first = self._cells_of(look, -1, k)
        near = ranked(self._scored(queries, held, first, n * float(min(k, one)), k), k)
        if held is not None and n * k * 24 <= exact.BROADCAST_BYTES:
            found = near.select("qid", "dist").toArrow()
            at, dist = np.searchsorted(held.ids, found["qid"].to_numpy()), found["dist"].to_numpy()
            count, worst = np.bincount(at, minlength=n), np.full(n, -np.inf)
            np.maximum.at(worst, at, dist)
            worst[count < k] = np.inf
            if n and (held.ids[1:] == held.ids[:-1]).any():  # queries that share an id have been ranked together: no bound
                worst[:] = np.inf
            limited = self._spread(held, worst)
        else:
            worst = near.groupBy("qid").agg(F.when(F.count("*") >= k, F.max("dist")).otherwise(float("inf")).alias("worst"))
            if held is not None:
                look = look.withColumn("row", F.col("id")).drop("id").join(self.spark.createDataFrame(pa.table({"row": np.arange(n), "id": held.ids})), "row")
            limited = look.join(worst, F.col("id") == F.col("qid"), "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
            limited = limited.select((F.col("row") if held is not None else F.col("id")).alias("id"), "v", "worst")
        return self._cells_of(limited, -1, k, worst=True, eps=params.eps), n * float(one)

    def knn(self, queries: DataFrame, k: int, params: SearchParams | None = None) -> DataFrame:
        if self.forest is None:
            raise ValueError("the index isn't built")
        params = params or SearchParams()
        whole = self.exact or params.checks == -1
        if whole and not self.exact and not self.bounded():
            return knn_join(queries, self.alive(), k, self.distance)
        n = self._count(queries)
        if self.scans(params, k):
            return knn_join(queries, self._tree_points(), k, self.distance)
        held = self._held(queries, n)
        if whole and n * len(self.forest.leaves(0)) > FEW_PROBES and self._looked_at(queries, held, n, k, params) >= (SCAN if held is not None else SCAN / 8):
            return knn_join(queries, self._tree_points(), k, self.distance)
        asked, most = self._asked(queries, held, n, k, params)
        found = self._scored(queries, held, asked, most, k)
        return ranked(found, k) if whole or self.removed is None else self._refilled(queries, k, found)

    def scans(self, params: SearchParams, k: int) -> bool:
        """Is a search's budget so large that it looks at all points?"""
        whole = self.exact or params.checks == -1
        return not whole and self._budget(params.checks, k) >= SCAN * self.forest.held[self.forest.roots[0]]

    def _budget(self, checks: int, k: int) -> int:
        """Places of points that a search within a budget looks at, over all trees."""
        return min(max(checks, k), int(self.forest.held[self.forest.roots[0]])) * len(self.forest.roots)

    def _tree_points(self) -> DataFrame:
        """(id, v) of all points, read from the cells of the first tree: every tree holds each of them once."""
        return self.alive_cells().where(F.col("table_no") == 0).select("id", "v")

    def _looked_at(self, queries: DataFrame, held: _Queries | None, n: int, k: int, params: SearchParams) -> float:
        """The mean share of all points that an exact search looks at, by WEIGHED queries: isotropic vectors leave no cell out."""
        if held is None:
            some = queries.orderBy(F.xxhash64("id"), "id").limit(WEIGHED).toArrow()
            few = _Queries(some["id"].to_numpy(), matrix(some["v"].combine_chunks(), self.dim))
        else:
            at = np.unique(np.linspace(0, n - 1, WEIGHED).astype(int))
            few = _Queries(held.ids[at], held.x[at])
        few.ids = np.arange(len(few.ids))  # no two share an id
        asked, _ = self._asked(self._spread(few), few, len(few.ids), k, params)
        cells = asked.groupBy("table_no", "cell").agg(F.count("*").alias("n")).toArrow()  # at most MAX_CELLS rows
        of = self.forest.leaf_of()
        met = sum(m * int(self.forest.held[of[t][c]]) for t, c, m in zip(*(cells[c].to_pylist() for c in ("table_no", "cell", "n")), strict=True))
        return met / (len(few.ids) * int(self.forest.held[self.forest.roots[0]]))

    def _refilled(self, queries: DataFrame, k: int, found: DataFrame) -> DataFrame:
        """ranked(found); queries whose cells had fewer than k points left after removals are searched by scan."""
        path = scratch(self.spark, "found")
        found.write.parquet(path)
        found = self.spark.read.schema(found.schema).parquet(path)
        enough = found.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("qid").alias("id"))
        short = queries.select("id", "v").join(enough, "id", "left_anti")
        if not short.take(1):
            return ranked(found, k)
        rest = knn_join(short, self.alive(), k, self.distance).select("qid", "id", "dist")
        full = found.join(enough.select(F.col("id").alias("qid")), "qid", "left_semi").select("qid", "id", "dist")
        return ranked(full.unionByName(rest), k)

    def radius(self, queries: DataFrame, radius: float, params: SearchParams | None = None) -> DataFrame:
        """(qid, rank, id, dist) of all points nearer than radius: exact, from the cells that may hold some (a scan where nothing bounds them)."""
        cap = (params or SearchParams()).max_neighbours
        if self.forest is None or not self.bounded():
            return super().radius(queries, radius, params)
        n = self._count(queries)
        points = int(self.forest.held[self.forest.roots[0]])
        if cap < 0 and n * len(self.forest.leaves(0)) > PROBES and points * 8 * (self.dim + 1) <= exact.WHOLE_BYTES:
            return self._radius_ranked(queries, n, points, float(radius))
        held = self._held(queries, n)
        look = self._spread(held, np.full(n, float(radius))) if held is not None else queries.select("id", "v", F.lit(float(radius)).alias("worst"))
        asked = self._cells_of(look, -1, 1, worst=True)
        most = None if cap < 0 else cap
        out = ranked(self._scored(queries, held, asked, n * float(len(self.forest.leaves(0))), None if most is None else max(most, 1), radius), most)
        return out.where("false") if cap == 0 else out

    def _radius_ranked(self, queries: DataFrame, n: int, points: int, radius: float) -> DataFrame:
        """radius() by tasks that hold the points of a tree: they ask it for their queries' cells and rank all that these find."""
        shared, d = self.spark.sparkContext.broadcast(self.forest), self.distance

        def answer(parts: list, ids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
            forest = shared.value
            cell, who, x = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.argsort(cell, kind="stable")
            cell, who, x = cell[order], who[order], x[order].astype(np.float64)

            def find(a: int, z: int) -> Iterator[pa.RecordBatch]:
                row, node = forest.within(d, q[a:z], np.full(z - a, radius), 0.0)
                asked = forest.cell[node]
                by = np.lexsort((row, asked))
                row, asked = row[by], asked[by]
                at = np.flatnonzero(np.concatenate((np.ones(min(len(row), 1), bool), asked[1:] != asked[:-1])))
                first, end = np.searchsorted(cell, asked[at]), np.searchsorted(cell, asked[at], side="right")
                for some in _together(list(zip(at.tolist(), [*at[1:].tolist(), len(row)], first.tolist(), end.tolist(), strict=True))):
                    yield from _meet(d, None, ids[a:z], q[a:z], row, some, who, x, radius)

            # queries next to each other ask for the same cells: ids are numbered by the place of their first query
            own, at = np.unique(ids, return_inverse=True)
            place = np.full(len(own), np.inf)
            np.minimum.at(place, at, q[:, along])
            by_place = np.argsort(place, kind="stable")
            number = np.empty(len(own), np.int64)
            number[by_place] = np.arange(len(own))
            order = np.argsort(number[at], kind="stable")
            ids, q = number[at][order], q[order]
            for b in exact.ranks_within(ids, find, exact.RANKED // 4):
                yield b.set_column(0, "qid", pa.array(own[by_place][b.column(0).to_numpy()]))

        extent = queries.agg(*[(F.max(x) - F.min(x)).cast("double") for x in (F.get("v", F.lit(i)) for i in range(self.dim))]).first()
        along = int(np.argmax([e or 0.0 for e in extent]))
        stored = self.alive_cells().where(F.col("table_no") == 0).select("cell", "id", "v")
        return exact.by_all_points(queries, stored, n, points, self.dim, answer, exact.RANKS, along)

    def visited(self, queries: DataFrame, k: int, params: SearchParams | None = None) -> DataFrame:
        """(qid, cells, points, share): what a search looks into for each query (ids are taken as different), and its share of all points of a
        tree; several trees can make it more than 1."""
        n = self._count(queries)
        asked, _ = self._asked(queries, None, n, k, params or SearchParams())
        of = self.forest.leaf_of()
        held = [(t, c, int(self.forest.held[i])) for t, nodes in enumerate(of) for c, i in enumerate(nodes.tolist()) if i >= 0]
        total = int(self.forest.held[self.forest.roots[0]])
        sizes = F.broadcast(self.spark.createDataFrame(held, "table_no int, cell long, held long"))  # at most MAX_CELLS rows a tree
        out = asked.join(sizes, ["table_no", "cell"]).groupBy("qid").agg(F.count("*").alias("cells"), F.sum("held").alias("points"))
        return out.withColumn("share", F.col("points") / total)

    # storage

    def state(self) -> dict:
        f = self.forest
        return {"roots": f.roots, "cells": f.cells, "dims": f.dims, "widths": self.widths, "limit": self.limit, "components": self._components(), "crowds": [list(c.items()) for c in self.crowds]}

    def restore(self, state: dict) -> None:
        self.widths, self.limit, self.crowds = state["widths"], state["limit"], [dict(c) for c in state["crowds"]]
        self._saved = state

    def _components(self) -> str:
        return "float" if all(kind == "float" for _, kind in self.tables) else "double"

    def save_points(self, folder: str) -> None:
        """The cells of the first tree hold them."""

    @classmethod
    def saved_points(cls, spark: SparkSession, folder: str, meta: dict, children: dict[str, VectorIndex]) -> DataFrame:
        if "components" not in meta["state"]:  # saved before cells held them
            return spark.read.parquet(f"{folder}/points")
        stored = spark.read.schema(STORED.format(meta["state"]["components"])).parquet(f"{folder}/cells")
        return stored.where(F.col("table_no") == 0).select("id", F.col("v").cast("array<double>").alias("v"))

    def save_cells(self, folder: str) -> None:
        """cells, partitioned as ever, and nodes: a row per node."""
        cells = self.alive_cells()
        widths = F.array(*[F.lit(w) for w in self.widths])
        cells = cells.withColumn("shelf", F.floor(F.col("cell") / F.get(widths, F.col("table_no"))).cast("int"))
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))  # a file a shelf, whatever wrote it
        cells = cells.select("cell", "id", slim(F.col("v"), self._components() == "float").alias("v"), "table_no", "shelf")
        cells.repartition(parts, "table_no", "shelf").sortWithinPartitions("table_no", "shelf", "cell").write.mode("overwrite").options(**PLAIN).option("compression", "lz4").partitionBy("table_no", "shelf").parquet(f"{folder}/cells")
        columns = {"node": pa.array(np.arange(len(self.forest)))}
        for name, (_, wide) in self.forest.fields.items():
            x = getattr(self.forest, name)
            columns[name] = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())) if wide else pa.array(x)
        self.spark.createDataFrame(pa.table(columns)).write.mode("overwrite").option("compression", "lz4").parquet(f"{folder}/nodes")

    def load_cells(self, folder: str) -> None:
        rows = self.spark.read.parquet(f"{folder}/nodes").orderBy("node").toArrow()  # at most 2 MAX_CELLS rows
        kind = self.blank()
        state = {name: rows[name].to_pylist() for name in kind.fields}
        self.forest = type(kind).load(state | {k: self._saved[k] for k in ("roots", "cells", "dims")})
        self.tables = [(f"{folder}/cells", self._saved.get("components", "double"))]
