"""Exact top-k inner products by dual-tree search over cover trees.

Vectors lie in cells, each about a pivot, and cells in blocks of BLOCK_BYTES at most. A query first meets one block of the cell whose pivot
it scores best with; that gives its kth score so far. It then goes only to blocks of cells that can still score as much: at most q.c + |q| r
for a pivot c and the cell's radius r. Pivots come from a bounded sample, radii from all rows.

Where queries and a block meet, both sides are indexed once: a node has a centre and a covering radius over all below it, and its children
cover it within radii shrunk by BASE. A pair of nodes can score at most c.d + |c| s + |d| r + r s (centres c and d, radii r and s); where
that is below the worst kth score of every query in the query node, the pair is pruned. Otherwise the wider node is opened, best bounds
first; leaves are scored exactly. The k best of every meeting are merged.

Defined cases: a vector that is null, empty or holds a null or non-finite component (or one that isn't finite times SCALE) takes no part,
neither does a row with a null id; of rows that share an id each is a candidate and the smallest vector is the query; vectors of other
lengths than the query's aren't compared with it; fewer than k candidates give them all; ties go to the smaller id; scores beyond 64 bits
count as the least or greatest 64-bit number; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, mix64, released

K = 5
EVERY = 50
SCALE = 256
QUERY_BLOCK, DATA_BLOCK = 1024, 4096  # vectors of a tree, at most
BLOCK_BYTES = 16 << 20  # of the vectors of a block, and of the queries that meet it in one task
CELL_ROWS = 4096  # vectors of a cell, about, as long as there are no more than MOST_CELLS
MOST_CELLS = 1024
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20  # vectors that the pivots are drawn from, at most
LEAST, GREATEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
LEAF = 48
BASE = 1.3


class Node:
    __slots__ = ("centre", "norm", "radius", "members", "children", "centres", "norms", "radii")

    def __init__(self, centre: np.ndarray, radius: float, members: np.ndarray):
        self.centre, self.norm, self.radius, self.members = centre, float(np.sqrt(centre @ centre)), radius, members
        self.children: list[Node] = []


class CoverTree:
    """A cover tree over the rows of x, built from the top: nodes of at most LEAF members are leaves, and stragglers of a level share one."""

    def __init__(self, x: np.ndarray):
        self.x = x
        every = np.arange(len(x))
        self.root = self._node(x[0], every)
        work = [self.root]
        while work:
            node = work.pop()
            if len(node.members) > LEAF and 0 < node.radius < np.inf:
                self._open(node)
                work += node.children

    def _node(self, centre: np.ndarray, members: np.ndarray) -> Node:
        d = self.x[members] - centre
        return Node(centre, float(np.sqrt((d * d).sum(axis=1).max())), members)

    def _open(self, node: Node) -> None:
        reach = node.radius / BASE
        rest, rows = node.members, self.x[node.members]
        centre, loose = node.centre, []
        while len(rest):
            d = rows - centre
            near = (d * d).sum(axis=1) <= reach * reach
            taken = rest[near]
            if len(taken) >= LEAF // 4:
                node.children.append(self._node(centre, taken))
            elif len(taken):
                loose.append(taken)
            rest, rows = rest[~near], rows[~near]
            if len(rest):
                centre = rows[0]
        if loose:
            loose = np.concatenate(loose)
            for at in range(0, len(loose), LEAF):  # they lie far from one another: leaves of their own
                part = loose[at : at + LEAF]
                node.children.append(self._node(self.x[part].mean(axis=0), part))
        node.centres = np.stack([c.centre for c in node.children])
        node.norms = np.array([c.norm for c in node.children])
        node.radii = np.array([c.radius for c in node.children])


class Search:
    """The k best candidates of some queries, over as many trees of candidates as it is given. A candidate of the query's own id is none.

    floor: a score per query that a candidate must reach (LEAST where nothing is known).
    """

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.q, self.query_ids, self.k = queries, query_ids, k
        self.trees = [(at, CoverTree(queries[at : at + QUERY_BLOCK])) for at in range(0, len(queries), QUERY_BLOCK)]
        self.worst = np.full(len(queries), LEAST) if floor is None else floor.copy()
        self.score, self.id = np.full((len(queries), k), LEAST), np.full((len(queries), k), GREATEST)
        self.some = np.zeros((len(queries), k), bool)

    def meet(self, data: np.ndarray, ids: np.ndarray) -> None:
        tree = CoverTree(data)
        peak = max(float(np.abs(self.q).max()), float(np.abs(data).max()))
        exact = data.shape[1] * peak * peak < 2.0**53  # beyond, doubles don't hold the scores: whole numbers of any size do
        for at, mine in self.trees:
            self._descend(at, mine, tree, ids, exact)

    def _descend(self, at: int, mine: CoverTree, tree: CoverTree, ids: np.ndarray, exact: bool) -> None:
        stack = [(np.inf, mine.root, tree.root)]
        while stack:
            bound, a, b = stack.pop()
            worst = int(self.worst[at + a.members].min())
            if worst > LEAST and bound < worst:
                continue
            if not a.children and not b.children:
                self._leaves(at + a.members, tree.x[b.members], ids[b.members], exact)
                continue
            first = bool(a.children) and (not b.children or a.radius > b.radius)
            node, other = (a, b) if first else (b, a)
            bounds = node.centres @ other.centre + node.norms * other.radius + other.norm * node.radii + other.radius * node.radii
            bounds += (node.norms + node.radii) * (other.norm + other.radius) * 1e-9 + 1e-6  # above any rounding
            for i in np.argsort(bounds).tolist():  # the best lies on top of the stack
                stack.append((bounds[i], node.children[i], b) if first else (bounds[i], a, node.children[i]))

    def _leaves(self, rows: np.ndarray, data: np.ndarray, ids: np.ndarray, exact: bool) -> None:
        if exact:
            s = (self.q[rows] @ data.T).astype(np.int64)
        else:
            whole = [[[int(v) for v in row] for row in x] for x in (self.q[rows], data)]
            s = np.array([[max(LEAST, min(GREATEST, sum(a * b for a, b in zip(x, y, strict=True)))) for y in whole[1]] for x in whole[0]], np.int64)
        fit = (s >= self.worst[rows][:, None]) & (self.query_ids[rows][:, None] != ids[None, :])
        for i in np.flatnonzero(fit.any(axis=1)).tolist():
            r, use = rows[i], fit[i]
            score, who = np.concatenate((self.score[r], s[i][use])), np.concatenate((self.id[r], ids[use]))
            some = np.concatenate((self.some[r], np.ones(int(use.sum()), bool)))
            order = np.lexsort((who, ~score, ~some))[: self.k]
            self.score[r], self.id[r], self.some[r] = score[order], who[order], some[order]
            if self.some[r, -1]:
                self.worst[r] = max(self.worst[r], self.score[r, -1])


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids), a row per query: its k best candidates in order, LEAST and GREATEST where there are fewer."""
    search = Search(queries, query_ids, k)
    search.meet(data, ids)
    return search.score, search.id


def _matrix(vectors: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    """Rows of one length, as whole numbers."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, length))


def _met(k: int):
    """The k best of every query (side 0) among the vectors (side 1) of a block."""

    def run(table: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        side = table["side"].to_numpy()
        asked, held = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        if not len(asked) or not len(held):
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        length, ids = table["n"][0].as_py(), held["id"].to_numpy()
        search = Search(_matrix(asked["v"], length), asked["id"].to_numpy(), k, asked["least"].fill_null(LEAST).to_numpy())
        x = _matrix(held["v"], length)
        for at in range(0, len(x), DATA_BLOCK):
            search.meet(x[at : at + DATA_BLOCK], ids[at : at + DATA_BLOCK])
        row, place = np.nonzero(search.some)
        return pa.table([pa.array(a) for a in (search.query_ids[row], search.id[row, place], search.score[row, place])], names=names)

    return run


def _pivots(rows: DataFrame, n: int, longest: int) -> dict[int, np.ndarray]:
    """Pivots by length of vector, means of near rows of a sample; a length that isn't in it has the origin alone."""
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * longest)))
    share = max(1, n // most)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select(F.size("v").alias("n"), "v").limit(most).toArrow()
    lengths, out = sample["n"].to_numpy(), {}
    for length in np.unique(lengths).tolist():
        x = _matrix(sample.filter(pa.array(lengths == length))["v"], length)
        centres = x[np.random.default_rng(length).permutation(len(x))[: max(1, min(MOST_CELLS, len(x) * share // CELL_ROWS))]]
        for _ in range(3):
            near = _nearest(x, centres)[0]
            sums, count = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
            np.add.at(sums, near, x)
            centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
        out[length] = centres
    return out


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row and the distance to it; any near one would do, but the distance is that to the one named."""
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.concatenate([np.argmin((centres * centres).sum(axis=1) - 2 * (x[a : a + 1024] @ centres.T), axis=1) for a in range(0, len(x), 1024)] or [np.zeros(0, np.int64)])
        return near, np.nan_to_num(np.sqrt(((x - centres[near]) ** 2).sum(axis=1)), nan=np.inf)


def _by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    lengths = vectors.value_lengths().to_numpy()
    for length in np.unique(lengths).tolist():
        yield length, np.flatnonzero(lengths == length)


def _placed(pivots):
    """(id, v) with cell and far, the distance to the cell's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for length, at in _by_length(batch.column(1)):
                x = _matrix(batch.column(1).take(pa.array(at)), length)
                cell[at], far[at] = _nearest(x, pivots.value.get(length, np.zeros((1, length))))
            yield pa.record_batch([*batch.columns, pa.array(cell), pa.array(far)], names=["id", "v", "cell", "far"])

    return run


def _asking(pivots, cells, first: bool):
    """(id, v, least) with the cells to ask, n, and the place (one, seed) of the block that is met first.

    first: that block's cell alone. Otherwise all cells that can score least or more; cells: {length: {cell: radius}}.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked: list[list[int]] = [[]] * batch.num_rows
            one, size = np.zeros(batch.num_rows, np.int32), batch.column(1).value_lengths()
            least = batch.column(2).fill_null(LEAST).to_numpy()
            for length, at in _by_length(batch.column(1)):
                known = cells.value[length]
                name, radius = np.array(list(known), np.int32), np.array(list(known.values()))
                centres = pivots.value.get(length, np.zeros((1, length)))[name]
                norms = np.sqrt((centres * centres).sum(axis=1))
                for part in np.array_split(at, -(-len(at) // 1024)):
                    q = _matrix(batch.column(1).take(pa.array(part)), length)
                    score, norm = q @ centres.T, np.sqrt((q * q).sum(axis=1))[:, None]
                    one[part] = name[score.argmax(axis=1)]
                    with np.errstate(over="ignore", invalid="ignore"):
                        bound = score + norm * radius + norm * (norms + radius) * 1e-9 + 1e-6  # above any rounding
                    out = (bound < least[part][:, None]) & (least[part] > LEAST)[:, None]
                    for i, r in enumerate(part.tolist()):
                        asked[r] = [int(one[r])] if first else name[~out[i]].tolist()
            seed = (mix64(batch.column(0).to_numpy().astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
            yield pa.record_batch([*batch.columns, pa.array(asked, pa.list_(pa.int32())), size, pa.array(one), pa.array(seed)], names=["id", "v", "least", "cells", "n", "one", "seed"])

    return run


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest integer inner products of floor(256 x) for every row whose key is divisible by every."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    inf = F.lit(float("inf"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * SCALE < inf)))
    asking = F.col("id") % every == 0
    count, longest, asked = rows.agg(F.count("*"), F.max(F.size("v")), F.sum(F.when(asking, F.size("v").cast("long")))).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = spark.sparkContext.broadcast(_pivots(rows, count, longest))
    placed = rows.mapInArrow(_placed(pivots), "id long, v array<double>, cell int, far double")
    placed = materialize(spark, placed.withColumn("n", F.size("v")), "placed")

    # a row per cell, MOST_CELLS of a length at most
    size = placed.groupBy("n", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("rows")).collect()
    cells = spark.sparkContext.broadcast({length: {r["cell"]: r["radius"] for r in size if r["n"] == length} for length in {r["n"] for r in size}})
    parts = [(r["n"], r["cell"], -(-r["rows"] * r["n"] * 8 // BLOCK_BYTES)) for r in size]
    parts = F.broadcast(spark.createDataFrame(parts, "n int, cell int, parts long"))
    data = placed.join(parts, ["n", "cell"]).select("n", "cell", F.pmod(F.xxhash64("id", "v"), "parts").alias("part"), "id", "v")
    queries = placed.where(asking).groupBy("id").agg(F.min("v").alias("v"))
    shape = "id long, v array<double>, least long, cells array<int>, n int, one int, seed long"
    tasks = -(-asked * 8 // BLOCK_BYTES)  # in as many shares queries meet a block
    block = ["n", "cell", "part", "share"]

    def meet(queries: DataFrame, first: bool, label: str) -> DataFrame:
        to = queries.mapInArrow(released(_asking(pivots, cells, first)), shape)
        to = to.withColumn("cell", F.explode("cells")).join(parts, ["n", "cell"])
        begin = F.col("seed") % F.col("parts")
        if first:
            to = to.withColumn("part", begin)
        else:
            to = to.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where((F.col("cell") != F.col("one")) | (F.col("part") != begin))
        to = to.select(*block[:3], F.pmod(F.xxhash64("id"), F.lit(tasks)).alias("share"), "id", "v", "least", F.lit(0).alias("side"))
        to = materialize(spark, to, f"{label}-queries")
        held = data.join(to.select(*block).distinct(), block[:3]).select(*block, "id", "v", F.lit(None).cast("long").alias("least"), F.lit(1).alias("side"))
        met = to.unionByName(held).groupBy(*block).applyInArrow(_met(k), "query_id long, vec_id long, score long")
        return materialize(spark, met, label)

    begun = meet(queries.withColumn("least", F.lit(None).cast("long")), True, "first")
    least = begun.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    more = meet(queries.join(least, "id", "left").select("id", "v", "least"), False, "second")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return begun.unionByName(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle() -> str:
    return f"""
WITH e AS (
    SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]))::BIGINT AS score
    FROM e q JOIN e c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}
"""
