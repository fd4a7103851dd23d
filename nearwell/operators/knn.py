"""Exact nearest-neighbour and radius joins.

Queries that fit BROADCAST_BYTES are sent to every task as a matrix, and the base is scanned where it lies: each task keeps its k nearest
per query (or what lies within the radius), and only those are shuffled to be merged. More than DEALT queries are dealt over tasks instead
and the base is sent, or, where the base is too large for that, the base is dealt: where it lies it may be a single task's. Where neither
side fits, both are dealt into blocks, once each, and a task reads a block of either; every pair of blocks is a task. Vectors that single
precision holds are sent and shuffled in it. No pair of vectors is ever a row. method="expression" writes the
distance as a Column instead, over a nested-loop join and a limited window, and is the choice for a handful of queries; more than
FEW_QUERIES are dealt in blocks.

What lies within a radius grows with the square of the tables. More than DEALT queries are therefore dealt over tasks that have all points
(up to WHOLE_BYTES), and ranked there: no found pair is shuffled.

Vectors are arrays, or BINARY columns of unsigned bytes, which stay bytes up to the kernels (`functions/packed.py`).

Order is (dist, id) throughout. Null or empty vectors, null or non-finite components and vectors of several lengths raise VectorError; a
distance may be infinite (squares of large components are), a pair whose distance isn't a number is no pair; k above the number of
candidates returns them all. All forms agree on this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distances
from ..functions.packed import packed
from ..functions.vectors import VectorError, checked, is_binary, profile, slim, survey

BROADCAST_BYTES = 64 << 20
FEW_QUERIES = 32
DEALT = 4096  # queries from which one side is dealt over TASKS tasks a core
TASKS = 4
CELLS = 1 << 19  # distances computed at a time
PAIRS = 1 << 9  # single pairs computed at a time: both sides stay in a core's cache
ROUGH = 1 / 16  # share of pairs that rough near values may leave to compute; else finer ones are asked for
FLOOR = 1 / 8  # the same of lower bounds, after which there is more to save
READY = 1 << 14  # points that are prepared for near values at a time
FLAT = 4  # components up to which tiles of queries leave tiles of points out
TILE = 256  # rows of a tile
TILED = 1 << 18  # points that are cut into tiles at a time
WHOLE_BYTES = 512 << 20  # vectors that a task may hold, so that all a query finds is ranked there
TILE_BYTES = 16 << 20  # of them that are read at a time
GROUP_BYTES = 16 << 20  # queries of a task that holds them
RANKED = 1 << 21  # found pairs that a task ranks at a time, about
RANKS = "qid long, rank int, id long, dist double"
SCHEMA = "qid long, id long, dist double"
COUNTS = "qid long, n long"


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A column of equally long lists as rows of doubles, or of equally long BINARY values as rows of unsigned bytes."""
    if column.null_count:
        raise VectorError("null vector")
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        sizes = pc.binary_length(column).to_numpy()
        dim = int(sizes[0]) if dim is None and len(sizes) else dim or 0
        if (sizes != dim).any():
            raise VectorError("vectors of several lengths")
        start = column.buffers()[1] if len(sizes) else None
        offsets = np.frombuffer(start, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset :] if len(sizes) else [0]
        return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[0] + dim * len(sizes)].reshape(len(sizes), dim) if len(sizes) else np.zeros((0, dim), np.uint8)
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    dim = int(sizes[0]) if dim is None and len(sizes) else dim or 0
    if len(sizes) and (sizes != dim).any() or column.flatten().null_count:
        raise VectorError("vectors of several lengths or with null components")
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), dim)
    if not np.isfinite(out).all():
        raise VectorError("vectors with components that are no finite numbers")
    return out


_FREE = np.iinfo(np.int64).max  # the id of a place that no point has taken


def _above(x: np.ndarray, dtype) -> np.ndarray:
    """x in another precision, and not below x."""
    with np.errstate(over="ignore"):
        return np.nextafter(np.asarray(x).astype(dtype), np.array(np.inf, dtype))


class _Best:
    """The k nearest per query so far, by (dist, id). A distance of NaN marks a pair that is left out: it is never admitted."""

    def __init__(self, queries: int, k: int, unique: bool = False):
        """unique: a point may be offered again (it lies in several trees) and then counts once."""
        self.unique = unique
        self.k, self.dist, self.id = k, np.full((queries, k), np.inf), np.full((queries, k), _FREE)

    def _merge(self, r: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        """As _take, for pairs of many queries: r has the query of each."""
        mine = np.unique(r)
        who = np.concatenate((np.repeat(mine, self.k), r))
        d, point = np.concatenate((self.dist[mine].ravel(), dist)), np.concatenate((self.id[mine].ravel(), ids))
        order = np.lexsort((point, d, who))
        if self.unique:
            w, d_, p = who[order], d[order], point[order]
            order = order[np.concatenate(([True], (w[1:] != w[:-1]) | (p[1:] != p[:-1]) | (d_[1:] != d_[:-1]) | (p[1:] == _FREE)))]
        first = np.searchsorted(who[order], mine)  # every query has k places or more
        best = order[first[:, None] + np.arange(self.k)]
        self.dist[mine], self.id[mine] = d[best], point[best]

    def _take(self, r: int, dist: np.ndarray, ids: np.ndarray) -> None:
        d, who = np.concatenate((self.dist[r], dist)), np.concatenate((self.id[r], ids))
        order = np.lexsort((who, d))
        if self.unique:
            who_, d_ = who[order], d[order]
            fresh = np.concatenate(([True], (who_[1:] != who_[:-1]) | (d_[1:] != d_[:-1]) | (who_[1:] == _FREE)))
            order = order[fresh]
        order = order[: self.k]
        self.dist[r], self.id[r] = d[order], who[order]

    def add(self, rows: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        """Distances of the queries with the numbers rows to points ids."""
        worst = self.dist[rows, -1]
        for i in np.flatnonzero((dist <= worst[:, None]).any(axis=1)).tolist():
            r = int(rows[i])
            near = np.flatnonzero(dist[i] <= self.dist[r, -1])
            near = near[(dist[i][near] < self.dist[r, -1]) | (ids[near] <= self.id[r, -1])]  # of equal distances the smaller id is first
            if not len(near):
                continue
            if len(near) > 4 * self.k:
                kth = np.partition(dist[i][near], self.k)[self.k]
                near = near[dist[i][near] <= kth]
            self._take(r, dist[i][near], ids[near])

    def add_bounded(self, rows: np.ndarray, near: np.ndarray, error: np.ndarray, exact, ids: np.ndarray, rough: bool = False, floor: bool = False) -> bool:
        """As add, for distances within error of near: only what may be among the k nearest is computed, by exact(rows, columns).

        What is NaN in near stays out, also where fewer than k have been found. rough: nothing is done, and False returned, where near
        leaves too many pairs to compute. floor: distances aren't below near by more than error, but may be far above it.
        """
        most, width = float(error.max(initial=0)), near.shape[1]
        worst = self.dist[rows, -1]
        if floor and np.isinf(worst).any():
            return False
        at = np.flatnonzero(near <= _above(worst + most, near.dtype)[:, None])
        if not floor:
            edge = np.searchsorted(at, np.arange(len(rows) + 1) * width)
            keep = np.ones(len(at), bool)
            for i in np.flatnonzero(np.diff(edge) > self.k).tolist():
                some = near[i, at[edge[i] : edge[i + 1]] - i * width]
                kth = np.partition(some, self.k - 1)[self.k - 1]
                keep[edge[i] : edge[i + 1]] = some <= _above(np.float64(kth) + 2 * most, near.dtype)
            at = at[keep]
        if rough and len(at) > max((FLOOR if floor else ROUGH) * near.size, 4 * self.k * len(rows)):
            return False
        if len(at):
            i, j = np.divmod(at, width)
            dist = np.concatenate([exact(i[a : a + PAIRS], j[a : a + PAIRS]) for a in range(0, len(i), PAIRS)])
            if floor:
                close = dist <= worst[i]
                i, j, dist = i[close], j[close], dist[close]
            if len(i):
                self._merge(rows[i], dist, ids[j])
        return True

    def found(self, qids: np.ndarray, radius: float | None = None) -> pa.RecordBatch:
        """(qid, id, dist) of all places that are taken."""
        i, j = np.nonzero((self.id != _FREE) & ((self.dist < radius) if radius is not None else True))
        return pa.record_batch([pa.array(qids[i]), pa.array(self.id[i, j]), pa.array(self.dist[i, j])], names=["qid", "id", "dist"])


def _hide_same(near: np.ndarray, qids: np.ndarray, ids: np.ndarray) -> None:
    """Pairs of equal ids don't meet."""
    i = np.flatnonzero(np.isin(qids, ids))
    near[i] = np.where(qids[i, None] == ids[None, :], np.nan, near[i])


def meet(d, best: _Best | None, part: np.ndarray, qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, radius: float | None, itself: bool, hide: np.ndarray | None = None, ready: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """The queries with the numbers part (their ids and vectors are qids and q) meet points: their best are kept, or all within radius told.

    hide marks pairs that don't meet. ready are rough near values and their error, where a screen has them.
    """
    for rough in (True, False):
        bounds = ready if rough and ready is not None else d.bounds(q, x, rough)
        if bounds is None:
            continue
        near, error = bounds  # they tell which pairs must be computed
        if hide is not None:
            near[hide] = np.nan
        if not itself:
            _hide_same(near, qids, ids)
        exact = lambda i, j: d.pairs(q[i], x[j])
        if best is not None:
            if radius is not None:
                near[near >= _above(np.float64(radius) + float(error.max(initial=0)), near.dtype)] = np.nan
            if best.add_bounded(part, near, error, exact, ids, rough):
                return
            continue
        at = np.flatnonzero(near < _above(np.float64(radius) + float(error.max(initial=0)), near.dtype))
        if rough and len(at) > ROUGH * near.size:
            continue
        i, j = np.divmod(at, near.shape[1])
        for s in range(0, len(i), PAIRS):
            dist = exact(i[s : s + PAIRS], j[s : s + PAIRS])
            m = dist < radius
            yield pa.record_batch([pa.array(qids[i[s : s + PAIRS][m]]), pa.array(ids[j[s : s + PAIRS][m]]), pa.array(dist[m])], names=["qid", "id", "dist"])
        return
    dist = d.matrix(q, x)
    if hide is not None:
        dist[hide] = np.nan
    if not itself:
        dist[qids[:, None] == ids[None, :]] = np.nan
    if best is not None:
        if radius is not None:
            dist[dist >= radius] = np.nan
        best.add(part, dist, ids)
        return
    i, j = np.nonzero(dist < radius)
    if len(i):
        yield pa.record_batch([pa.array(qids[i]), pa.array(ids[j]), pa.array(dist[i, j])], names=["qid", "id", "dist"])


def _tiles(x: np.ndarray) -> list[np.ndarray]:
    """Row numbers in tiles of at most TILE rows: halved at the median of the widest component."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= TILE:
            out.append(rows)
            continue
        part = x[rows]
        order = np.argpartition(part[:, np.argmax(part.max(axis=0) - part.min(axis=0))], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def _corners(x: np.ndarray, tiles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x[t].min(axis=0) for t in tiles]), np.array([x[t].max(axis=0) for t in tiles])


def _scan_tiles(qids: np.ndarray, q: np.ndarray, chunks: Iterator[tuple[np.ndarray, np.ndarray]], d, best: _Best | None, radius: float | None, itself: bool) -> Iterator[pa.RecordBatch]:
    """As _scan, for few components: tiles of queries meet the nearest tiles of points first and leave out those beyond their worst kth."""
    mine = _tiles(q)
    low, high = _corners(q, mine)

    def large() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held: list = []
        for chunk in chunks:
            held.append(chunk)
            if sum(len(c[0]) for c in held) >= TILED:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held = []
        if held:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    for ids, x in large():
        theirs = _tiles(x)
        first, last = _corners(x, theirs)
        for part, a, z in zip(mine, low, high, strict=True):
            gap = np.maximum(0.0, np.maximum(first - z, a - last))  # of differences only the least counts
            bound = d.pairs(gap, np.zeros_like(gap)) * (1 - 1e-9)
            for t in np.argsort(bound, kind="stable").tolist():
                if best is not None and bound[t] > best.dist[part, -1].max() or radius is not None and bound[t] >= radius:
                    break
                yield from meet(d, best, part, qids[part], q[part], ids[theirs[t]], x[theirs[t]], radius, itself)


def _pieces(chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for ids, x in chunks:
        for a in range(0, len(ids), READY):
            yield ids[a : a + READY], x[a : a + READY]


def _scan(qids: np.ndarray, q: np.ndarray, chunks: Iterator[tuple[np.ndarray, np.ndarray]], name, k: int | None, radius: float | None, itself: bool) -> Iterator[pa.RecordBatch]:
    """(qid, id, dist) batches of the k nearest of every query (within a radius, if one is given), or of all within the radius."""
    d = distances.get(name)
    best = _Best(len(qids), k) if k is not None else None
    rows = max(1, min(len(qids) or 1, 256))
    if len(qids) > TILE and q.shape[1] <= FLAT and q.dtype == np.float64 and distances.of_differences(d):
        yield from _scan_tiles(qids, q, chunks, d, best, radius, itself)
        chunks = iter(())
    held = np.empty(CELLS, np.float32)
    width = max(1, CELLS // rows)
    rest, missed = np.zeros(-(-len(qids) // rows), int), np.zeros(-(-len(qids) // rows), int)  # blocks to pass without a floor, by part
    for ids, x in _pieces(chunks):
        screen = d.screen(q, x)
        for c in range(0, len(ids), width):
            who, points = ids[c : c + width], x[c : c + width]
            for a in range(0, len(qids), rows):
                part = np.arange(a, min(a + rows, len(qids)))
                ready = None
                if screen is not None and not screen.floor:
                    ready = screen.near(slice(a, a + rows), slice(c, c + width), held)
                elif screen is not None and best is not None and radius is None and not np.isinf(best.dist[part, -1]).any():
                    if rest[a // rows]:
                        rest[a // rows] -= 1
                    else:
                        near, error = screen.near(slice(a, a + rows), slice(c, c + width), held)
                        if not itself:
                            _hide_same(near, qids[part], who)
                        if best.add_bounded(part, near, error, lambda i, j, a=a, points=points: d.pairs(q[a + i], points[j]), who, True, True):
                            continue
                        rest[a // rows] = 1 << min(missed[a // rows], 10)  # bounds get better with the kth best, or never do
                        missed[a // rows] += 1
                yield from meet(d, best, part, qids[part], q[part], who, points, radius, itself, ready=ready)
    if best is not None:
        yield best.found(qids, radius)


def _below(x: np.ndarray, dtype) -> np.ndarray:
    """x in another precision, and not above x."""
    return -_above(-np.asarray(x), dtype)


def _inside(d, near: np.ndarray, error: np.ndarray, q: np.ndarray, x: np.ndarray, radius: float, most: float) -> np.ndarray | None:
    """How many points lie within the radius of every query: near values tell it but for pairs within error of the radius, which are computed.

    None: these are more than a share of most.
    """
    off = float(error.max(initial=0))
    sure = near < _below(np.float64(radius) - off, near.dtype)
    at = np.flatnonzero((near < _above(np.float64(radius) + off, near.dtype)) & ~sure)
    if len(at) > most * near.size:
        return None
    out = np.count_nonzero(sure, axis=1)
    i, j = np.divmod(at, near.shape[1])
    for s in range(0, len(at), PAIRS):
        some = i[s : s + PAIRS]
        out += np.bincount(some[d.pairs(q[some], x[j[s : s + PAIRS]]) < radius], minlength=len(q))
    return out


def _count(qids: np.ndarray, q: np.ndarray, chunks: Iterator[tuple[np.ndarray, np.ndarray]], name, radius: float, itself: bool) -> Iterator[pa.RecordBatch]:
    """(qid, n) batches: how many points lie within the radius of a query, where there are any. No pair leaves the kernel."""
    d = distances.get(name)
    n = np.zeros(len(qids), np.int64)
    if len(qids) > TILE and q.shape[1] <= FLAT and q.dtype == np.float64 and distances.of_differences(d):
        order = np.argsort(qids, kind="stable")  # queries of one id are counted together
        for b in _scan_tiles(qids, q, chunks, d, None, radius, itself):
            n[order] += np.bincount(np.searchsorted(qids[order], b.column(0).to_numpy()), minlength=len(qids))
        chunks = iter(())
    rows = max(1, min(len(qids) or 1, 256))
    held, width = np.empty(CELLS, np.float32), max(1, CELLS // rows)
    for ids, x in _pieces(chunks):
        screen = d.screen(q, x)
        for c in range(0, len(ids), width):
            who, points = ids[c : c + width], x[c : c + width]
            for a in range(0, len(qids), rows):
                part = slice(a, a + rows)
                found = None
                for rough in (True, False):
                    if rough and screen is not None and not screen.floor:
                        bounds = screen.near(part, slice(c, c + width), held)
                    else:
                        bounds = d.bounds(q[part], points, rough)
                    if bounds is not None:
                        if not itself:
                            _hide_same(bounds[0], qids[part], who)
                        found = _inside(d, *bounds, q[part], points, radius, ROUGH if rough else 1)
                        if found is not None:
                            break
                if found is None:
                    dist = d.matrix(q[part], points)
                    if not itself:
                        _hide_same(dist, qids[part], who)
                    found = np.count_nonzero(dist < radius, axis=1)
                n[part] += found
    yield pa.record_batch([pa.array(qids[n > 0]), pa.array(n[n > 0])], names=["qid", "n"])


def best_of(qids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, distance, k: int | None, radius: float | None = None, itself: bool = True) -> pa.Table:
    """(qid, id, dist): the k nearest rows of x for every row of q, or all within the radius."""
    empty = pa.table({"qid": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
    out = list(_scan(qids, q, iter([(ids, x)]), distance, k, radius, itself)) if len(qids) and len(ids) else []
    return pa.Table.from_batches(out) if out else empty


def _pairs(queries: DataFrame, base: DataFrame, distance, k: int | None, radius: float | None, itself: bool, n: int, dim: int, counted: bool = False) -> DataFrame:
    """(qid, id, dist) of at least the k nearest of every query, or of all within the radius; counted: (qid, n) of a task's points within it.

    There are n queries of dim components.
    """
    spark = base.sparkSession
    bytes_, points, single = is_binary(queries), 0, False
    tasks = TASKS * spark.sparkContext.defaultParallelism
    if n > DEALT or n * (dim + 8 if bytes_ else 8 * (dim + 1)) > BROADCAST_BYTES:
        points, _, single = survey(base, single=True)
        single = single and (base is queries or survey(queries, single=True)[2])
        if single:  # sent and shuffled at half the size; kernels get doubles
            queries, base = (df.select("id", slim(F.col("v")).alias("v")) for df in (queries, base))
    width = dim + 8 if bytes_ else (4 if single else 8) * dim + 8

    schema = COUNTS if counted else SCHEMA

    def meeting(qids: np.ndarray, q: np.ndarray, chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        return _count(qids, q, chunks, distance, radius, itself) if counted else _scan(qids, q, chunks, distance, k, radius, itself)

    def sent(df: DataFrame):
        """Ids and vectors in order of ids."""
        table = df.select("id", "v").toArrow()
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        x = matrix(table["v"].combine_chunks(), dim)[order] if len(order) else np.zeros((0, dim))
        return spark.sparkContext.broadcast((table["id"].to_numpy()[order], _narrow(x, single)))

    def pieces(ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        return ((ids[a : a + READY], _wide(x[a : a + READY])) for a in range(0, len(ids), READY)) if single else iter([(ids, x)])

    if n > DEALT and dim > FLAT and 0 < points * width <= BROADCAST_BYTES:
        shared = sent(base)

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield from meeting(b.column(0).to_numpy(), matrix(b.column(1), dim), pieces(*shared.value))

        return queries.select("id", "v").repartition(min(tasks, -(-n // 512)), "id").mapInArrow(look, schema)
    if n * width <= BROADCAST_BYTES:
        shared = sent(queries)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            yield from meeting(ids, _wide(q), ((b.column(0).to_numpy(), matrix(b.column(1), dim)) for b in batches if b.num_rows))

        rows = base.select("id", "v")
        return (rows.repartition(tasks, "id") if n > DEALT and dim > FLAT else rows).mapInArrow(scan, schema)

    # a block of points is larger than one of queries: every query keeps its k best per block of points. Each side is shuffled once, and
    # tasks read the two blocks that they bring together
    tiles = max(1, -(-points * width // (BROADCAST_BYTES // 2)))
    blocks = max(-(-n * width // (BROADCAST_BYTES // 4)), -(-tasks // tiles))

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows of a task as one."""
        held = [(b.column(0).to_numpy(), _narrow(matrix(b.column(1), dim), single)) for b in batches if b.num_rows]
        if held:
            ids, x = (np.concatenate(part) for part in zip(*held, strict=True))
            yield pa.record_batch([pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.uint8 if bytes_ else np.float32 if single else np.float64
        for b in batches:
            for i in range(b.num_rows):
                qids, q, ids, x = (np.frombuffer(b.column(c)[i].as_buffer(), kind if c % 2 else np.int64) for c in range(4))
                q, x = q.reshape(len(qids), dim), x.reshape(len(ids), dim)
                yield from meeting(qids, _wide(q), pieces(ids, x))

    left = queries.select("id", "v").repartition(blocks, "id").mapInArrow(block, "qids binary, q binary")
    right = base.select("id", "v").repartition(tiles, "id").mapInArrow(block, "ids binary, x binary")
    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(pair, schema)


def _narrow(x: np.ndarray, single: bool) -> np.ndarray:
    return x.astype(np.float32) if single else x


def _wide(x: np.ndarray) -> np.ndarray:
    """Floats as doubles."""
    return x.astype(np.float64) if x.dtype == np.float32 else x


def _slim(x: np.ndarray) -> np.ndarray:
    """In single precision where nothing is lost."""
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return y if (y == x).all() else x


def by_all_points(queries: DataFrame, base: DataFrame, n: int, points: int, dim: int, answer, schema: str, along: int | None = None) -> DataFrame:
    """answer(parts of the base, ids, vectors) of the queries of each task, in order of their ids; those of one id share a task.

    A part of the base is (its columns but the last, as arrays; vectors). Up to BROADCAST_BYTES the base is sent, up to WHOLE_BYTES it is
    shuffled once into tiles, and every group of queries reads them all: neither copies of it nor what is found are written.
    along: a component whose neighbours share a task.
    """
    spark, width = base.sparkSession, 8 * (dim + 1)
    groups = max(TASKS * spark.sparkContext.defaultParallelism, -(-n * width // GROUP_BYTES))
    part = lambda b: (*(b.column(i).to_numpy() for i in range(b.num_columns - 1)), _slim(matrix(b.column(b.num_columns - 1), dim)))
    queries = queries.select("id", "v")
    if along is None:
        dealt = queries.repartition(groups, "id")
    else:
        place = queries.groupBy("id").agg(F.min(F.get("v", F.lit(along))).alias("place"))
        dealt = queries.join(place, "id", "left").repartitionByRange(groups, "place", "id").select("id", "v")

    def of(ids: np.ndarray, vectors: np.ndarray, parts: list) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids, kind="stable")
        yield from answer(parts, ids[order], vectors[order])

    if points * width <= BROADCAST_BYTES:
        shared = spark.sparkContext.broadcast([part(b) for b in base.toArrow().to_batches() if b.num_rows])

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [(b.column(0).to_numpy(), matrix(b.column(1), dim)) for b in batches if b.num_rows]
            if held:
                yield from of(*(np.concatenate(c) for c in zip(*held, strict=True)), shared.value)

        return dealt.mapInArrow(look, schema)

    def block(names: list[str]):
        """All rows of a task as one: a column of bytes each, the last one the vectors, and whether they are in single precision."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [part(b) for b in batches if b.num_rows]
            if held:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                yield pa.record_batch([*(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([columns[-1].dtype == np.float32])], names=names)

        return run

    def opened(b: pa.RecordBatch, i: int, first: int, last: int) -> tuple:
        """A block's columns, copied: what they came in is let go."""
        kind = np.float32 if b.column(last)[i].as_py() else np.float64
        columns = [np.frombuffer(b.column(c)[i].as_buffer(), np.int64).copy() for c in range(first, last - 1)]
        return (*columns, np.frombuffer(b.column(last - 1)[i].as_buffer(), kind).reshape(-1, dim).copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per tile, each with the one block of queries."""
        mine, parts = None, []
        for b in batches:
            for i in range(b.num_rows):
                mine = mine or opened(b, i, 0, 2)
                parts.append(opened(b, i, 3, b.num_columns - 1))
        if mine:
            yield from of(mine[0], _wide(mine[1]), parts)

    shape = lambda names: ", ".join(f"{c} binary" for c in names[:-1]) + f", {names[-1]} boolean"
    asks, tells = ["qids", "q", "q_single"], [*(f"b{i}" for i in range(len(base.columns))), "b_single"]
    left = dealt.mapInArrow(block(asks), shape(asks))
    right = base.repartition(max(1, -(-points * width // TILE_BYTES)), "id").mapInArrow(block(tells), shape(tells)).coalesce(1)  # read by every task, not by one for all
    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, schema)


def ranks_within(ids: np.ndarray, find, most: int = RANKED) -> Iterator[pa.RecordBatch]:
    """(qid, rank, id, dist) of all that find(a, z), batches of (qid, id, dist), finds for the queries a to z, whose ids are in order.

    most: found pairs that are ranked at a time, about."""
    a, rows = 0, 64
    while a < len(ids):
        z = int(np.searchsorted(ids, ids[min(a + rows, len(ids)) - 1], side="right"))  # an id's queries are ranked together
        got = [b for b in find(a, z) if b.num_rows]
        if got:
            qid, who, dist = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in range(3))
            order = np.lexsort((who, dist, qid))
            qid = qid[order]
            first = np.concatenate(([0], np.flatnonzero(qid[1:] != qid[:-1]) + 1))
            rank = np.arange(len(qid)) - np.repeat(first, np.diff(np.append(first, len(qid)))) + 1
            out = pa.record_batch([pa.array(qid), pa.array(rank.astype(np.int32)), pa.array(who[order]), pa.array(dist[order])], names=["qid", "rank", "id", "dist"])
            yield from (out.slice(s, PAIRS << 7) for s in range(0, out.num_rows, PAIRS << 7))
        rows = int(np.clip(most * (z - a) // (1 + sum(b.num_rows for b in got)), 16, 2048))
        a = z


def _radius_ranked(queries: DataFrame, base: DataFrame, distance, radius: float, itself: bool) -> DataFrame | None:
    """All within the radius, ranked by the tasks that find them; None where points are too many, or too few for it to matter."""
    if is_binary(queries) or is_binary(base):
        return None
    n, dim = profile(queries)
    if n <= DEALT or dim <= FLAT:
        return None
    points = base.count()
    if not 0 < points * 8 * (dim + 1) <= WHOLE_BYTES:
        return None

    def answer(parts: list, ids: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
        chunks = lambda: ((i, np.asarray(x, np.float64)) for i, x in parts)
        yield from ranks_within(ids, lambda a, z: _scan(ids[a:z], q[a:z], chunks(), distance, None, radius, itself))

    return by_all_points(queries, base.select("id", "v"), n, points, dim, answer, RANKS)


def _expressed(queries: DataFrame, base: DataFrame, distance, itself: bool, dim: int) -> DataFrame:
    d = distances.get(distance)
    few = F.broadcast(queries.select(F.col("id").alias("qid"), F.col("v").alias("q")))  # at most FEW_QUERIES rows, which the caller has counted
    pairs = base.select("id", checked(F.col("v"), dim or None).alias("v")).join(few, F.lit(True) if itself else F.col("id") != F.col("qid"))
    out = pairs.select("qid", "id", d.expression(F.col("q"), F.col("v"), dim if 0 < dim <= 128 else None).alias("dist"))
    return out.where(~F.isnan("dist"))


def _candidates(queries: DataFrame, base: DataFrame, distance, k, radius, itself: bool, method: str, counted: bool = False) -> DataFrame:
    if method not in ("auto", "expression", "blocks"):
        raise ValueError(f"no method {method!r}")
    n, dim = profile(queries)
    bytes_ = is_binary(queries)
    if bytes_ != is_binary(base):
        raise VectorError("byte vectors are compared with byte vectors only")
    if bytes_:
        distance = packed(distance)
    if method != "blocks" and n <= FEW_QUERIES and not bytes_:  # more of them are never sent to a nested-loop join
        out = _expressed(queries, base, distance, itself, dim)
        out = out.where(F.col("dist") < radius) if radius is not None else out
        return out.groupBy("qid").agg(F.count("*").alias("n")) if counted else out
    return _pairs(queries, base, distance, k, radius, itself, n, dim, counted)


def ranked(pairs: DataFrame, k: int | None, skip: int = 0) -> DataFrame:
    """(qid, rank, id, dist) of pairs (qid, id, dist), ranks from 1 after skipped ones."""
    order = Window.partitionBy("qid").orderBy("dist", "id")
    out = pairs.withColumn("rank", F.row_number().over(order))
    if k is not None:
        out = out.where(F.col("rank") <= k + skip)
    if skip:
        out = out.where(F.col("rank") > skip).withColumn("rank", F.col("rank") - skip)
    return out.select("qid", "rank", "id", "dist")


def knn_join(queries: DataFrame, base: DataFrame, k: int, distance="l2", skip: int = 0, itself: bool = True, method: str = "auto") -> DataFrame:
    """The k nearest base vectors of every query: (qid, rank, id, dist). Both tables are (id, v).

    skip leaves the nearest ones out (ground truth without the query itself); itself=False never pairs equal ids.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    return ranked(_candidates(queries, base, distance, k + skip, None, itself, method), k, skip)


def knn_single(base: DataFrame, query: list[float], k: int, distance="l2") -> DataFrame:
    """The k nearest base vectors of one query: (rank, id, dist)."""
    d = distances.get(distance)
    q = F.array(*[F.lit(float(x)) for x in query])
    dist = d.expression(q, checked(F.col("v"), len(query)), len(query) if len(query) <= 128 else None)
    near = base.select("id", dist.alias("dist")).where(~F.isnan("dist")).orderBy("dist", "id").limit(k)
    return near.select(F.row_number().over(Window.orderBy("dist", "id")).alias("rank"), "id", "dist")  # over k rows


def nested(neighbours: DataFrame) -> DataFrame:
    """(qid, neighbours): a list of (dist, id) per query instead of a row each."""
    return neighbours.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("dist", "id"))).alias("neighbours"))


def radius_join(queries: DataFrame, base: DataFrame, radius: float, distance="l2", max_neighbours: int = -1, itself: bool = True, method: str = "auto") -> DataFrame:
    """Base vectors nearer than radius (strictly, in the distance's own unit: squared for l2): (qid, rank, id, dist).

    max_neighbours: the nearest so many, all below 0, none at 0 (use radius_count for their number).
    """
    cap = None if max_neighbours < 0 else max_neighbours
    if cap is None and method == "auto" and (out := _radius_ranked(queries, base, distance, radius, itself)) is not None:
        return out
    pairs = _candidates(queries, base, distance, None if cap is None else max(cap, 1), radius, itself, method)
    out = ranked(pairs, cap)
    return out.where("false") if cap == 0 else out


def within(queries: DataFrame, base: DataFrame, radius: float, distance="l2", itself: bool = True, method: str = "auto") -> DataFrame:
    """(qid, n): how many base vectors are nearer than radius, for queries that have some; those of one id are counted together.

    Tasks count what they find, and only their counts are shuffled."""
    return _candidates(queries, base, distance, None, radius, itself, method, True).groupBy("qid").agg(F.sum("n").alias("n"))


def radius_count(queries: DataFrame, base: DataFrame, radius: float, distance="l2", itself: bool = True, method: str = "auto") -> DataFrame:
    """(qid, n): how many base vectors are nearer than radius, zeros included."""
    found = within(queries, base, radius, distance, itself, method)
    return queries.select(F.col("id").alias("qid")).join(found, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sharded_radius(queries: DataFrame, shards: list[DataFrame], radius: float, distance="l2", max_neighbours: int = -1, itself: bool = True) -> DataFrame:
    """Search every shard by itself and merge: (qid, rank, id, dist), the nearest max_neighbours of all shards together."""
    parts = [radius_join(queries, s, radius, distance, max_neighbours, itself).select("qid", "id", "dist") for s in shards]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out, None if max_neighbours < 0 else max_neighbours)


def sharded_knn(queries: DataFrame, shards: list[DataFrame], k: int, distance="l2") -> DataFrame:
    """Search every shard by itself and merge the sorted lists: (qid, rank, id, dist)."""
    parts = [knn_join(queries, s, k, distance).select("qid", "id", "dist") for s in shards]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ranked(out, k)
