"""Distance functions in three equivalent forms: Column expressions, numpy blocks and DuckDB SQL.

All add their terms from the first component to the last in double precision, so the three forms agree to the last bit wherever no power,
root or logarithm is involved. Squared distances stay squared and Minkowski sums keep no root.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


SIDE = 512  # pairs whose terms are held at a time: they stay in a core's cache


@dataclass(frozen=True)
class Distance:
    """term(x, y) of one component in each form; fold is `sum` or `max`. splits: usable with axis-aligned cells; metric_space: with centres."""

    name: str
    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray]
    sql: str
    fold: str = "sum"
    splits: bool = True
    metric_space: bool = True
    first: int | None = None  # only so many components count
    binary: bool = False  # over packed bits (longs)
    positive: bool = False  # defined for components of 0 and more only: a search with others raises an error

    def expression(self, a: Column, b: Column, dim: int | None = None) -> Column:
        """Of two array columns. With dim the terms are written out one by one, which stays within code generation."""
        if dim is None:
            if self.first:
                a, b = F.slice(a, 1, self.first), F.slice(b, 1, self.first)
            terms = F.zip_with(a, b, self.column)
            if self.fold == "max":
                return F.array_max(terms)
            return F.aggregate(terms, F.lit(0).cast("double"), lambda s, t: s + t)
        terms = [self.column(a[i], b[i]) for i in range(min(dim, self.first or dim))]
        if self.fold == "max":
            return F.greatest(*terms) if len(terms) > 1 else terms[0]
        out = F.lit(0.0) + terms[0]
        for t in terms[1:]:
            out = out + t
        return out

    def matrix(self, q: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of all rows of q to all rows of b, adding a component at a time."""
        if self.positive and (min(q.min(initial=0), b.min(initial=0)) < 0):
            raise ValueError(f"{self.name} is defined for components of 0 and more")
        if self.block is _bits_block:
            return _bits_apart(q.astype(np.int64), b.astype(np.int64))
        out = np.zeros((len(q), len(b)))
        n = min(q.shape[1], self.first or q.shape[1])
        qt, bt = np.ascontiguousarray(q[:, :n].T), np.ascontiguousarray(b[:, :n].T)
        for x, y in zip(qt, bt, strict=True):
            term = self.block(x[:, None], y[None, :])
            if self.fold == "max":
                np.maximum(out, term, out=out)
            else:
                out += term
        return out

    def nearest(self, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """The number of the nearest centre of every row of x, ties to the first."""
        if of_differences(self):  # the same from either side, and quicker with the many rows inside
            return self.matrix(centres, x).argmin(axis=0)
        return self.matrix(x, centres).argmin(axis=1)

    def pairs(self, q: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of rows of q to the rows of b at the same places, adding a component at a time."""
        n = min(q.shape[1], self.first or q.shape[1])
        out = np.zeros(len(q))
        for s in range(0, len(q), SIDE):
            x, y, sums = q[s : s + SIDE, :n], b[s : s + SIDE, :n], out[s : s + SIDE]
            if len(x) < 8:  # a single column would be summed in another order
                for i in range(n):
                    term = self.block(x[:, i], y[:, i])
                    sums[:] = np.maximum(sums, term) if self.fold == "max" else sums + term
            elif n:
                terms = np.ascontiguousarray(self.block(x, y).T)
                sums += np.maximum.reduce(terms, axis=0) if self.fold == "max" else np.add.reduce(terms, axis=0)
        return out

    def bounds(self, q: np.ndarray, b: np.ndarray, rough: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """(a matrix of near values, an error (a row) that they don't exceed) where they cost less than the distances themselves.

        Squares and divergences come from products of matrices, other sums and maxima from single precision. rough: products in single
        precision and sums of differences of short integers, which cost least and have the larger errors. None: there are none.
        """
        if self.first or not len(q) or not len(b):
            return None
        if self.block is _root_block:
            if self.positive and min(q.min(), b.min()) < 0:
                raise ValueError(f"{self.name} is defined for components of 0 and more")
            return _squares_near(np.sqrt(q), np.sqrt(b), rough)
        if self.block is _square_block:
            return _squares_near(q, b, rough)
        if self.block is _ratio_block:
            return _divergence_near(q, b, rough)
        if self.block is _ratio_back_block:
            near = _divergence_near(b, q, rough)
            return None if near is None else (np.ascontiguousarray(near[0].T), np.full((1, len(b)), near[1].max()))
        if rough:
            return _short_near(q, b) if self.block is _difference_block and self.fold == "sum" else None
        return _single_near(self, q, b)

    def screen(self, q: np.ndarray, b: np.ndarray) -> Screen | None:
        """Both sides prepared once for rough near values of any block of their pairs (l1: values not above the distance); None: there are none."""
        if self.first or not len(q) or not len(b):
            return None
        if self.block is _square_block:
            return _squares_screen(q, b)
        if self.block is _root_block and min(q.min(), b.min()) >= 0:
            return _squares_screen(np.sqrt(q), np.sqrt(b))
        if self.block is _ratio_block:
            return _divergence_screen(q, b, False)
        if self.block is _ratio_back_block:
            return _divergence_screen(b, q, True)
        if self.block is _difference_block and self.fold == "sum" and len(q) >= FLOORED:
            return _floor_screen(q, b)
        if self.block is _chi_block and len(q) >= FLOORED:
            return _chi_screen(q, b)
        return None

    def duckdb(self, a: str, b: str) -> str:
        """The same over two DOUBLE[] (BIGINT[] for packed bits) expressions."""
        if self.first:
            a, b = f"({a})[1:{self.first}]", f"({b})[1:{self.first}]"
        terms = f"list_transform(list_zip({a}, {b}), lambda t: {self.sql.format(x='t[1]', y='t[2]')})"
        return f"list_{self.fold}({terms})"


def _power(x, p: int):
    out = x
    for _ in range(p - 1):
        out = out * x
    return out


@dataclass(frozen=True)
class _PowerBlock:
    """|x - y| to the power p."""

    p: int

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return _power(np.abs(x - y), self.p)


def minkowski(p: int) -> Distance:
    """Sum of |x - y| to the power p, without the root."""
    if p < 1:
        raise ValueError("the order is at least 1")
    sql = "*".join(["abs({x}-{y})"] * p)
    return Distance(f"minkowski{p}", lambda x, y: _power(F.abs(x - y), p), _PowerBlock(p), sql)


def _ratio_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((x != 0) & (y != 0) & (x / y > 0), x * np.log(x / y), 0.0)


def _ratio_back_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _ratio_block(y, x)


def _difference_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.abs(x - y)


def _root_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return _square(np.sqrt(x), np.sqrt(y))


def _chi_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(x + y > 0, (x - y) * (x - y) / (x + y), 0.0)


def _square(x, y):
    return (x - y) * (x - y)


def _root(x: Column) -> Column:
    return F.when(x < 0, F.raise_error(F.lit("hellinger is defined for components of 0 and more")).cast("double")).otherwise(F.sqrt(x))


def _square_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    t = x - y
    with np.errstate(over="ignore"):
        return t * t


def _bits_block(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.astype(np.int64) ^ y.astype(np.int64)).astype(np.float64)


def _bits_apart(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of all rows of longs: places of bytes that are 0 in every row are left out, the others lie eight to a word."""
    x, y = (np.ascontiguousarray(v).view(np.uint8) for v in (q, b))
    keep = np.flatnonzero(x.any(axis=0) | y.any(axis=0)) if len(x) and len(y) else []
    words = -(-len(keep) // 8)
    x, y = (np.ascontiguousarray(np.pad(v[:, keep], ((0, 0), (0, 8 * words - len(keep))))).view(np.uint64) for v in (x, y))
    out = np.zeros((len(q), len(b)))
    for i in range(words):
        out += np.bitwise_count(x[:, i, None] ^ y[None, :, i])
    return out


def _squares_near(q: np.ndarray, b: np.ndarray, rough: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
    with np.errstate(over="ignore", invalid="ignore"):
        qn, bn = (q * q).sum(axis=1), (b * b).sum(axis=1)
        if rough:
            if not qn.max() + bn.max() < 1e30:
                return None
            one = lambda v: np.ones((len(v), 1))
            near = np.hstack((-2.0 * q, qn[:, None], one(q))).astype(np.float32) @ np.hstack((b, one(b), bn[:, None])).astype(np.float32).T
            return near, ((4 * q.shape[1] + 32) * 2.0**-23 * (qn.max() + bn) + 1e-30)[None, :]
        near = (-2.0 * q) @ b.T
        near += qn[:, None]
        near += bn[None, :]
        error = (4 * q.shape[1] + 32) * 2.0**-52 * (qn.max(initial=0) + bn)[None, :]
    return (near, error) if np.isfinite(near).all() else None


def _divergence_near(x: np.ndarray, y: np.ndarray, rough: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
    """Of sums of x ln(x / y) = x ln x - x ln y over components where neither is 0, x by rows: error has a value per row of y, all equal."""
    values = np.concatenate((x.ravel(), y.ravel()))
    some = values[values != 0]
    if values.min() < 0 or len(some) and not 1e-100 < some.min() <= some.max() < 1e100:  # quotients of others may not be normal numbers
        return None
    with np.errstate(divide="ignore"):
        xl, yl = (np.where(v > 0, np.log(np.where(v > 0, v, 1.0)), 0.0) for v in (x, y))
    most = 1 + max(np.abs(xl).max(), np.abs(yl).max())
    largest = most * x.sum(axis=1).max()
    if rough:
        if not largest < 1e30:
            return None
        some = (x * xl).sum(axis=1, keepdims=True) if (y > 0).all() else x * xl
        left, right = np.hstack((some, -x)), np.hstack(((y > 0)[:, : some.shape[1]], yl))
        return left.astype(np.float32) @ right.astype(np.float32).T, np.full((1, len(y)), (2 * x.shape[1] + 16) * 2.0**-22 * largest + 1e-30)
    near = (x * xl) @ (y > 0).astype(np.float64).T - x @ yl.T
    return near, np.full((1, len(y)), (4 * x.shape[1] + 32) * 2.0**-51 * largest)


NEAR_CELLS = 1 << 15  # values of single precision at a time: they stay in a core's cache


def _single_near(d: Distance, q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Of sums or maxima of |x - y|, its powers, the lesser and chi-square terms, in single precision."""
    kind, top, dims = d.block, max(np.abs(q).max(), np.abs(b).max()), q.shape[1]
    power = kind.p if isinstance(kind, _PowerBlock) else 1
    if not (kind in (_difference_block, np.minimum, _chi_block) or isinstance(kind, _PowerBlock)) or power > 4 or top > 1e6:
        return None
    if kind is _chi_block and min(q.min(), b.min()) < 0:
        return None
    # an operation is off by a part of 2**-24; terms are at most 2**(p - 1) * (|x|**p + |y|**p)
    size = lambda v: (np.abs(v) ** power).sum(axis=1)
    error = (2 * dims + 32 * power) * 2.0**-23 * 2 ** (power - 1) * (size(q).max() + size(b))[None, :] + dims * 1e-30
    qs, bs = (np.ascontiguousarray(v.T, np.float32) for v in (q, b))
    out = np.zeros((len(q), len(b)), np.float32)
    rows = max(1, NEAR_CELLS // len(b))
    t, u = np.empty((rows, len(b)), np.float32), np.empty((rows, len(b)), np.float32)
    tiny = np.float32(1e-35)  # 0 / 0 is 0
    for a in range(0, len(q), rows):
        sums = out[a : a + rows]
        t, u = t[: len(sums)], u[: len(sums)]
        for x, y in zip(qs[:, a : a + rows, None], bs[:, None, :], strict=True):
            if kind is np.minimum:
                np.minimum(x, y, out=t)
            else:
                np.subtract(x, y, out=t)
            if kind is _chi_block:
                np.add(x + tiny, y, out=u)
                np.multiply(t, t, out=t)
                np.divide(t, u, out=t)
            elif kind is not np.minimum:
                np.abs(t, out=t)
                if power > 1:
                    np.copyto(u, t)
                    for _ in range(power - 1):
                        np.multiply(u, t, out=u)
            term = u if power > 1 else t
            if d.fold == "max":
                np.maximum(sums, term, out=sums)
            else:
                np.add(sums, term, out=sums)
    return out, error


SHORT_CELLS = 1 << 16  # sums of short integers at a time


def _short_near(q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Of sums of |x - y| = 2 max(x, y) - x - y, over components rounded to steps that let a sum of maxima fit 16 bits."""
    low = np.minimum(q.min(axis=0), b.min(axis=0))
    with np.errstate(over="ignore"):
        extent, dims = float((np.maximum(q.max(axis=0), b.max(axis=0)) - low).sum()), q.shape[1]
    if not 1e-30 < extent < 1e30 or dims > 1 << 13 or max(np.abs(q).max(), np.abs(b).max()) > 1e8 * extent:
        return None
    step = extent / (65_535 - 2 * dims)
    qs, bs = (np.ascontiguousarray(np.rint((v - low) / step).T.astype(np.uint16)) for v in (q, b))
    most = np.zeros((len(q), len(b)), np.uint16)
    rows = max(1, SHORT_CELLS // len(b))
    t = np.empty((rows, len(b)), np.uint16)
    for a in range(0, len(q), rows):
        sums = most[a : a + rows]
        t = t[: len(sums)]
        for x, y in zip(qs[:, a : a + rows, None], bs[:, None, :], strict=True):
            np.maximum(x, y, out=t)
            np.add(sums, t, out=sums)
    near = most.astype(np.float32)  # whole numbers below 2**18 up to the last line
    near *= 2
    near -= qs.sum(axis=0, dtype=np.float32)[:, None]
    near -= bs.sum(axis=0, dtype=np.float32)[None, :]
    near *= np.float32(step)
    return near, np.full((1, len(b)), step * (1.01 * dims + 0.1))  # both sides are off by half a step a component


@dataclass(frozen=True)
class Screen:
    """Near values of all pairs as a product of matrices in single precision. A pair's error is below factor * (its two sizes) + least.

    floor: the values are lower bounds of the distances, but for that error, and say nothing of how far above them a distance lies.
    """

    left: np.ndarray  # a row per query
    right: np.ndarray  # a column per point
    size_q: np.ndarray
    size_b: np.ndarray
    factor: float
    least: float
    floor: bool = False

    def near(self, rows: slice, columns: slice, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(near values, their error) of a block, written into held."""
        left, right = self.left[rows], self.right[:, columns]
        out = held[: len(left) * right.shape[1]].reshape(len(left), right.shape[1])
        np.matmul(left, right, out=out)
        return out, np.array([[self.factor * (self.size_q[rows].max() + self.size_b[columns].max()) + self.least]])


def _product(left: list[np.ndarray], right: list[np.ndarray], *rest) -> Screen:
    return Screen(np.hstack(left).astype(np.float32), np.ascontiguousarray(np.hstack(right).astype(np.float32).T), *rest)


def _ones(v: np.ndarray) -> np.ndarray:
    return np.ones((len(v), 1))


def _squares_screen(q: np.ndarray, b: np.ndarray) -> Screen | None:
    with np.errstate(over="ignore"):
        qn, bn = (q * q).sum(axis=1), (b * b).sum(axis=1)
    if not qn.max() + bn.max() < 1e30:
        return None
    return _product([-2.0 * q, qn[:, None], _ones(q)], [b, _ones(b), bn[:, None]], qn, bn, (4 * q.shape[1] + 32) * 2.0**-23, 1e-30)


def _divergence_screen(x: np.ndarray, y: np.ndarray, back: bool) -> Screen | None:
    """Of sums of x ln(x / y), as _divergence_near; back: y has the queries."""
    low, high = min(x.min(), y.min()), max(x.max(), y.max())
    least = min(v.min(where=v > 0, initial=np.inf) for v in (x, y))
    if low < 0 or high > 0 and not 1e-100 < least <= high < 1e100:
        return None
    xl, yl = (np.log(v, out=np.zeros_like(v), where=v > 0) for v in (x, y))
    largest = (1 + max(np.abs(xl).max(), np.abs(yl).max())) * x.sum(axis=1)
    if not largest.max() < 1e30:
        return None
    some = (x * xl).sum(axis=1, keepdims=True) if (y > 0).all() else x * xl
    mine, theirs = [some, -x], [(y > 0)[:, : some.shape[1]], yl]
    factor = (2 * x.shape[1] + 16) * 2.0**-22
    return _product(theirs, mine, np.zeros(len(y)), largest, factor, 1e-30) if back else _product(mine, theirs, largest, np.zeros(len(y)), factor, 1e-30)


FLOORED = 256  # queries from which lower bounds of l1 are prepared
PARTS = 6  # of every axis


def _floor_screen(q: np.ndarray, b: np.ndarray) -> Screen | None:
    """Of sums of |x - y|. An axis is cut into parts; |x - y| is the sum of what lies in each, and there |s - t| >= (sqrt s - sqrt t)**2, which
    is s + t - 2 sqrt(s) sqrt(t): a product. Outer parts are measured from their inner ends. Parts that lie between x and y count in full.
    """
    top = max(np.abs(q).max(), np.abs(b).max())
    if not top < 1e30:
        return None
    cuts = np.quantile(b[:: max(1, len(b) // 1024)], np.arange(1, PARTS) / PARTS, axis=0)

    def inside(v: np.ndarray) -> np.ndarray:
        down = [cuts[j] - np.clip(v, cuts[j - 1] if j else None, cuts[j]) for j in range(PARTS // 2)]
        up = [np.clip(v, cuts[j - 1], cuts[j] if j < PARTS - 1 else None) - cuts[j - 1] for j in range(PARTS // 2, PARTS)]
        return np.hstack(down + up)

    qs, bs = inside(q), inside(b)
    qn, bn = qs.sum(axis=1), bs.sum(axis=1)
    terms = qs.shape[1]
    least = 1e-30 + 8 * terms * 2.0**-52 * top  # differences from a cut are off by a part of the component itself
    return _product([-2.0 * np.sqrt(qs), qn[:, None], _ones(qs)], [np.sqrt(bs), _ones(bs), bn[:, None]], qn, bn, (2 * terms + 32) * 2.0**-23, least, True)


WAVES = 2  # of a component's logarithm
PERIOD = 12.0  # of the slowest


def _chi_screen(q: np.ndarray, b: np.ndarray) -> Screen | None:
    """Of sums of (x - y)**2 / (x + y) = x + y - 2 sqrt(x y) / cosh(t / 2), t = ln x - ln y.

    1 / cosh is its Fourier integral, and its copies a period apart are the series c0 + 2 sum of cj cos(j w t): as none is negative the series
    isn't below it, nor are its first terms and the sum of the other coefficients. A cosine of a difference is a sum of two products.
    """
    if not min(q.min(), b.min()) >= 0 or not max(q.max(), b.max()) < 1e30:
        return None
    w = 2 * np.pi / PERIOD
    c = w / np.cosh(np.pi * w * np.arange(64))
    first = c[0] + 2 * c[WAVES + 1 :].sum()

    def waves(v: np.ndarray, scale: float) -> list[np.ndarray]:
        size, turn = scale * np.sqrt(v), w * np.log(v, out=np.zeros_like(v), where=v > 0)
        out = [(size * np.sqrt(first)).astype(np.float32)]
        for j in range(1, WAVES + 1):
            out += [(size * np.sqrt(2 * c[j]) * f(j * turn)).astype(np.float32) for f in (np.cos, np.sin)]
        return out

    qn, bn = q.sum(axis=1), b.sum(axis=1)
    one, terms = lambda v: np.ones((len(v), 1), np.float32), (2 * WAVES + 1) * q.shape[1]
    left, right = [*waves(q, -2.0), qn[:, None].astype(np.float32), one(q)], [*waves(b, 1.0), one(b), bn[:, None].astype(np.float32)]
    return _product(left, right, qn, bn, (2 * terms + 32) * 2.0**-22, 1e-30, True)


def of_differences(d: Distance) -> bool:
    """Do terms grow with the difference of two components, and hang on nothing else?"""
    return d.block in (_square_block, _difference_block) or isinstance(d.block, _PowerBlock)


_SQUARE = "({x}-{y})*({x}-{y})"
_HAMMING = {"column": lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("double"), "block": _bits_block, "sql": "bit_count(xor({x}, {y}))::DOUBLE", "splits": False, "metric_space": False, "binary": True}

DISTANCES: dict[str, Distance] = {
    d.name: d
    for d in (
        Distance("l2", _square, _square_block, _SQUARE),
        Distance("l2_simple", _square, _square_block, _SQUARE),
        Distance("l2_3d", _square, _square_block, _SQUARE, first=3),
        Distance("l1", lambda x, y: F.abs(x - y), _difference_block, "abs({x}-{y})"),
        minkowski(3),
        Distance("max", lambda x, y: F.abs(x - y), _difference_block, "abs({x}-{y})", fold="max", splits=False),
        # a similarity that is minimised as if it were a distance: kept as users of the measure know it
        Distance("hist_intersect", lambda x, y: F.least(x, y), np.minimum, "least({x},{y})", metric_space=False),
        Distance("hellinger", lambda x, y: _square(_root(x), _root(y)), _root_block, "(sqrt({x})-sqrt({y}))*(sqrt({x})-sqrt({y}))", positive=True),
        Distance("chi_square", lambda x, y: F.when(x + y > 0, _square(x, y) / (x + y)).otherwise(0.0), _chi_block, "CASE WHEN {x}+{y}>0 THEN ({x}-{y})*({x}-{y})/({x}+{y}) ELSE 0 END"),
        # of the point (second) from the query (first): D(point || query)
        Distance(
            "kullback_leibler",
            lambda x, y: F.when((y != 0) & (x != 0) & (F.try_divide(y, x) > 0), y * F.ln(F.try_divide(y, x))).otherwise(0.0),
            _ratio_back_block,
            "CASE WHEN {y}<>0 AND {x}<>0 AND {y}/{x}>0 THEN {y}*ln({y}/{x}) ELSE 0 END",
            metric_space=False,
        ),
        # the other way round: D(query || point)
        Distance(
            "kullback_leibler_query",
            lambda x, y: F.when((y != 0) & (x != 0) & (F.try_divide(x, y) > 0), x * F.ln(F.try_divide(x, y))).otherwise(0.0),
            _ratio_block,
            "CASE WHEN {y}<>0 AND {x}<>0 AND {x}/{y}>0 THEN {x}*ln({x}/{y}) ELSE 0 END",
            metric_space=False,
        ),
        Distance("hamming", **_HAMMING),
        Distance("hamming_lut", **_HAMMING),
        Distance("hamming_popcnt", **_HAMMING),
    )
}

#: The public numbers and further names of the distances.
NUMBERS = {1: "l2", 2: "l1", 3: "minkowski3", 4: "max", 5: "hist_intersect", 6: "hellinger", 7: "chi_square", 8: "kullback_leibler", 9: "hamming", 10: "hamming_lut", 11: "hamming_popcnt", 12: "l2_simple"}
ALIASES = {"euclidean": "l2", "squared_euclidean": "l2", "manhattan": "l1", "chebyshev": "max", "cs": "chi_square", "kl": "kullback_leibler", "kld": "kullback_leibler", "minkowski": "minkowski3"}


def get(distance: str | int | Distance) -> Distance:
    """A distance by name, alias, public number or itself (a user's own)."""
    if isinstance(distance, Distance):
        return distance
    name = NUMBERS.get(distance, "") if isinstance(distance, int) else distance.lower()
    name = ALIASES.get(name, name)
    if name.startswith("minkowski") and name[9:].isdigit():
        return minkowski(int(name[9:]))
    if name not in DISTANCES:
        raise ValueError(f"no distance {distance!r}")
    return DISTANCES[name]


#: What an index needs of a distance.
NEEDS = {"linear": None, "kdtree": "splits", "kdtree_single": "splits", "kdtree_cyclic": "splits", "kmeans": "metric_space", "composite": "splits", "hierarchical": None, "lsh": "binary", "autotuned": "splits"}


def check_combination(method: str, distance: str | int | Distance) -> None:
    d, need = get(distance), NEEDS[method]
    if need and not getattr(d, need):
        raise ValueError(f"unsupported combination of index {method} and distance {d.name}")


def squared(distance: str | int | Distance, value: Column) -> Column:
    """The distance squared, unless it is squared by itself already."""
    return value if get(distance).name in ("l2", "l2_simple", "l2_3d", "hellinger", "chi_square") else value * value


def ratio(found: Column, true: Column) -> Column:
    """found / true, 1 where both are 0."""
    return F.when((found == 0) & (true == 0), 1.0).otherwise(found / true)
