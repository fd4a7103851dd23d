"""Trees of an index as node arrays, and searches over them that look at some nodes only.

All trees of an index are one forest. A node has a geometry that holds every point below it: a box from the points' own extremes, or a ball
around a centre. Both give a lower bound of the distance of a query to anything in the node. Two searches use it, for many queries at once:
`best_first` takes the branch that looks nearest, over all trees, until enough points lie in the leaves met (its work grows with the budget,
not with the number of leaves); `within` takes all leaves whose bound isn't beyond a distance, which makes searches exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ...functions.distances import Distance

SLACK = 1 - 1e-9  # bounds are computed in other steps than distances: they give way by more than any rounding
PAIRS = 1 << 14  # bounds computed at a time


def _chi_gap(q: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((q >= 0) & (y >= 0) & (q + y > 0), (q - y) ** 2 / (q + y), 0.0)


def box_bound(d: Distance, q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Lower bounds of the distances of rows of q to anything in the boxes at the same rows, one dimension at a time.

    Minus infinity (any box may hold the nearest) for distances without a bound of their own.
    """
    y = np.clip(q, low, high)  # the nearest value of a box where terms grow with the difference
    with np.errstate(over="ignore", invalid="ignore"):
        if d.name in ("l2", "l2_simple"):
            term = (q - y) ** 2
        elif d.name == "l2_3d":
            term = (q[:, :3] - y[:, :3]) ** 2
        elif d.name == "l1":
            term = np.abs(q - y)
        elif d.name == "max":
            return np.abs(q - y).max(axis=1) * SLACK
        elif d.name.startswith("minkowski"):
            term = np.abs(q - y) ** int(d.name[9:])
        elif d.name == "hellinger":
            term = (np.sqrt(np.maximum(q, 0)) - np.sqrt(np.maximum(y, 0))) ** 2
        elif d.name == "chi_square":  # negative components have no bound
            term = np.where(low >= 0, _chi_gap(q, y), 0.0)
        elif d.name == "hist_intersect":
            term = np.minimum(q, low)
            return term.sum(axis=1) - 1e-9 * np.abs(term).sum(axis=1)
        else:
            return np.full(len(q), -np.inf)
    return term.sum(axis=1) * SLACK


def has_box_bound(d: Distance) -> bool:
    return d.name in ("l2", "l2_simple", "l2_3d", "l1", "max", "hellinger", "chi_square", "hist_intersect") or d.name.startswith("minkowski")


def root(d: Distance, value: np.ndarray) -> np.ndarray | None:
    """A distance as one for which the triangle inequality holds; None where there is none."""
    if d.name in ("l2", "l2_simple", "l2_3d", "hellinger"):
        return np.sqrt(value)
    if d.name in ("l1", "max") or d.binary:
        return value
    if d.name.startswith("minkowski"):
        return value ** (1 / int(d.name[9:]))
    return None


def unroot(d: Distance, value: np.ndarray) -> np.ndarray:
    if d.name in ("l2", "l2_simple", "l2_3d", "hellinger"):
        return value * value
    if d.name.startswith("minkowski"):
        return value ** int(d.name[9:])
    return value


class Forest:
    """Node arrays: a node's children are numbered first to first + count - 1; its tree, depth and parent; its cell (leaves; -1 inside) and the
    points below it (held). Subclasses add a geometry."""

    #: name -> (value of a new node, does it have a component per dimension)
    fields: dict = {"first": (0, False), "count": (0, False), "tree": (0, False), "depth": (0, False), "parent": (-1, False), "cell": (-1, False), "held": (0, False)}

    def __init__(self, dims: int):
        self.dims = dims
        for name, (value, wide) in self.fields.items():
            setattr(self, name, np.zeros((0, dims) if wide else 0, type(value)))
        self.roots: list[int] = []
        self.cells: list[int] = []  # of each tree: the numbers given out so far

    def __len__(self) -> int:
        return len(self.first)

    def _append(self, n: int, given: dict) -> None:
        for name, (value, wide) in self.fields.items():
            new = given.get(name)
            if new is None:
                new = np.full((n, self.dims) if wide else n, value, type(value))
            setattr(self, name, np.concatenate((getattr(self, name), np.asarray(new, type(value)))))

    def plant(self, shape: Shape) -> None:
        """A further tree."""
        node = len(self)
        self._append(1, {"tree": [len(self.roots)], "cell": [0]})
        self.roots.append(node)
        self.cells.append(0)
        self.graft(node, shape, True)

    def graft(self, node: int, shape: Shape, fresh: bool = False) -> None:
        """A leaf becomes what shape describes; its cell is given up, and the new leaves get new ones in preorder. A leaf with points keeps its
        own centre, by which they got there."""
        tree, base = int(self.tree[node]), len(self) - 1  # node i > 0 of shape is number base + i
        n = len(shape.first)
        parent = np.where(np.array(shape.parent[1:]) == 0, node, base + np.array(shape.parent[1:])) if n > 1 else []
        own = {k: v for k, v in shape.geometry.items() if k in self.fields}
        first = np.where(np.array(shape.count) > 0, base + np.array(shape.first), 0)
        self._append(n - 1, {"first": first[1:], "count": shape.count[1:], "tree": np.full(n - 1, tree), "depth": np.array(shape.depth[1:]) + self.depth[node], "parent": parent} | {k: v[1:] for k, v in own.items()})
        self.first[node], self.count[node], self.cell[node] = first[0], shape.count[0], -1
        for k, v in own.items():
            if fresh or k not in ("centre", "variance"):
                getattr(self, k)[node] = v[0]
        leaves = np.where(np.array(shape.leaves) == 0, node, base + np.array(shape.leaves))
        self.cell[leaves] = np.arange(self.cells[tree], self.cells[tree] + len(leaves))
        self.cells[tree] += len(leaves)

    def leaves(self, tree: int | None = None) -> np.ndarray:
        at = self.cell >= 0
        return np.flatnonzero(at if tree is None else at & (self.tree == tree))

    def leaf_of(self) -> list[np.ndarray]:
        """For each tree the node of every cell number, -1 for numbers that have been given up."""
        out = [np.full(n, -1) for n in self.cells]
        for node in self.leaves().tolist():
            out[self.tree[node]][self.cell[node]] = node
        return out

    def descend(self, d: Distance, x: np.ndarray, tree: int) -> np.ndarray:
        """The leaf of every row of x."""
        raise NotImplementedError

    def upwards(self):
        """(parents, children) level by level from the deepest."""
        for depth in range(int(self.depth.max(initial=0)), 0, -1):
            at = np.flatnonzero(self.depth == depth)
            yield self.parent[at], at

    def total(self) -> None:
        """held of inner nodes from their leaves."""
        self.held[self.cell < 0] = 0
        for parents, at in self.upwards():
            np.add.at(self.held, parents, self.held[at])

    def order(self, d: Distance, q: np.ndarray, nodes: np.ndarray, cb: float) -> tuple[np.ndarray, np.ndarray]:
        """(what says which branch looks nearest, lower bounds), for rows of q and nodes at the same places."""
        raise NotImplementedError

    def _keys(self, d: Distance, q: np.ndarray, row: np.ndarray, node: np.ndarray, cb: float) -> np.ndarray:
        """What says which branch looks nearest, as finite numbers; infinite where a branch holds nothing."""
        key = np.nan_to_num(self._looked(d, q, row, node, cb)[0], nan=0.0, posinf=1e300, neginf=-1e300)
        key[self.held[node] == 0] = np.inf
        return key

    def _children(self, row: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.count[node]
        return np.repeat(row, n), np.repeat(self.first[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))

    def _looked(self, d: Distance, q: np.ndarray, row: np.ndarray, node: np.ndarray, cb: float) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.order(d, q[row[a : a + PAIRS]], node[a : a + PAIRS], cb) for a in range(0, len(row), PAIRS)]
        if not parts:
            return np.zeros(0), np.zeros(0)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def within(self, d: Distance, q: np.ndarray, worst: np.ndarray, eps: float = 0.0, tree: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves of a tree that may hold something not beyond worst; with eps, worst / (1 + eps)."""
        row, node = np.arange(len(q)), np.full(len(q), self.roots[tree])
        done = []
        while len(row):
            _, bound = self._looked(d, q, row, node, 0.0)
            near = (bound * (1 + eps) <= worst[row]) & (self.held[node] > 0)
            row, node = row[near], node[near]
            leaf = self.cell[node] >= 0
            done.append((row[leaf], node[leaf]))
            row, node = self._children(row[~leaf], node[~leaf])
        return np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])

    def best_first(self, d: Distance, q: np.ndarray, checks: float, cb: float = 0.0, trees: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): for every query the leaves of the branches that look nearest, until they hold `checks` points.

        A query's open branches are a heap in a row of a matrix, over all trees at once; no more are kept than there are points to check.
        """
        roots = [self.roots[t] for t in (range(len(self.roots)) if trees is None else trees)]
        limit = int(min(max(checks, 1) + len(roots), len(self)))
        keys = self._keys(d, q, np.repeat(np.arange(len(q)), len(roots)), np.tile(roots, len(q)), cb)
        heap, node = keys.reshape(len(q), len(roots)), np.tile(roots, (len(q), 1))
        met, live = np.zeros(len(q)), np.arange(len(q))  # live: the queries of the rows of heap
        used = np.full(len(q), len(roots))  # places of a row that have been given out
        done = []
        while True:
            best = heap.argmin(axis=1) if len(live) else np.zeros(0, np.int64)
            open_ = (met[live] < checks) & np.isfinite(heap[np.arange(len(live)), best])
            if not open_.all():
                heap, node, live, best, used = heap[open_], node[open_], live[open_], best[open_], used[open_]
            if not len(live):
                break
            lines = np.arange(len(live))
            at = node[lines, best]
            heap[lines, best] = np.inf
            leaf = self.cell[at] >= 0
            done.append((live[leaf], at[leaf]))
            met[live[leaf]] += self.held[at[leaf]]
            line, kid = self._children(lines[~leaf], at[~leaf])
            if not len(line):
                continue
            key = self._keys(d, q, live[line], kid, cb)
            # the first child takes its parent's place, the others new ones
            n = np.bincount(line, minlength=len(live))
            nth = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
            column = np.where(nth == 0, best[line], used[line] + nth - 1)
            used += np.maximum(n - 1, 0)
            width = int(used.max())
            if width > heap.shape[1]:
                more = max(width - heap.shape[1], heap.shape[1] // 2)
                heap = np.concatenate((heap, np.full((len(live), more), np.inf)), axis=1)
                node = np.concatenate((node, np.zeros((len(live), more), np.int64)), axis=1)
            heap[line, column], node[line, column] = key, kid
            if width > 2 * limit + 64:  # drop what has been taken and what no budget reaches
                keep = np.argpartition(heap, limit - 1, axis=1)[:, :limit]
                heap, node = np.take_along_axis(heap, keep, axis=1), np.take_along_axis(node, keep, axis=1)
                used[:] = limit
        return (np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def dump(self) -> dict:
        return {k: getattr(self, k).tolist() for k in self.fields} | {"dims": self.dims, "roots": self.roots, "cells": self.cells}

    @classmethod
    def load(cls, state: dict) -> Forest:
        out = cls(state["dims"])
        for name, (value, wide) in cls.fields.items():
            setattr(out, name, np.array(state[name], type(value)).reshape((-1, out.dims) if wide else -1))
        out.roots, out.cells = list(state["roots"]), list(state["cells"])
        return out


@dataclass
class Shape:
    """A tree by its nodes, the root first and children side by side: first child and number of children, parent, depth, leaves in preorder,
    and the geometry that the trainer knows."""

    first: list[int]
    count: list[int]
    parent: list[int]
    depth: list[int]
    leaves: list[int]
    geometry: dict[str, list]


def grow(x: np.ndarray, split, describe) -> Shape:
    """A tree over the rows of x: split(rows, leaves so far) gives (a list of disjoint row arrays, what describes each of them), or None at
    leaves; describe(rows) gives what describes a node where that says nothing."""
    out = Shape([0], [0], [-1], [0], [], {})
    notes: list[dict] = [{}]
    work = [(0, np.arange(len(x)))]
    while work:
        node, rows = work.pop()
        notes[node] = describe(rows) | notes[node]
        found = split(rows, len(out.leaves) + len(work))
        if found is None:
            out.leaves.append(node)
            continue
        parts, of = found
        out.first[node], out.count[node] = len(out.first), len(parts)
        kids = list(range(len(out.first), len(out.first) + len(parts)))
        for column, v in ((out.first, 0), (out.count, 0), (out.parent, node), (out.depth, out.depth[node] + 1)):
            column.extend([v] * len(parts))
        notes.extend(of)
        work.extend(reversed(list(zip(kids, parts, strict=True))))
    out.geometry = {k: [note[k] for note in notes] for k in notes[0]}
    return out


class Boxes(Forest):
    """k-d trees: inner nodes split at value of dim (below it goes left); every node has the box of its points."""

    fields = Forest.fields | {"split": (-1, False), "value": (0.0, False), "low": (np.inf, True), "high": (-np.inf, True)}

    def descend(self, d: Distance, x: np.ndarray, tree: int) -> np.ndarray:
        at = np.full(len(x), self.roots[tree])
        while (inner := self.split[at] >= 0).any():
            rows = np.flatnonzero(inner)
            here = at[rows]
            at[rows] = self.first[here] + (x[rows, self.split[here]] >= self.value[here])
        return at

    def widen(self, nodes: np.ndarray, held: np.ndarray, low: np.ndarray, high: np.ndarray, _radius: np.ndarray) -> None:
        """Leaves get further points: their number and extremes."""
        np.add.at(self.held, nodes, held)
        np.minimum.at(self.low, nodes, low)
        np.maximum.at(self.high, nodes, high)

    def settle(self, d: Distance) -> None:
        """Numbers and boxes of inner nodes from those below."""
        self.total()
        for parents, at in self.upwards():
            np.minimum.at(self.low, parents, self.low[at])
            np.maximum.at(self.high, parents, self.high[at])

    def order(self, d: Distance, q: np.ndarray, nodes: np.ndarray, cb: float) -> tuple[np.ndarray, np.ndarray]:
        bound = box_bound(d, q, self.low[nodes], self.high[nodes])
        return bound, bound


class Balls(Forest):
    """Trees of centres: a row goes to the child with the nearest centre; every node has the largest distance of its points to its centre."""

    fields = Forest.fields | {"centre": (0.0, True), "radius": (0.0, False), "variance": (0.0, False)}

    def descend(self, d: Distance, x: np.ndarray, tree: int) -> np.ndarray:
        """Level by level to the nearest child, ties to the first."""
        at = np.full(len(x), self.roots[tree])
        work = [np.arange(len(x))]
        while work:
            rows = work.pop()
            if not len(rows) or not self.count[at[rows[0]]]:
                continue
            here = at[rows[0]]
            kids = np.arange(self.first[here], self.first[here] + self.count[here])
            for a in range(0, len(rows), 4096):
                some = rows[a : a + 4096]
                at[some] = kids[d.nearest(x[some], self.centre[kids])]
            order = np.argsort(at[rows], kind="stable")
            work += np.split(rows[order], np.flatnonzero(np.diff(at[rows][order])) + 1)
        return at

    def widen(self, nodes: np.ndarray, held: np.ndarray, _low: np.ndarray, _high: np.ndarray, radius: np.ndarray) -> None:
        np.add.at(self.held, nodes, held)
        np.maximum.at(self.radius, nodes, radius)

    def settle(self, d: Distance) -> None:
        """Numbers and radii of inner nodes: no point is farther from a centre than a child's centre and that child's radius together."""
        self.total()
        self.radius[self.cell < 0] = 0
        for parents, at in self.upwards():
            some = self.held[at] > 0
            reach = root(d, d.pairs(self.centre[parents], self.centre[at]))
            if reach is not None:
                np.maximum.at(self.radius, parents[some], (reach + self.radius[at])[some])

    def order(self, d: Distance, q: np.ndarray, nodes: np.ndarray, cb: float) -> tuple[np.ndarray, np.ndarray]:
        dist = d.pairs(q, self.centre[nodes])
        far = root(d, dist)
        with np.errstate(invalid="ignore", over="ignore"):
            bound = np.full(len(q), -np.inf) if far is None else np.nan_to_num(unroot(d, np.maximum(far * SLACK - self.radius[nodes], 0.0)) * SLACK, nan=0.0, posinf=np.inf)
            return dist - cb * self.variance[nodes], bound
