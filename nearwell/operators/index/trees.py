"""k-d trees: a randomised forest and a single tree with boxes.

Trees are trained on a bounded sample with numpy and broadcast as node arrays; points and queries descend in vectorised batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import MAX_CELLS, register
from .cells import CellIndex
from .nodes import Boxes, Shape, has_box_bound

TOP_DIMENSIONS = 5
VARIANCE_SAMPLE = 100


class KdTree:
    """Node arrays: split dimension (-1 at leaves), value, children, and for leaves their cell number. Left is below the value."""

    def __init__(self, x: np.ndarray, leaf: float, rng: np.random.Generator | None = None, pivot: str = "median", choose: str = "variance", depth: int = 0, room: int = MAX_CELLS):
        self.dim, self.value, self.left, self.right, self.cell = [], [], [], [], []
        self.cells = 0
        rows = [np.arange(len(x))]
        work = [(self._new(), rows[0], depth)]
        while work:
            node, members, depth = work.pop()
            split = self._split(x[members], rng, pivot, choose, depth) if len(members) > max(1.0, leaf) and self.cells + len(work) < room - 2 else None
            if split is None:
                self.cell[node] = self.cells
                self.cells += 1
                continue
            d, v = split
            below = x[members, d] < v
            self.dim[node], self.value[node] = d, v
            self.left[node], self.right[node] = self._new(), self._new()
            work += [(self.right[node], members[~below], depth + 1), (self.left[node], members[below], depth + 1)]
        self._fix()

    def _new(self) -> int:
        for column, v in ((self.dim, -1), (self.value, 0.0), (self.left, -1), (self.right, -1), (self.cell, -1)):
            column.append(v)
        return len(self.dim) - 1

    def _fix(self) -> None:
        self.dim, self.left, self.right, self.cell = (np.array(a, np.int64) for a in (self.dim, self.left, self.right, self.cell))
        self.value = np.array(self.value, np.float64)

    @staticmethod
    def _split(x: np.ndarray, rng, pivot: str, choose: str, depth: int) -> tuple[int, float] | None:
        if choose == "cyclic":
            order = [(depth + i) % x.shape[1] for i in range(x.shape[1])]
        elif choose == "span":
            order = np.argsort(-(x.max(axis=0) - x.min(axis=0)), kind="stable").tolist()
        else:
            some = x if rng is None else x[rng.permutation(len(x))[:VARIANCE_SAMPLE]]
            order = np.argsort(-some.var(axis=0), kind="stable").tolist()
            if rng is not None:
                top = order[: max(1, min(TOP_DIMENSIONS, len(order)))]
                order = [top[int(rng.integers(len(top)))], *order]
        for d in order:
            column = x[:, d]
            low, high = column.min(), column.max()
            if low == high:
                continue
            v = {"median": np.median, "mean": np.mean, "middle": lambda c: (c.min() + c.max()) / 2}[pivot](column)
            return d, float(v) if low < v <= high else float(high)
        return None

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The cell of every row."""
        at = np.zeros(len(x), np.int64)
        while (inner := self.dim[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, self.dim[node]] < self.value[node], self.left[node], self.right[node])
        return self.cell[at]

    def shape(self) -> Shape:
        """The same as a shape to plant or graft."""
        n, inner = len(self.dim), np.flatnonzero(self.dim >= 0)
        parent, depth = np.full(n, -1), np.zeros(n, np.int64)
        parent[self.left[inner]] = parent[self.right[inner]] = inner
        for i in range(1, n):  # parents come first
            depth[i] = depth[parent[i]] + 1
        leaves = np.flatnonzero(self.cell >= 0)
        return Shape(np.maximum(self.left, 0).tolist(), np.where(self.dim >= 0, 2, 0).tolist(), parent.tolist(), depth.tolist(), leaves[np.argsort(self.cell[leaves])].tolist(), {"split": self.dim.tolist(), "value": self.value.tolist()})


@register("kdtree")
class KdForest(CellIndex):
    """Randomised trees, searched best branch first over all of them until `checks` points have been met."""

    choose, pivots = "variance", None

    def trees_wanted(self) -> int:
        return 1 if self.exact else self.params.trees

    def blank(self) -> Boxes:
        return Boxes(getattr(self, "dim", 0))

    def shape(self, x: np.ndarray, leaf: float, tree: int, depth: int, room: int) -> Shape:
        rng = None if self.exact else np.random.default_rng(self.params.seed + tree)
        return KdTree(x, leaf, rng, self.pivots or self.params.pivot, self.choose, depth, room).shape()

    def bounded(self) -> bool:
        return has_box_bound(self.distance)

    def traverse(self, tree: int = 0) -> Iterator[dict]:
        """A tree's nodes in preorder: node, depth, split_dim and split_value (of inner ones), left, right, cell (of leaves)."""
        f, work = self.forest, [self.forest.roots[tree]]
        while work:
            node = work.pop()
            inner, left = bool(f.count[node]), int(f.first[node])
            yield {"node": node, "depth": int(f.depth[node]), "split_dim": int(f.split[node]) if inner else None, "split_value": float(f.value[node]) if inner else None, "left": left if inner else None, "right": left + 1 if inner else None, "cell": None if inner else int(f.cell[node])}
            if inner:
                work += [left + 1, left]

    def leaf(self, cell: int, tree: int = 0) -> DataFrame:
        """The points of a leaf (id, v); no other shelf is read."""
        out = self.shelves_read({tree: np.array([cell])}).where((F.col("table_no") == tree) & (F.col("cell") == cell)).select("id", "v")
        return out if self.removed is None else out.join(self.removed, "id", "left_anti")

    def nodes(self) -> DataFrame:
        """(tree, node, split_dim, split_value, left, right, cell): -1 where there is none."""
        f = self.forest
        rows = [(int(f.tree[i]), i, int(f.split[i]), float(f.value[i]), int(f.first[i]) if f.count[i] else -1, int(f.first[i]) + 1 if f.count[i] else -1, int(f.cell[i])) for i in range(len(f))]
        return self.spark.createDataFrame(rows, "tree int, node int, split_dim int, split_value double, left int, right int, cell int")

    def outline(self, tree: int = 0) -> str:
        """A tree in preorder, a node per line, indented by depth."""
        return "\n".join("  " * n["depth"] + (f"cell {n['cell']}" if n["left"] is None else f"v[{n['split_dim']}] < {n['split_value']:g}") for n in self.traverse(tree))


@register("kdtree_single")
class KdSingle(KdForest):
    """One tree split at the middle of the widest span. Exact: the nearest leaves give a worst distance, and the leaves whose boxes lie within
    it (widened by eps) are searched."""

    exact = True
    choose, pivots = "span", "middle"


@register("kdtree_cyclic")
class CyclicTree(KdSingle):
    """As kdtree_single, with the split dimension given by the depth."""

    choose, pivots = "cyclic", "median"
