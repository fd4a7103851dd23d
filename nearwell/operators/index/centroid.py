"""Centre-based indexes: a k-means tree and trees of medoids, searched by centres and balls."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ...functions import distances
from ..cluster import best_cut
from .base import register
from .cells import CellIndex
from .nodes import Balls, Shape, grow, root


def _seeds(x: np.ndarray, k: int, rng: np.random.Generator, chooser: str, name: str) -> np.ndarray:
    different = np.unique(x, axis=0)
    if len(different) <= k:
        return different
    if chooser == "random":
        return different[rng.permutation(len(different))[:k]]
    d = distances.get(name)
    centres = [different[int(rng.integers(len(different)))]]
    near = d.matrix(np.array(centres), different)[0]
    while len(centres) < k:
        weight = near if d.name in ("l2", "l2_simple", "hellinger", "chi_square") else near * near
        i = int(near.argmax()) if chooser == "gonzales" or weight.sum() <= 0 else int(rng.choice(len(different), p=weight / weight.sum()))
        centres.append(different[i])
        near = np.minimum(near, d.matrix(different[i : i + 1], different)[0])
    return np.array(centres)


def _lloyd(x: np.ndarray, centres: np.ndarray, iterations: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    d, done = distances.get(name), 0
    while True:
        near = np.concatenate([d.nearest(x[a : a + 4096], centres) for a in range(0, len(x), 4096)])
        if done == iterations:
            return centres, near
        new = centres.copy()
        for c in range(len(centres)):
            if (mine := near == c).any():
                new[c] = x[mine].mean(axis=0)
        done += 1
        if (new == centres).all():
            return centres, near
        centres = new


class _Centres(CellIndex):
    def blank(self) -> Balls:
        return Balls(getattr(self, "dim", 0))

    def bounded(self) -> bool:
        return root(self.distance, np.zeros(1)) is not None

    def grown(self, x: np.ndarray, leaf: float, room: int, divide, centre) -> Shape:
        """divide(vectors) gives their clusters' numbers and the centres that they were assigned to; centre(vectors) that of the root."""

        def split(rows: np.ndarray, made: int):
            if len(rows) <= max(leaf, 1) or made + self.params.branching >= room:
                return None
            near, centres = divide(x[rows])
            used = [c for c in range(len(centres)) if (near == c).any()]
            return ([rows[near == c] for c in used], [{"centre": centres[c]} for c in used]) if len(used) > 1 else None

        def describe(rows: np.ndarray) -> dict:
            return {"centre": centre(x[rows]), "variance": float(((x[rows] - x[rows].mean(axis=0)) ** 2).sum(axis=1).mean())}

        return grow(x, split, describe)


@register("kmeans")
class KMeansIndex(_Centres):
    """A k-means tree of `branching` children per node, trained on the sample; branches go by their distance less cb_index times their variance."""

    @property
    def cb_index(self) -> float:
        return self.params.cb_index

    def shape(self, x: np.ndarray, leaf: float, tree: int, depth: int, room: int) -> Shape:
        rng, name = np.random.default_rng(self.params.seed + depth), self.distance.name

        def divide(part: np.ndarray):
            centres, near = _lloyd(part, _seeds(part, self.params.branching, rng, self.params.centers_init, name), self.params.iterations, name)
            return near, centres

        return self.grown(x, max(leaf, self.params.branching if not depth else 1), room, divide, lambda part: part.mean(axis=0))


    def node_table(self) -> DataFrame:
        """(node, parent, size, variance, radius, centre) of the tree."""
        f = self.forest
        rows = [(i, int(f.parent[i]) if f.parent[i] >= 0 else None, int(f.held[i]), float(f.variance[i]), float(f.radius[i]), f.centre[i].tolist()) for i in range(len(f))]
        return self.spark.createDataFrame(rows, "node long, parent long, size long, variance double, radius double, centre array<double>")

    def cluster_centres(self, most: int) -> DataFrame:
        """(node, size, variance, centre) of the best cut of the tree with at most `most` clusters."""
        return best_cut(self.node_table().where("size > 0"), most).select("node", "size", "variance", "centre")


@register("hierarchical")
class HierarchicalIndex(_Centres):
    """`trees` trees of medoids (points of the sample), each level assigned in one pass; any distance."""

    def trees_wanted(self) -> int:
        return self.params.trees

    def shape(self, x: np.ndarray, leaf: float, tree: int, depth: int, room: int) -> Shape:
        rng = np.random.default_rng(self.params.seed + tree + depth)

        def divide(part: np.ndarray):
            medoids = _seeds(part, self.params.branching, rng, self.params.centers_init, self.distance.name)
            return self.distance.matrix(part, medoids).argmin(axis=1), medoids

        return self.grown(x, leaf, room, divide, lambda part: part[0])
