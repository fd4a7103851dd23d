"""Indexes made of others: a k-means tree with a k-d forest, and one that chooses method and budget by trial."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from ..evaluate import checks_for_precision, recall
from ..knn import knn_join, ranked
from ..sampling import order_key, split
from .base import TRAIN, SearchParams, VectorIndex, create, register


@register("composite")
class CompositeIndex(VectorIndex):
    """Candidates of both parts, each point once. Points are stored by the parts alone."""

    exact = False

    def save_points(self, folder: str) -> None: ...

    @classmethod
    def saved_points(cls, spark: SparkSession, folder: str, meta: dict, children: dict[str, VectorIndex]) -> DataFrame:
        return children["part0"].points

    def build(self) -> VectorIndex:
        super().build()
        names = {k: v for k, v in self.params.__dict__.items() if k != "extra"}
        self.parts = [create(self.points, m, self.distance, **names).build() for m in ("kmeans", "kdtree")]
        return self

    def _parts(self):
        for p in self.parts:
            p.removed = self.removed
        return self.parts

    def children(self) -> dict[str, VectorIndex]:
        return {f"part{i}": p for i, p in enumerate(self.parts)}

    def adopt(self, children: dict[str, VectorIndex]) -> None:
        self.parts = list(children.values())

    def knn(self, queries: DataFrame, k: int, params: SearchParams | None = None) -> DataFrame:
        if params is not None and params.checks == -1:
            return knn_join(queries, self.alive(), k, self.distance)
        params = params or SearchParams()
        for p in self._parts():
            if p.scans(params, k):  # all points: the other part could add nothing
                return p.knn(queries, k, params)
        a, b = (p.knn(queries, k, params).select("qid", "id", "dist") for p in self._parts())
        return ranked(a.unionByName(b).dropDuplicates(["qid", "id"]), k)

    def add(self, points: DataFrame) -> None:
        super().add(points)
        for p in self.parts:
            p.add(points)


@register("autotuned")
class AutotunedIndex(VectorIndex):
    """Tries methods and parameters on a sample and keeps the cheapest by build_weight * build + search time, plus memory.

    report lists (method, parameters, build seconds, search seconds, checks, memory ratio, cost). A sample of fewer than 10 queries: linear.
    The trials are TRIALS, or those of extra["trials"]. For k-means cb_index is then swept from 0 to 1: the value that needs the fewest
    checks is kept. The sample has TRAIN vectors at most.
    """

    exact = False
    TRIALS = [("kmeans", {"branching": b, "iterations": i}) for i in (1, 5, 10, 15) for b in (16, 32, 64, 128, 256)] + [("kdtree", {"trees": t}) for t in (1, 4, 8, 16, 32)]
    CB = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)

    def build(self) -> VectorIndex:
        super().build()
        n = min(int(self.built_size * self.params.sample_fraction), TRAIN)
        tests, base = split(self.points, min(max(n // 10, 1), 1000), self.params.seed)
        self.report: list[tuple] = []
        self.best, self.checks = create(self.points, "linear", self.distance).build(), -1
        if n // 10 < 10:
            return self
        tests, base = tests.cache(), base.orderBy(order_key(self.params.seed + 1), "id").limit(max(n, 100)).cache()
        truth = knn_join(tests, base, 1, self.distance).cache()
        truth.count()
        size, costs = base.count() * self.dim * 8, []
        for method, extra in [("linear", {}), *[(m, dict(x)) for m, x in self.params.extra.get("trials", self.TRIALS)]]:
            t0 = time.perf_counter()
            index = create(base, method, self.distance, seed=self.params.seed, **extra).build()
            t1 = time.perf_counter()
            checks = -1 if method == "linear" else checks_for_precision(lambda c, i=index: i.knn(tests, 1, SearchParams(checks=c)), truth, [self.params.target_precision], 32, n)[0][1]
            t2 = time.perf_counter()
            recall(index.knn(tests, 1, SearchParams(checks=checks)), truth).collect()
            t3 = time.perf_counter()
            costs.append((method, extra, t1 - t0, t3 - t2, checks, (index.used_memory() + size) / size))
        quickest = min(b * self.params.build_weight + s for _, _, b, s, _, _ in costs)
        self.report = [(*c, (c[2] * self.params.build_weight + c[3]) / quickest + self.params.memory_weight * c[5]) for c in costs]
        method, extra, _, _, self.checks, _, _ = min(self.report, key=lambda c: c[-1])
        if method == "kmeans":
            index, tried = create(base, method, self.distance, seed=self.params.seed, **extra).build(), []
            for cb in self.CB:
                index.params.cb_index = cb
                tried.append((checks_for_precision(lambda c: index.knn(tests, 1, SearchParams(checks=c)), truth, [self.params.target_precision], 32, n)[0][1], cb))
            self.checks, extra["cb_index"] = min(tried)
        self.best = create(self.points, method, self.distance, seed=self.params.seed, **extra).build()
        for df in (tests, base, truth):
            df.unpersist()
        return self

    def speedup(self) -> float:
        """Search seconds of the linear method over those of the chosen one, on the sample."""
        if not self.report:
            return 1.0
        return next(c[3] for c in self.report if c[0] == "linear") / min(self.report, key=lambda c: c[-1])[3]

    def knn(self, queries: DataFrame, k: int, params: SearchParams | None = None) -> DataFrame:
        params = params or SearchParams(checks=-2)
        self.best.removed = self.removed
        return self.best.knn(queries, k, SearchParams(self.checks, params.eps) if params.checks == -2 else params)

    def add(self, points: DataFrame) -> None:
        super().add(points)
        self.best.add(points)

    def save_points(self, folder: str) -> None: ...

    @classmethod
    def saved_points(cls, spark: SparkSession, folder: str, meta: dict, children: dict[str, VectorIndex]) -> DataFrame:
        return children["best"].points

    def children(self) -> dict[str, VectorIndex]:
        return {"best": self.best}

    def adopt(self, children: dict[str, VectorIndex]) -> None:
        self.best = children["best"]

    def state(self) -> dict:
        return {"checks": self.checks, "report": self.report}

    def restore(self, state: dict) -> None:
        self.checks, self.report = state["checks"], [tuple(r) for r in state["report"]]


