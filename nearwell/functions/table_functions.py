"""Nearest neighbours as a table function in SQL: SELECT ... FROM queries q, LATERAL near(q.v)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import knn
from ..operators.index.nodes import box_bound, has_box_bound
from . import distances
from .vectors import profile

WINDOW = 512  # points on either side that a query looks at first


def register_knn(spark: SparkSession, name: str, base: DataFrame, k: int, distance="l2") -> None:
    """Register name(v): the k nearest of base (id, v) as rows (rank, id, dist), order (dist, id).

    Every task holds the base, so it must fit BROADCAST_BYTES: its size is checked first, and a larger one raises ValueError (knn_join and the
    indexes have no such limit). A null vector has no rows; one of another length raises an error.
    """
    if k < 1:
        raise ValueError("k is at least 1")
    n, dim = profile(base)
    if n * (dim + 1) * 8 > knn.BROADCAST_BYTES:
        raise ValueError(f"a table function takes {knn.BROADCAST_BYTES} bytes of vectors at most: use knn_join")
    table = base.select("id", "v").toArrow()
    ids, x = table["id"].to_numpy(), knn.matrix(table["v"].combine_chunks(), dim).astype(np.float64) if n else np.zeros((0, dim))
    low, high = (x.min(axis=0), x.max(axis=0)) if n else (np.zeros(dim), np.zeros(dim))
    widest = int(np.argmax(high - low)) if n else 0
    order = np.argsort(x[:, widest], kind="stable") if n else np.arange(0)
    shared = spark.sparkContext.broadcast((ids[order], x[order], np.ascontiguousarray(x[order, widest]) if n else np.zeros(0), low, high))
    d = distances.get(distance)
    bounded = has_box_bound(d)

    class Near:
        def nearest(self, q, ids, x, line, low, high):
            """Points about the query's place in order of the widest component, ever more of them, until no other can be as near."""
            at, wide = int(np.searchsorted(line, q[0, widest])), max(WINDOW, 4 * k) if bounded else len(ids)
            while True:
                a, z = max(0, at - wide), min(len(ids), at + wide)
                found = knn.best_of(np.zeros(1, np.int64), q, ids[a:z], x[a:z], d, k)
                if a == 0 and z == len(ids):
                    return found
                if found.num_rows == k:
                    boxes = np.array([low, low], np.float64), np.array([high, high], np.float64)
                    boxes[1][0, widest], boxes[0][1, widest] = line[a], line[z - 1]  # all before the window, all behind it
                    worst, out = found["dist"].to_numpy().max(), box_bound(d, np.repeat(q, 2, axis=0), *boxes)
                    if (a == 0 or out[0] > worst) and (z == len(ids) or out[1] > worst):
                        return found
                wide *= 4

        def eval(self, v) -> Iterator[tuple[int, int, float]]:
            if v is None:
                return
            ids, x, line, low, high = shared.value
            q = np.array([v], np.float64)
            if q.shape[1] != x.shape[1] or not np.isfinite(q).all():
                raise ValueError("VectorError: null or non-finite components, or a vector of another length")
            found = self.nearest(q, ids, x, line, low, high)
            order = np.lexsort((found["id"].to_numpy(), found["dist"].to_numpy()))
            for r, i in enumerate(order.tolist()):
                yield r + 1, found["id"][i].as_py(), found["dist"][i].as_py()

    spark.udtf.register(name, F.udtf(Near, returnType="rank int, id long, dist double", useArrow=True))
