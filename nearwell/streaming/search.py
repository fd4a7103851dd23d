"""Nearest neighbours for a stream of queries against a table of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distances
from ..functions.vectors import dimension
from ..operators.knn import BROADCAST_BYTES, knn_join, matrix


def knn_stream(queries: DataFrame, base: DataFrame, k: int, distance="l2") -> DataFrame:
    """(qid, rank, id, dist) for a streaming table (id, v): every row is answered as it comes, without state.

    base must fit BROADCAST_BYTES (ValueError if it doesn't); for a larger one use answer() in foreachBatch.
    """
    dim, n = dimension(base), base.count()
    if n * (dim + 1) * 8 > BROADCAST_BYTES:
        raise ValueError("the table is too large to be sent to every task: use foreachBatch with answer()")
    table = base.orderBy("id").toArrow()
    shared = base.sparkSession.sparkContext.broadcast((table["id"].to_numpy(), matrix(table["v"].combine_chunks(), dim)))
    d = distances.get(distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column(1), dim)
            for a in range(0, len(q), 64):
                dist = d.matrix(q[a : a + 64], x)
                order = np.argsort(dist, axis=1, kind="stable")[:, :k]  # ids ascend, so ties go to the smaller
                i = np.repeat(np.arange(len(order)), order.shape[1])
                j = order.ravel()
                rank = np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(order))
                qid = np.repeat(b.column(0).to_numpy()[a : a + 64], order.shape[1])
                yield pa.record_batch([pa.array(qid), pa.array(rank), pa.array(ids[j]), pa.array(dist[i, j])], names=["qid", "rank", "id", "dist"])

    return queries.select("id", "v").mapInArrow(run, "qid long, rank int, id long, dist double")


def answer(base: DataFrame, k: int, write, distance="l2"):
    """A function for foreachBatch: each micro-batch of queries is joined exactly and given to write(rows, batch number)."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.take(1):
            write(knn_join(batch.select(F.col("id"), F.col("v")), base, k, distance), number)

    return run
