"""Shared pieces of the text operators: scratch tables, Arrow text slices, hashing."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python kernel holds as numpy arrays at one time; a longer single text makes a slice of its own.
SLICE_BYTES = 1 << 19
#: Hashes of what a task has met already that it remembers before it starts afresh.
SEEN = 1 << 17
#: Bytes that an Arrow batch holds at most (one longer text makes a batch of its own).
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Set BATCH_BYTES where the session has no limit of its own: a worker's memory must not follow the length of texts."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def scratch_base(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where none is named a local master gets a temporary one; a cluster raises ValueError."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder: executors and driver of a cluster need a shared one")
        base = tempfile.mkdtemp(prefix="nearwell-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; removed when the driver's Python ends."""
    path = f"{scratch_base(spark)}/nearwell-{uuid.uuid4().hex}/{label}"
    atexit.register(_remove, spark, path.rsplit("/", 1)[0])
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM is gone already: nothing is left to do
        return


def materialize(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there and any executor may be lost."""
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: 64-bit words of the bitmaps of keys that are broadcast: 2 MB.
FILTER_WORDS = 1 << 18


def key_bitmap(rows: DataFrame, key: str):
    """A broadcast bitmap of fixed size that marks the long key's values. It lets most other rows pass by a shuffle; only a join decides."""
    bits = rows.groupBy((F.pmod(key, F.lit(64 * FILTER_WORDS)) / 64).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, {64 * FILTER_WORDS}L) % 64 as int))")).alias("bits"))
    filled = np.zeros(FILTER_WORDS, np.int64)
    found = bits.toArrow()
    filled[found["word"].to_numpy()] = found["bits"].to_numpy()
    return rows.sparkSession.sparkContext.broadcast(filled)


def chosen(bitmap, key: str, inside: bool = True):
    """The rows whose key may be marked in a bitmap, or those that surely aren't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            place = np.mod(batch.column(batch.schema.names.index(key)).to_numpy(), 64 * FILTER_WORDS)
            yield batch.filter(pa.array(((bits[place >> 6] >> (place & 63)) & 1).astype(bool) == inside))

    return run


def sorted_runs(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """(rows of whole keys, False) from rows sorted by their first column, the key; of a key with more than most rows (some of them, True), as they come."""
    held: list[pa.RecordBatch] = []
    size, large = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if large is not None:
            key = batch.column(0).to_numpy()
            stop = int(np.searchsorted(key, large, side="right"))
            if stop:
                yield batch.slice(0, stop), True
            if stop == len(key):
                continue
            large, batch = None, batch.slice(stop)
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))  # the last key may go on
        if last or (held and held[-1].column(0)[-1].as_py() != key[0]):
            yield pa.concat_batches([*held, batch.slice(0, last)]), False
            held, size = [], 0
        held.append(batch.slice(last))
        size += held[-1].num_rows
        if most is not None and size > most:
            yield pa.concat_batches(held), True
            held, size, large = [], 0, key[-1]
    if held:
        yield pa.concat_batches(held), False


def crowded_keys(sampled: DataFrame, key: str, parts: int, most: int) -> np.ndarray:
    """The keys, at most 4 * parts of them, that have more than twice a task's share of a sample's rows, or more than most rows of it (16 at least).

    They tell where rows are best sent; no result hangs on them.
    """
    counts = materialize(sampled.sparkSession, sampled.groupBy(key).agg(F.count("*").alias("n")), "sampled")
    often = max(16, min(2 * (counts.agg(F.sum("n")).first()[0] or 0) // parts, most))
    rows = counts.where(F.col("n") > often).orderBy(F.desc("n"), key).select(key).limit(4 * parts).collect()
    return np.array(sorted(r[0] for r in rows), np.int64)


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """A string column without nulls (null counts as empty), as one array with 32-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def text_slices(column: pa.StringArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with at most limit bytes together, or of one longer row."""
    n = len(column)
    if n == 0:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def release() -> None:
    """Give freed memory back: an idle Python worker counts against its executor as much as a busy one."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def released(run):
    """run (a function of batches) with release() at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place on a copy."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
