"""Files of fixed-size records: TEXMEX vectors, raw numbers, CIFAR images; with text formats for small data sets.

Reading is distributed by ranges of whole records: `scan` makes a row per range and every task opens its files and takes its ranges. Files
must lie where all executors see them; addresses that only pyarrow's file systems know (hdfs://, s3://) work as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_BYTES = 16 << 20


def _system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _size(path: str) -> int:
    system, inner = _system(path)
    return system.get_file_info(inner).size


def _read(path: str, start: int, size: int) -> bytes:
    system, inner = _system(path)
    with system.open_input_file(inner) as f:
        f.seek(start)
        return f.read(size)


def write_bytes(path: str, data: bytes) -> None:
    system, inner = _system(path)
    with system.open_output_stream(inner) as f:
        f.write(data)


def scan(spark: SparkSession, path: str, record: int, schema: str, decode: Callable[[np.ndarray, int], pa.RecordBatch], limit: int | None = None) -> DataFrame:
    """Rows of a file of records of so many bytes; decode turns (bytes as rows, number of the first record) into a batch."""
    size = _size(path)
    if record < 1 or size % record:
        raise ValueError(f"{path} isn't made of records of {record} bytes")
    total = size // record
    n = total if limit is None else max(0, min(limit, total))
    step = max(1, RANGE_BYTES // record)
    ranges = [(a, min(step, n - a)) for a in range(0, n, step)]
    tasks = spark.createDataFrame(ranges or [(0, 0)], "first long, many long").repartition(max(1, min(len(ranges), 4096)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, many in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if many:
                    rows = np.frombuffer(_read(path, first * record, many * record), np.uint8).reshape(many, record)
                    yield decode(rows, first)

    return tasks.mapInArrow(run, schema)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    flat = pa.array(np.ascontiguousarray(x).reshape(-1), kind)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)


#: Element types of the TEXMEX files by their ending.
TEXMEX = {"fvecs": ("<f4", "float", pa.float32()), "ivecs": ("<i4", "int", pa.int32()), "bvecs": ("u1", "short", pa.int16())}


def read_texmex(spark: SparkSession, path: str, kind: str | None = None, limit: int | None = None, keep: int | None = None, with_dimension: bool = False) -> DataFrame:
    """(id, v): ids count the records. Each record holds its number of components before them; all must be equal.

    limit takes the first records (1 is one record), keep the first components; with_dimension puts their number before the components.
    """
    dtype, name, arrow = TEXMEX[kind or path.rsplit(".", 1)[-1]]
    dim = int(np.frombuffer(_read(path, 0, 4), "<i4")[0]) if _size(path) else 0
    width = np.dtype(dtype).itemsize

    def decode(rows: np.ndarray, first: int) -> pa.RecordBatch:
        heads = np.ascontiguousarray(rows[:, :4]).view("<i4")[:, 0]
        if (heads != dim).any():
            raise ValueError(f"{path}: vectors of several lengths")
        x = np.ascontiguousarray(rows[:, 4:]).view(dtype)[:, :keep]
        if with_dimension:
            x = np.concatenate((np.full((len(x), 1), dim, x.dtype), x), axis=1)
        return pa.record_batch([pa.array(np.arange(first, first + len(x))), _lists(x, arrow)], names=["id", "v"])

    return scan(spark, path, 4 + dim * width, f"id long, v array<{name}>", decode, limit)


def write_texmex(df: DataFrame, path: str, kind: str | None = None) -> None:
    """Vectors (id, v) in order of id as one small file, a partition at a time through the driver; the texmex data source writes any size."""
    dtype = TEXMEX[kind or path.rsplit(".", 1)[-1]][0]
    system, inner = _system(path)
    with system.open_output_stream(inner) as out:
        for r in df.orderBy("id").select("v").toLocalIterator(prefetchPartitions=True):
            out.write(np.array([len(r[0])], "<i4").tobytes() + np.array(r[0], dtype).tobytes())


def write_texmex_parts(df: DataFrame, folder: str, kind: str = "fvecs") -> DataFrame:
    """The same at any size: a file per partition, written where the rows are; (path, n) of the files."""
    dtype = TEXMEX[kind][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path, n, parts = f"{folder}/part-{TaskContext.get().partitionId():05d}.{kind}", 0, []
        for b in batches:
            for v in b.column(0).to_pylist():
                parts.append(np.array([len(v)], "<i4").tobytes() + np.array(v, dtype).tobytes())
                n += 1
        if n:
            write_bytes(path, b"".join(parts))
            yield pa.record_batch([pa.array([path]), pa.array([n], pa.int64())], names=["path", "n"])

    return df.select("v").mapInArrow(run, "path string, n long")


#: Numpy codes of raw element types and their Spark types.
RAW = {"float64": ("<f8", "double"), "float32": ("<f4", "float"), "int64": ("<i8", "long"), "int32": ("<i4", "int"), "int16": ("<i2", "short"), "int8": ("i1", "byte"), "uint8": ("u1", "short"), "uint16": ("<u2", "int"), "uint32": ("<u4", "long")}


def read_raw(spark: SparkSession, path: str, kind: str = "float64", limit: int | None = None) -> DataFrame:
    """(pos, value) of a file of bare numbers."""
    dtype, name = RAW[kind]
    arrow = T._parse_datatype_string(name)
    from pyspark.sql.pandas.types import to_arrow_type

    def decode(rows: np.ndarray, first: int) -> pa.RecordBatch:
        x = np.ascontiguousarray(rows).view(dtype)[:, 0]
        return pa.record_batch([pa.array(np.arange(first, first + len(x))), pa.array(x).cast(to_arrow_type(arrow))], names=["pos", "value"])

    return scan(spark, path, np.dtype(dtype).itemsize, f"pos long, value {name}", decode, limit)


def read_raw_vectors(spark: SparkSession, path: str, dim: int, kind: str = "float64", limit: int | None = None) -> DataFrame:
    """(id, v) of a file of bare numbers, dim to a vector."""
    dtype, _ = RAW[kind]

    def decode(rows: np.ndarray, first: int) -> pa.RecordBatch:
        x = np.ascontiguousarray(rows).view(dtype).astype(np.float64)
        return pa.record_batch([pa.array(np.arange(first, first + len(x))), _lists(x, pa.float64())], names=["id", "v"])

    return scan(spark, path, dim * np.dtype(dtype).itemsize, "id long, v array<double>", decode, limit)


def write_raw(df: DataFrame, path: str, kind: str = "float64") -> None:
    """Column value in order of pos as bare numbers."""
    dtype = RAW[kind][0]
    system, inner = _system(path)
    with system.open_output_stream(inner) as out:
        for r in df.orderBy("pos").select("value").toLocalIterator(prefetchPartitions=True):
            out.write(np.array([r[0]], dtype).tobytes())


def read_cifar(spark: SparkSession, path: str, labels: int = 1, pixels: int = 3072, limit: int | None = None, packed: bool = False) -> DataFrame:
    """(id, label, v): images as planes of unsigned bytes, arrays of short or (packed) BINARY; of several label bytes the last counts."""

    def decode(rows: np.ndarray, first: int) -> pa.RecordBatch:
        if packed:
            flat = np.ascontiguousarray(rows[:, labels:])
            images = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1, dtype=np.int32) * pixels).tobytes()), pa.py_buffer(flat.tobytes())])
            return pa.record_batch([pa.array(np.arange(first, first + len(rows))), pa.array(rows[:, labels - 1].astype(np.int16)), images], names=["id", "label", "v"])
        return pa.record_batch([pa.array(np.arange(first, first + len(rows))), pa.array(rows[:, labels - 1].astype(np.int16)), _lists(rows[:, labels:].astype(np.int16), pa.int16())], names=["id", "label", "v"])

    return scan(spark, path, labels + pixels, f"id long, label short, v {'binary' if packed else 'array<short>'}", decode, limit)


def interleave_planes(pixels, side: int, planes: int = 3):
    """A planar image column as one with the planes side by side per pixel."""
    n = side * side
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array(*[F.get(pixels, i + p * n) for p in range(planes)])))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """(pos, name): the tokens of a text file, split at white space."""
    lines = spark.read.text(path, wholetext=True)
    return lines.select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda w: w != "")).alias("pos", "name"))


def read_iris(spark: SparkSession, path: str) -> DataFrame:
    """(v, label): four numbers and a name per line, separated by blanks; empty lines are none, any other line raises an error."""
    fields = [T.StructField(c, T.DoubleType()) for c in "abcd"] + [T.StructField("label", T.StringType())]
    rows = spark.read.csv(path, sep=" ", schema=T.StructType(fields), mode="FAILFAST").where("label is not null")
    return rows.select(F.array(*"abcd").alias("v"), "label")


def parse_points(spark: SparkSession, text: str) -> tuple[int, DataFrame, DataFrame]:
    """(k, points (id, v, label), query (id, v)) of `k N`, N triples `x y class` and the query's triple."""
    words = text.split()
    k, n = int(words[0]), int(words[1])
    rows = [(i, [float(words[2 + 3 * i]), float(words[3 + 3 * i])], int(float(words[4 + 3 * i]))) for i in range(n + 1)]
    return k, spark.createDataFrame(rows[:n], "id long, v array<double>, label int"), spark.createDataFrame([rows[n][:2]], "id long, v array<double>")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(id, v) of a two-dimensional array in numpy's own format, in C order."""
    head = _read(path, 0, min(_size(path), 4096))
    import io

    version = np.lib.format.read_magic(f := io.BytesIO(head))
    shape, fortran, dtype = np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)
    if fortran or len(shape) != 2:
        raise ValueError("a two-dimensional array in C order is needed")
    start, row = f.tell(), shape[1] * dtype.itemsize
    ranges = [(a, min(max(1, RANGE_BYTES // row), shape[0] - a)) for a in range(0, shape[0], max(1, RANGE_BYTES // row))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, many in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(_read(path, start + first * row, many * row), dtype).reshape(many, shape[1]).astype(np.float64)
                yield pa.record_batch([pa.array(np.arange(first, first + many)), _lists(x, pa.float64())], names=["id", "v"])

    return spark.createDataFrame(ranges, "first long, many long").mapInArrow(run, "id long, v array<double>")


def read_hdf5(spark: SparkSession, path: str, name: str, partitions: int = 8) -> DataFrame:
    """(id, v) of a two-dimensional HDF5 dataset, each task taking its range of rows. Needs h5py."""
    try:
        import h5py
    except ImportError as e:
        raise ImportError("read_hdf5 needs h5py") from e
    with h5py.File(path, "r") as f:
        n = f[name].shape[0]
    step = max(1, -(-n // partitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import h5py

        with h5py.File(path, "r") as f:
            for b in batches:
                for a in b.column(0).to_pylist():
                    x = np.asarray(f[name][a : a + step], np.float64)
                    yield pa.record_batch([pa.array(np.arange(a, a + len(x))), _lists(x, pa.float64())], names=["id", "v"])

    return spark.range(0, n, step, partitions).mapInArrow(run, "id long, v array<double>")


def append_benchmark(path: str, cores: int, method: str, elapsed: float) -> None:
    """A line `cores,method,seconds` at the end of a local file."""
    with open(path, "a") as f:
        f.write(f"{cores},{method},{elapsed}\n")


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema="cores int, method string, elapsed double")
