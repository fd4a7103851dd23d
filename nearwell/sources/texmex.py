"""TEXMEX vector files as a Spark data source: spark.read.format("texmex"), df.write.format("texmex").

A path is a file or a folder of files (their names in order); records of a folder are numbered through. Reading plans byte ranges of whole
records from the files' sizes alone and opens them in the tasks. Writing makes a file per task, in order of the rows that it gets, under a
name that no reader takes; commit renames those of the tasks that count and adds _SUCCESS, so a task that is run again or lost leaves
nothing behind. No vector passes through the driver.

Options: kind (fvecs, ivecs, bvecs; else by the ending), keep (the first components only), limit (the first records). Repeated lengths
that differ, and files that aren't whole records, raise ValueError; an empty file or folder has no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .records import RANGE_BYTES, TEXMEX, _lists, _read, _system


def _files(path: str, kinds: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files with the right ending, in order of their names."""
    from pyarrow import fs

    system, inner = _system(path)
    info = system.get_file_info(inner)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inner))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.rsplit(".", 1)[-1] in kinds and f.base_name[0] not in "._")


@dataclass
class Range(InputPartition):
    path: str
    first: int  # record of the file
    many: int
    id: int  # of the first record
    dim: int


class TexmexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "texmex"

    def kind(self) -> str:
        ending = self.options["path"].rstrip("/").rsplit(".", 1)[-1]
        kind = self.options.get("kind") or (ending if ending in TEXMEX else None)
        if kind is None:
            found = {f.rsplit(".", 1)[-1] for f, _ in _files(self.options["path"], tuple(TEXMEX))}
            if len(found) != 1:
                raise ValueError(f"option kind says which of {', '.join(TEXMEX)}")
            kind = found.pop()
        if kind not in TEXMEX:
            raise ValueError(f"no kind {kind!r}")
        return kind

    def schema(self) -> str:
        return f"id long, v array<{TEXMEX[self.kind()][1]}>"

    def reader(self, schema) -> TexmexReader:
        return TexmexReader(self.options["path"], self.kind(), *(int(x) if (x := self.options.get(o)) else None for o in ("keep", "limit")))

    def writer(self, schema, overwrite: bool) -> TexmexWriter:
        if "v" not in schema.names:
            raise ValueError("a column v is written")
        return TexmexWriter(self.options["path"], self.kind(), schema.names.index("v"), overwrite)


class TexmexReader(DataSourceReader):
    def __init__(self, path: str, kind: str, keep: int | None, limit: int | None):
        self.path, self.kind, self.keep, self.limit = path, kind, keep, limit

    def partitions(self) -> list[InputPartition]:
        width = np.dtype(TEXMEX[self.kind][0]).itemsize
        out, at = [], 0
        for path, size in _files(self.path, (self.kind,)):
            if not size:
                continue
            dim = int(np.frombuffer(_read(path, 0, 4), "<i4")[0]) if size >= 4 else 0
            record = 4 + dim * width
            if dim < 1 or size % record:
                raise ValueError(f"{path} isn't made of records of {record} bytes")
            many = size // record if self.limit is None else max(0, min(size // record, self.limit - at))
            step = max(1, RANGE_BYTES // record)
            out += [Range(path, a, min(step, many - a), at + a, dim) for a in range(0, many, step)]
            at += many
        if len({r.dim for r in out}) > 1:
            raise ValueError(f"{self.path}: vectors of several lengths")
        return out or [Range("", 0, 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        dtype, _, arrow = TEXMEX[self.kind]
        if not part.many:
            return
        record = 4 + part.dim * np.dtype(dtype).itemsize
        rows = np.frombuffer(_read(part.path, part.first * record, part.many * record), np.uint8).reshape(part.many, record)
        if (np.ascontiguousarray(rows[:, :4]).view("<i4")[:, 0] != part.dim).any():
            raise ValueError(f"{part.path}: vectors of several lengths")
        x = np.ascontiguousarray(rows[:, 4:]).view(dtype)[:, : self.keep]
        for a in range(0, len(x), 8192):
            yield pa.record_batch([pa.array(np.arange(part.id + a, part.id + min(a + 8192, len(x)))), _lists(x[a : a + 8192], arrow)], names=["id", "v"])


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    part: int
    rows: int


class TexmexWriter(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, column: int, overwrite: bool):
        self.path, self.kind, self.column, self.overwrite = path.rstrip("/"), kind, column, overwrite
        self.job = uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = _system(self.path)
        system.create_dir(folder)
        inner = f"{folder}/_{self.job}-{task.partitionId():05d}-{task.taskAttemptId()}"
        dtype, rows, out = TEXMEX[self.kind][0], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(self.column)
            size = np.diff(column.offsets.to_numpy())
            flat = column.flatten()
            if column.null_count or flat.null_count or (size != size[0]).any():
                raise ValueError("null vectors or components, or vectors of several lengths")
            x = flat.to_numpy(zero_copy_only=False).astype(dtype).reshape(len(size), -1)
            heads = np.full((len(x), 1), x.shape[1], "<i4").view(np.uint8)
            out = out or system.open_output_stream(inner)
            out.write(np.concatenate((heads, np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)), axis=1).tobytes())
            rows += len(x)
        if out is not None:
            out.close()
        return Written(inner if rows else None, task.partitionId(), rows)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, folder = _system(self.path)
        system.create_dir(folder)
        if self.overwrite:
            for f in system.get_file_info(fs.FileSelector(folder)):
                if f.type == fs.FileType.File and f.base_name.rsplit(".", 1)[-1] in TEXMEX:
                    system.delete_file(f.path)
        for m in messages:
            if m is not None and m.path:
                system.move(m.path, f"{folder}/part-{m.part:05d}-{self.job[:8]}.{self.kind}")
        self._sweep(system, folder)
        system.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _system(self.path)
        self._sweep(system, folder)

    def _sweep(self, system, folder: str) -> None:
        """Delete what tasks of this job that don't count have written."""
        from pyarrow import fs

        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(f"_{self.job}-"):
                system.delete_file(f.path)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(TexmexSource)
