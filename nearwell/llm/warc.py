"""WARC archives as seekable Zstandard bundles.

A bundle holds independent frames of a few records each and ends with a seek table in a skippable frame (sizes of every frame), so that a
reader decompresses only the frame it wants. The index maps a record's identifier to its bundle, frame and offset within the frame.
Of records with equal payloads the one with the largest key is the response; the others are revisits that name it and hold no payload.

Bundles get their names from what is in them and appear under their final name at once, so a task that runs again after a lost executor
puts the same file in place of itself.

Defined cases: a null or empty page has an empty payload, which is deduplicated like any other; rows that share the largest key of their
payload are all responses; a null key counts as smaller than all others and its identifier is that of no key; an empty table leaves an
empty archive folder; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_path

FRAME_BYTES = 1 << 18  # records of a frame, before compression
BUNDLE_BYTES = 1 << 24  # records of a bundle, before compression
LEVEL = 3
#: Fixed values of the seekable format: magic numbers of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # records carry a fixed date, so that archives of equal rows are equal


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None) -> str:
    return f"urn:nearwell:page:{'' if key is None else key}"


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if refers_to isn't null."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    uri = "".join((url or "about:blank").split())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(key)}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of the records that stand one after another in data."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class BundleWriter:
    """Gathers records into frames; close() gives the bundle's bytes and where each record lies."""

    def __init__(self):
        import zstandard

        self._zstd = zstandard.ZstdCompressor(level=LEVEL)
        self._frames, self._sizes, self._open, self._used, self.places, self.bytes = [], [], [], 0, [], 0

    def add(self, key: int | None, data: bytes) -> None:
        self.places.append((key, len(self._frames), self._used, len(data)))
        self._open.append(data)
        self._used += len(data)
        self.bytes += len(data)
        if self._used >= FRAME_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self._open:
            frame = self._zstd.compress(b"".join(self._open))
            self._frames.append(frame)
            self._sizes.append((len(frame), self._used))
            self._open, self._used = [], 0

    def close(self) -> bytes:
        self._flush()
        table = b"".join(struct.pack("<II", a, b) for a, b in self._sizes) + struct.pack("<IBI", len(self._sizes), 0, SEEKABLE)
        return b"".join(self._frames) + struct.pack("<II", SKIPPABLE, len(table)) + table


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of every frame, read from the footer."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    at = len(bundle) - 9 - count * entry
    if struct.unpack("<II", bundle[at - 8 : at]) != (SKIPPABLE, count * entry + 9):
        raise ValueError("broken seek table")
    out, start = [], 0
    for k in range(count):
        a, b = struct.unpack("<II", bundle[at + k * entry : at + k * entry + 8])
        out.append((start, a, b))
        start += a
    return out


def frame(bundle: bytes, k: int) -> bytes:
    import zstandard

    start, a, b = seek_table(bundle)[k]
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + a], max_output_size=b)


def read_record(bundle: bytes, frame_number: int, offset: int) -> tuple[dict[str, str], bytes]:
    """One record by its place: only its frame is decompressed."""
    return next(parse(frame(bundle, frame_number)[offset:]))


def _put(folder: str, name: str, data: bytes) -> None:
    """A file in a folder that all executors share: a path, a file: address, or another one that pyarrow's file systems know."""
    if "://" in folder and not folder.startswith("file:"):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        own = f"{path}/_{name}.{os.getpid()}"
        with system.open_output_stream(own) as out:
            out.write(data)
        system.move(own, f"{path}/{name}")
        return
    path = "/" + folder.removeprefix("file:").lstrip("/")
    os.makedirs(path, exist_ok=True)
    own = f"{path}/_{name}.{os.getpid()}"
    with open(own, "wb") as out:
        out.write(data)
    os.replace(own, f"{path}/{name}")


def _classed(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """(key, url, html, digest, refers_to): refers_to is the largest key of the payload's rows, null for those that have it."""
    spark = pages.sparkSession
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("html"), F.sha1(body.cast("binary")).alias("sha1"))
    several = rows.select("key", "sha1").groupBy("sha1").agg(F.max("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    several = materialize(spark, several, "payloads")
    return rows.join(several, "sha1", "left").select("key", "url", "html", F.when(F.col("key").isNull() | (F.col("key") < F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write bundles into folder; the index (key, record_id, bundle, frame, offset, length) as a table that is written at once."""
    spark: SparkSession = pages.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(w: BundleWriter) -> pa.RecordBatch:
            data = w.close()
            name = f"part-{hashlib.blake2b(data, digest_size=12).hexdigest()}.warc.zst"
            _put(folder, name, data)
            keys, frames, offsets, lengths = zip(*w.places, strict=True)
            columns = [pa.array(keys, pa.int64()), pa.array([record_id(k) for k in keys]), pa.array([name] * len(keys)), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
            return pa.record_batch(columns, names=["key", "record_id", "bundle", "frame", "offset", "length"])

        w = BundleWriter()
        for batch in batches:
            for i in range(batch.num_rows):
                k, u, t, r = (batch.column(c)[i].as_py() for c in range(4))
                payload = t.encode("utf-8")
                w.add(k, record(k, u, payload, digest32(payload), r))
                if w.bytes >= BUNDLE_BYTES:
                    yield done(w)
                    w = BundleWriter()
        if w.places:
            yield done(w)

    index = _classed(pages, key, url, html).mapInArrow(run, "key long, record_id string, bundle string, frame int, offset long, length long")
    return materialize(spark, index, "index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the bundles in folder: key, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for a revisit), bundle, frame.

    A response's size and digest are taken from its payload and must agree with its headers.
    """
    number = len(record_id(None))

    def key(identifier: str) -> int | None:
        text = identifier.strip("<>")[number:]
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py().rpartition("/")[2], batch.column(1)[i].as_py()
                for f, (start, a, b) in enumerate(seek_table(data)):
                    rows = []
                    for h, block in parse(unzip.decompress(data[start : start + a], max_output_size=b)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        revisit = h["warc-type"] == "revisit"
                        if not revisit and (len(payload) != size or digest32(payload) != digest):
                            raise ValueError(f"{h['warc-record-id']}: the payload isn't what its headers say")
                        rows.append((key(h["warc-record-id"]), h["warc-target-uri"], size, digest, h["warc-type"], key(h["warc-refers-to"]) if revisit else None, None if revisit else payload, name, f))
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int32()), strict=True)]
                    yield pa.record_batch(columns, names=["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "bundle", "frame"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select("path", "content")
    return files.mapInArrow(run, "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, bundle string, frame int")


def archived(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of pages, read back from the archives just written."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    index = write(pages, folder)
    if not index.take(1):
        return index.select(F.col("key").alias("page_id"), F.lit(0).cast("long").alias("payload_bytes"), F.lit("").alias("payload_digest"), F.lit("").alias("record_type"), F.col("key").alias("refers_to"))
    # a task that was run twice with another order of rows leaves a second bundle: the index names the one that counts
    records = read(spark, folder).join(materialize(spark, index.select("bundle").distinct(), "bundles"), "bundle", "left_semi")
    return records.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
