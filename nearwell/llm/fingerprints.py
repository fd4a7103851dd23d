"""MinHash fingerprints of whole texts.

Universal hash permutations (multiply-add modulo 2**64) of the shingles' hashes are minimised per text in numpy; each minimum is kept as 16
mixed bits, so a fingerprint is a string of 4 hexadecimal digits per permutation. Near copies are found by joining bands of the
fingerprint in Spark and verified by the Jaccard similarity of the shingle sets.

Defined cases: a null text counts as empty; texts without words share one fingerprint and are near nothing but each other in likeness (1.0);
a text of fewer words than a shingle has its whole sequence as its only shingle; rows may repeat; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix64, partitions, text_array, text_slices
from .components import connected
from .shingles import shingle_hashes, shingle_sets, word_hashes

PERMUTATIONS = 128
BANDS = 32
SIMILARITY = 0.8
PER_TASK, SAMPLED = 8, 32  # ranges of doc_id to a task, and ids of a sample to a range
TILE = 128  # texts of a bucket that are compared in one task, or with as many others

_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, 4096, dtype=np.uint64)


def signatures(texts: pa.StringArray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """A row of 16-bit values per text."""
    out = np.full((len(texts), permutations), 0xFFFF, np.uint16)
    for a, b, data, offsets in text_slices(texts):
        g, at = shingle_hashes(*word_hashes(data, offsets))
        some = np.flatnonzero(np.diff(at) > 0)
        if not len(some):
            continue
        starts, v = at[:-1][some], np.empty_like(g)
        low = np.empty((permutations, len(some)), np.uint64)
        for k in range(permutations):
            np.multiply(g, _A[k], out=v)
            v += _B[k]
            np.minimum.reduceat(v, starts, out=low[k])
        out[a + some] = (mix64(low) & np.uint64(0xFFFF)).astype(np.uint16).T
    return out


def to_text(signature: np.ndarray) -> list[str]:
    raw = signature.astype(">u2")
    return [raw[i].tobytes().hex() for i in range(len(raw))]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal values: the estimate of the Jaccard similarity."""
    return (a == b).mean(axis=1)


def _in_order(docs: DataFrame) -> DataFrame:
    """(bucket, guard, doc_id, text) with every text once as itself, in partitions that hold whole buckets in descending doc_id order.

    A bucket is a range of doc_id. The first text of the next bucket follows each bucket as its guard, so that no text lacks its successor;
    that of the last bucket is the very first text. Equal doc_ids are ordered by text; a null doc_id comes after all others.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))).alias("at"))
    n = partitions(spark)
    # ranges of about equal numbers of texts, several to a task; a sample of ids tells their ends and decides nothing else
    thin = max(1, rows.count() // (PER_TASK * SAMPLED * n))
    some = rows.where((F.pmod(F.xxhash64("at"), F.lit(thin)) == 0) & (F.col("at") > float("-inf"))).select("at").toArrow()["at"].to_numpy()
    splits = sorted(set(np.sort(some)[:: max(1, len(some) // (PER_TASK * n))].tolist())) if n > 1 else []
    if splits:
        rows = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="at", outputCol="bucket").transform(rows).withColumn("bucket", F.col("bucket").cast("int"))
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    heads = sorted((r[0], r[1]) for r in rows.groupBy("bucket").agg(F.max("at")).collect())
    if not heads:
        return rows.select("bucket", F.lit(False).alias("guard"), "doc_id", "text")
    # the guard of bucket b is the head of the next lower one that has rows, and of the lowest the head of the highest
    guards = [(heads[i][1], heads[(i + 1) % len(heads)][0]) for i in range(len(heads))]
    rows = rows.join(F.broadcast(spark.createDataFrame(guards, "at double, next int")), "at", "left")  # a row for each range
    own, guard = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("guard")), F.struct(F.col("next").alias("bucket"), F.lit(True).alias("guard"))
    rows = rows.withColumn("copies", F.when(F.col("next").isNotNull(), F.array(own, guard)).otherwise(F.array(own)))
    rows = rows.select("doc_id", "text", F.explode("copies").alias("c")).select("c.bucket", "c.guard", "doc_id", "text")
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket", "guard", F.desc_nulls_last("doc_id"), "text")


def _fingerprinted(permutations: int):
    def say(rows: list[tuple], sigs: np.ndarray) -> pa.RecordBatch | None:
        """rows: (bucket, guard, doc_id, text), the last one only as a successor; sigs: theirs, and at the end those of the edited texts."""
        use = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
        if not use:
            return None
        edited = []
        for i in use:
            t, half = rows[i][3], len(rows[i][3]) // 2
            edited.append(t[: len(t) - half] + rows[i + 1][3][:half])
        after = signatures(pa.array(edited, pa.string()), permutations)
        here, following = sigs[use], sigs[[i + 1 for i in use]]
        return pa.record_batch(
            [
                pa.array([rows[i][2] for i in use], pa.int64()),
                pa.array([len(rows[i][3]) for i in use], pa.int64()),
                pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited]),
                pa.array(to_text(here)),
                pa.array(to_text(after)),
                pa.array(likeness(here, after)),
                pa.array(likeness(here, following)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_sig = [], np.empty((0, permutations), np.uint16)
        for batch in batches:
            texts = text_array(batch.column(3))
            for a, b, _, _ in text_slices(texts):
                part = batch.slice(a, b - a)
                rows = last + list(zip(*(c.to_pylist() for c in part.columns), strict=True))
                sigs = np.concatenate((last_sig, signatures(texts.slice(a, b - a), permutations)))
                if (out := say(rows, sigs)) is not None:
                    yield out
                last, last_sig = rows[-1:], sigs[-1:]

    return run


def fingerprint_with_neighbours(docs: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (see the module) for every row of docs."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _in_order(docs).mapInArrow(_fingerprinted(permutations), schema)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """key, fingerprint, bands (a hash per band of equal length; empty for a text without words)."""
    rows = permutations // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(1))
            sig = signatures(texts, permutations)
            band = [[int.from_bytes(hashlib.blake2b(bytes([j]) + s[j * rows : (j + 1) * rows].tobytes(), digest_size=8).digest(), "little", signed=True) for j in range(bands)] if (s != 0xFFFF).any() else [] for s in sig]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to_text(sig)), pa.array(band, pa.list_(pa.int64()))], names=["key", "fingerprint", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fingerprint string, bands array<bigint>")


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def _sets(texts: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    texts = text_array(texts)
    return [shingle_sets(data, offsets)[0] for k in range(len(texts)) for _, _, data, offsets in text_slices(texts.slice(k, 1))]


def _rest(similarity: float):
    """Verified pairs (a, b, jaccard) that connect what isn't connected yet in a tile (side 0 only) or between two tiles of a bucket.

    A pair that shares several bands is compared in the first of them.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("node", "ascending")])
        side, node, label, band = (table[c].to_numpy() for c in ("side", "node", "label", "band"))
        bands, sets = np.array(table["bands"].to_pylist(), np.int64), _sets(table["text"])
        sizes, group = np.array([len(x) for x in sets], np.int64), label.copy()
        cut, out = int((side == 0).sum()), []
        for i in range(cut):
            others = np.arange(cut if cut < len(node) else i + 1, len(node))
            others = others[np.minimum(sizes[i], sizes[others]) / np.maximum(sizes[i], sizes[others]) >= similarity]
            same = bands[others] == bands[i]
            others = others[bands[i][same.argmax(axis=1)] == band[0]] if len(others) else others
            for k in others.tolist():
                if group[i] != group[k] and (j := _jaccard(sets[i], sets[k])) >= similarity:
                    group[group == group[k]] = group[i]
                    out.append((node[i], node[k], j))
        x, y, j = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64()), "jaccard": pa.array(j, pa.float64())})

    return run


def near_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, permutations: int = PERMUTATIONS, bands: int = BANDS) -> DataFrame:
    """a, b, jaccard: verified pairs (a < b) that connect all keys whose texts share a band bucket and are similar.

    Equal texts are one candidate, tied to their smallest key. The texts of a bucket first meet the one with its smallest key, so that near
    copies cost a pass; what isn't connected by then is compared in tiles, where a pair is left out only if it is connected already. Rows
    with a null key take no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("key is not null")
    texts = rows.groupBy("text").agg(F.min("key").alias("key")).select(F.monotonically_increasing_id().alias("node"), "key", "text")
    texts = materialize(spark, texts, "texts")
    marked = materialize(spark, fingerprints(texts, "node", "text", permutations, bands).where(F.size("bands") > 0).select(F.col("key").alias("node"), "bands"), "bands")
    member = marked.select("node", F.explode("bands").alias("band")).join(texts.select("node", "key"), "node")
    head = member.groupBy("band").agg(F.min(F.struct("key", "node")).alias("head"), F.count("*").alias("n")).where("n > 1")
    head = materialize(spark, head.select("band", F.col("head.node").alias("head"), "n"), "heads")
    pairs = member.join(head, "band").where("head <> node").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j = [_jaccard(x, y) for k in range(batch.num_rows) for x, y in zip(_sets(batch.column(2).slice(k, 1)), _sets(batch.column(3).slice(k, 1)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(j, pa.float64())], names=["a", "b", "jaccard"])

    shape = "a long, b long, jaccard double"
    found = materialize(spark, both.mapInArrow(verify, shape).where(F.col("jaccard") >= similarity), "head-pairs")

    # what the heads left in several parts: tiles of the bucket against each other
    roots = materialize(spark, connected(found.select("a", "b")), "roots")
    at = member.join(head.where("n > 2"), "band").join(roots, "node", "left").select("band", "n", "node", F.coalesce("root", "node").alias("label"))
    parts = at.groupBy("band").agg(F.min("label").alias("one"), F.max("label").alias("other")).where("one <> other").select("band")
    at = at.join(parts, "band", "left_semi").withColumn("tile", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / TILE)))
    at = materialize(spark, at.select("band", "node", "label", "tile", F.ceil(F.col("n") / TILE).alias("tiles")), "tiles")
    tasks = at.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    tasks = tasks.select("band", "node", "label", F.least("tile", "other").alias("t0"), F.greatest("tile", "other").alias("t1"), (F.col("tile") > F.col("other")).cast("int").alias("side"))
    full = tasks.join(marked, "node").join(texts.select("node", "text"), "node")
    # between two tiles the second is side 1; a tile alone has side 0 only
    more = full.groupBy("band", "t0", "t1").applyInArrow(_paired(_rest(similarity)), shape)
    found = materialize(spark, found.unionByName(more), "pairs")

    name = texts.select("node", "key")
    named = found.join(name.select(F.col("node").alias("a"), F.col("key").alias("x")), "a").join(name.select(F.col("node").alias("b"), F.col("key").alias("y")), "b")
    named = named.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    first = texts.join(marked.select("node"), "node", "left_semi").select("text", F.col("key").alias("a"))
    copies = rows.join(first, "text").select("a", F.col("key").alias("b"), F.lit(1.0).alias("jaccard"))
    return named.unionByName(copies).where("a <> b").groupBy("a", "b").agg(F.max("jaccard").alias("jaccard"))


def _paired(run):
    """run, but for tiles of which one has no row here: there is nothing between them."""

    def either(table: pa.Table) -> pa.Table:
        across = len(table) and table["t0"][0] != table["t1"][0]
        return run(table.slice(0, 0) if across and len(set(table["side"].to_pylist())) < 2 else table)

    return either
