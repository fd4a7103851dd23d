"""Ranked lexical search, score-at-a-time over impact-ordered postings.

A document's score for an item is a sum over the item's terms (repeats included) of weight * impact, whole numbers all:
m = 100 - 75 + (75 * n * N) div L, impact = (10**9 * tf) div (1000 * tf + 8 * m), weight = floor(1000 * ln((2 N + 2) / (2 df + 1))).

Queries are taken in blocks of at most BLOCK_BYTES of distinct terms and items, which every task gets. One pass over the texts writes what
the terms of a block have as postings: a row per document, with its length and its (term, tf) pairs. Statistics (N, L, df) are sums over
that table. Documents are then searched where they lie: a task takes SHARD documents at a time and orders the postings of every term by
impact, so that those of one exact impact stand together. An item's groups of postings are processed by their contribution, highest first,
into one accumulator per document. It stops once no other document can reach the k-th best: none that hasn't been met can get beyond the
sum of the next contributions of all terms, and what has been met is kept where it still may. The scores of those are completed from the
postings by document. The k-th best of the shards before counts too. A task hands on k documents per item; the k best of all are kept.

Defined cases: a null text has no terms and a document without terms isn't counted; documents are rows, so repeated ones rank each by
itself; of equal scores the smaller doc_id comes first and a null one last; items without a document above 0 have no rows; rows of benchmark
that share an item_id (or have none) are items of their own, with ranks from 1 each; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, released, text_array

SHARD = 1 << 14  # documents that are searched at a time
BLOCK_BYTES = 32 << 20
FIRST = 1 << 11  # postings before the first look at the bounds; twice as many before every further one
#: A-Z lower-cased; what is neither letter, digit nor beyond ASCII divides terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for t in text_array(column):
        yield t.as_buffer().to_pybytes()


def blocks(items: DataFrame) -> Iterator[tuple[list[int | None], list[Counter]]]:
    """(item ids, terms with their repeats) of at most BLOCK_BYTES together (or one larger item), one block after the other."""
    ids: list[int | None] = []
    held: list[Counter] = []
    size = 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        counts = Counter(terms_of((r["text"] or "").encode()))
        own = sum(len(t) + 120 for t in counts)
        if ids and size + own > BLOCK_BYTES:
            yield ids, held
            ids, held, size = [], [], 0
        ids.append(r["item_id"])
        held.append(counts)
        size += own
    if ids:
        yield ids, held


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of documents (doc_id, text) with at least one term: which terms of vocabulary it holds, and how often."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for b in batches:
            rows, n, terms, tfs, edge = [], [], [], [], [0]
            for i, text in enumerate(_texts(b.column(1))):
                words = terms_of(text)
                if not words:
                    continue
                counts = Counter(map(number, words))
                counts.pop(None, None)
                rows.append(i)
                n.append(len(words))
                terms.extend(counts)
                tfs.extend(counts.values())
                edge.append(len(terms))
            at = pa.array(np.array(edge, np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), POSTINGS)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class Shard:
    """The postings of some documents: by term and falling impact, and by term and document."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impact: np.ndarray, size: int):
        self.size = size
        order = np.lexsort((docs, -impact, terms))
        self.docs, self.impact = docs[order], impact[order]
        term = terms[order]
        # groups: postings of one term with one exact impact
        new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (self.impact[1:] != self.impact[:-1])))) if len(term) else np.zeros(0, np.int64)
        self.start = np.concatenate((new, [len(term)]))
        self.group_term, self.group_impact = term[new], self.impact[new]
        key = terms.astype(np.int64) * size + docs
        self.by_doc = np.argsort(key, kind="stable")
        self.key, self.by_doc_impact = key[self.by_doc], impact[self.by_doc]

    def groups(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of every term's groups."""
        return np.searchsorted(self.group_term, terms), np.searchsorted(self.group_term, terms, side="right")

    def completed(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The whole scores of documents."""
        score = np.zeros(len(docs), np.int64)
        for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
            key = t * self.size + docs
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            score += np.where(self.key[at] == key, w * self.by_doc_impact[at], 0)
        return score

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, their whole scores, postings processed): all documents that may be among the k best with a score of least or more.

        weights are those of distinct terms, times their repeats, and above 0.
        """
        lo, hi = self.groups(terms)
        some = hi > lo
        terms, weights, lo, hi = terms[some], weights[some], lo[some], hi[some]
        if not len(terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        count = hi - lo
        owner = np.repeat(np.arange(len(terms)), count)
        group = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(len(owner))
        gain = weights[owner] * self.group_impact[group]
        order = np.argsort(-gain, kind="stable")
        owner, group, gain = owner[order], group[order], gain[order]
        sizes = self.start[group + 1] - self.start[group]
        reach = np.cumsum(sizes)
        score = np.zeros(self.size, np.int64)
        done, look, left = 0, FIRST, count.copy()
        place = np.argsort(owner, kind="stable")  # each term's groups, highest first
        first = np.cumsum(count) - count
        while done < len(group):
            end = min(int(np.searchsorted(reach, look)) + 1, len(group))
            size = sizes[done:end]
            at = np.repeat(self.start[group[done:end]] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            np.add.at(score, self.docs[at], np.repeat(gain[done:end], size))
            left -= np.bincount(owner[done:end], minlength=len(terms))
            done, look = end, 2 * look
            if done == len(group):
                break
            more = left > 0
            beyond = int(gain[place[(first + count - left)[more]]].sum())  # nothing can gain more than every term's next group
            kth = int(np.partition(score, len(score) - k)[len(score) - k]) if len(score) >= k else 0
            if beyond < max(kth, least):  # documents that haven't been met are out
                docs = np.flatnonzero(score + beyond >= max(kth, least, 1))
                if len(docs) <= max(16 * k, int(sizes[done:].sum()) // (4 * len(terms))):  # completing them costs less than going on
                    return docs, self.completed(docs, terms, weights), int(reach[done - 1])
        docs = np.flatnonzero(score >= max(least, 1))
        return docs, score[docs], int(reach[-1])


def _best(docs: np.ndarray, null: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((docs, null, -score))[:k]


def _searcher(shared, k: int, documents: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, total, length = shared.value
        best: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items)
        held: list[pa.RecordBatch] = []

        def take(rows: pa.Table) -> None:
            ids, null = rows["doc_id"].combine_chunks().fill_null(0).to_numpy(), rows["doc_id"].combine_chunks().is_null().to_numpy(False)
            lists = rows["terms"].combine_chunks()
            doc = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
            tf = rows["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
            m = 25 + 75 * rows["n"].to_numpy() * total // length
            shard = Shard(lists.flatten().to_numpy(), doc, 1000000000 * tf // (1000 * tf + 8 * m[doc]), len(ids))
            for i, (terms, times) in enumerate(items):
                w = weights[terms] * times
                d, z, s = best[i]
                docs, score, _ = shard.search(terms[w > 0], w[w > 0], k, int(s[-1]) if len(s) == k else 1)
                if len(docs):
                    d, z, s = np.concatenate((d, ids[docs])), np.concatenate((z, null[docs])), np.concatenate((s, score))
                    top = _best(d, z, s, k)
                    best[i] = d[top], z[top], s[top]

        size = 0
        for b in batches:
            for a in range(0, b.num_rows, documents):
                held.append(b.slice(a, documents))
                size += held[-1].num_rows
                if size >= documents:
                    take(pa.Table.from_batches(held))
                    held, size = [], 0
        if size:
            take(pa.Table.from_batches(held))
        item = np.repeat(np.arange(len(items)), [len(s) for _, _, s in best])
        if len(item):
            d, z, s = (np.concatenate([x[j] for x in best]) for j in range(3))
            yield pa.record_batch([pa.array(item), pa.array(d, mask=z), pa.array(s)], names=["item", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) of highest score above 0 for every item (item_id, text)."""
    spark = docs.sparkSession
    out = None
    for ids, counts in blocks(items):
        vocabulary = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        table = materialize(spark, postings(docs, vocabulary), "postings")
        total, length = table.agg(F.count("*"), F.sum("n")).first()
        if not total:
            break
        df = np.zeros(len(vocabulary), np.int64)
        held = table.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toArrow()  # a row per term of the block at most
        df[held["term"].to_numpy()] = held["df"].to_numpy()
        weights = np.array([weight(total, int(x)) for x in df], np.int64)
        asked = [(np.array([vocabulary[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]
        shared = spark.sparkContext.broadcast((asked, weights, total, length))
        found = table.mapInArrow(released(_searcher(shared, k, SHARD)), "item long, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        name = spark.sparkContext.broadcast(ids)

        def named(batches: Iterator[pa.RecordBatch], name=name) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.record_batch([pa.array([name.value[i] for i in b.column(0).to_pylist()], pa.int64()), *b.columns[1:]], names=["item_id", "rank", "doc_id", "score"])

        found = found.select("item", "rank", "doc_id", "score").mapInArrow(named, "item_id long, rank int, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def oracle(k: int = 10) -> str:
    """The same in DuckDB SQL."""
    words = lambda x: f"unnest(regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""WITH
x AS (SELECT row_number() OVER () AS doc, doc_id, text FROM documents),
t AS (SELECT doc, doc_id, {words("text")} AS term FROM x),
d AS (SELECT doc, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY doc),
c AS (SELECT count(*) AS total, sum(n)::BIGINT AS length FROM d),
p AS (SELECT doc, term, count(*) AS tf FROM t GROUP BY doc, term),
w AS (SELECT term, floor(1000 * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, total),
q AS (SELECT item, item_id, term, count(*) AS times FROM (SELECT item, item_id, {words("text")} AS term FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)) GROUP BY ALL),
s AS (SELECT q.item, q.item_id, d.doc, d.doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * total) // length))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term) JOIN d ON d.doc = p.doc, c GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {k}"""
