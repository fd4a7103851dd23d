"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams (1 to 3, words padded by a blank) of a language; a text is given to the language whose
profile is nearest in out-of-place distance: the sum, over the text's own most frequent n-grams, of how far each stands from its rank in
the profile, with a fixed penalty where the profile lacks it.

Defined cases: a null, empty or letterless text is `und` with score 0; without any labelled row every text is `und`; equal distances go to
the first language in alphabetical order; equal counts rank by n-gram length, then code points. Rows may repeat; very long texts are read
whole; extra columns pass through, but those called lang_pred and score give way to the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, materialize, released

PROFILE = 400  # n-grams kept for a language
TOP = 300  # n-grams kept for a text
MAX_LANGUAGES = 2000  # bound of the profiles' table: MAX_LANGUAGES * PROFILE rows
UNDETERMINED = "und"

_letter: list[np.ndarray] = []


def letters() -> np.ndarray:
    """True for the code points that are letters."""
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES // 2:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters as small codes (0: anything else, runs of it collapsed), the code points in the codes' order, and each text's first index."""
    parts = [" " + t.lower() for t in texts]
    points = np.frombuffer(("".join(parts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[points]
    present = np.zeros(0x110000, bool)
    present[points[is_letter]] = True
    alphabet = np.flatnonzero(present)
    code = np.zeros(0x110000, np.int32)
    code[alphabet] = np.arange(1, len(alphabet) + 1, dtype=np.int32)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    rank = np.concatenate(([0], np.cumsum(keep)))
    # a blank that opens a text may have been collapsed into the one before it: the text then starts at that one
    first = np.where(keep[np.minimum(starts, len(keep) - 1)], rank[starts], rank[starts] - 1)
    first[-1] = rank[-1] - 1 if len(rank) > 1 else 0
    return np.where(is_letter, code[points], 0)[keep], alphabet, np.maximum(first, 0)


def _grams(c: np.ndarray, k: int) -> np.ndarray:
    """The n-grams of one text as numbers: length 1, 2 and 3 in that order, each by code points; k is the alphabet's size plus 1."""
    c = c.astype(np.int64)
    one = c[c > 0]
    a, b = c[:-1], c[1:]
    two = k + (a * k + b)[(a > 0) | (b > 0)]
    m = c[1:-1] > 0
    three = k + k * k + ((c[:-2] * k + c[1:-1]) * k + c[2:])[m]
    return np.concatenate((one, two, three))


def _packed(g: np.ndarray, alphabet: np.ndarray, k: int) -> np.ndarray:
    """Numbers that don't depend on the alphabet at hand: three fields of 21 bits, the first holding length and the order kept."""
    points = np.concatenate(([0], alphabet)).astype(np.int64)
    out = np.empty(len(g), np.int64)
    one, three = g < k, g >= k + k * k
    two = ~one & ~three
    out[one] = points[g[one]]
    x = g[two] - k
    out[two] = (1 << 42) | points[x // k] << 21 | points[x % k]
    x = g[three] - k - k * k
    # code points end below 2**21 - 2**16, so that this field never meets the markers 0 and 1 of the shorter ones
    out[three] = (points[x // (k * k)] + 2) << 42 | points[x // k % k] << 21 | points[x % k]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, dict[int, int]] = {}
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        texts = batch.column(0).to_pylist()
        for lang in sorted(set(langs)):
            mine = [texts[i] for i in np.flatnonzero(langs == lang)]
            for a, b in _slices(mine):
                c, alphabet, _ = _coded(mine[a:b])
                k = len(alphabet) + 1
                g = _grams(c, k)
                if k + k * k + k**3 <= 1 << 22:
                    counts = np.bincount(g)
                    u = np.flatnonzero(counts)
                    counts = counts[u]
                else:
                    u, counts = np.unique(g, return_counts=True)
                into = total.setdefault(lang, {})
                for x, y in zip(_packed(u, alphabet, k).tolist(), counts.tolist(), strict=True):
                    into[x] = into.get(x, 0) + y
            if len(total.get(lang, ())) > 200_000:
                yield _counted(lang, total.pop(lang))
    for lang, into in total.items():
        yield _counted(lang, into)


def _counted(lang: str, into: dict[int, int]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([lang] * len(into), pa.string()), pa.array(list(into), pa.int64()), pa.array(list(into.values()), pa.int64())], names=["lang", "gram", "n"])


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE, max_languages: int = MAX_LANGUAGES) -> dict[str, list[int]]:
    """Profiles {language: n-grams, most frequent first} counted over all labelled rows; rows with a null text or label teach nothing.

    The result has at most max_languages * profile entries; more languages raise an error.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(released(_count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialize(labelled.sparkSession, counts, "grams")
    names = [r[0] for r in counts.groupBy("lang").count().orderBy("lang").limit(max_languages + 1).select("lang").collect()]
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")  # limited before the shuffle as well
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= profile)
    out: dict[str, list[int]] = {x: [] for x in names}
    for r in best.orderBy("lang", "rank").select("lang", "gram").collect():
        out[r["lang"]].append(r["gram"])
    return out


def _predictor(profiles: dict[str, list[int]], top: int):
    names = sorted(profiles)
    known = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
    penalty = max([top, *map(len, profiles.values())])
    ranks = np.full((len(known) + 1, len(names)), -1, np.int64)
    for j, name in enumerate(names):
        ranks[np.searchsorted(known, np.array(profiles[name], np.int64)), j] = np.arange(len(profiles[name]))

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not names:
            return lang, score
        texts = [t or "" for t in texts]
        for a, b in _slices(texts):
            c, alphabet, first = _coded(texts[a:b])
            k = len(alphabet) + 1
            for i in range(b - a):
                g = np.sort(_grams(c[first[i] : first[i + 1] + 1], k))
                if not len(g):
                    continue
                edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
                u, n = g[edge[:-1]], np.diff(edge)
                if len(u) > top:
                    least = np.partition(n, len(n) - top)[len(n) - top]
                    m = n >= least
                    u, n = u[m], n[m]
                u = _packed(u[np.argsort(-n, kind="stable")[:top]], alphabet, k)
                at = np.searchsorted(known, u)
                at[at == len(known)] = 0
                r = ranks[np.where(known[at] == u, at, len(known))]
                d = np.where(r < 0, penalty, np.minimum(np.abs(r - np.arange(len(u))[:, None]), penalty)).sum(axis=0)
                j = int(d.argmin())
                lang[a + i], score[a + i] = names[j], 1.0 - float(d[j]) / (penalty * len(u))
        return lang, score

    return predict


def predict(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", top: int = TOP, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with lang_out (a profile's name or `und`) and score_out (1 minus the distance's share of the largest possible one)."""
    docs = docs.drop(lang_out, score_out)
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = _predictor(shared.value, top)
        for batch in batches:
            lang, score = say(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, lang_out, score_out])

    return docs.mapInArrow(released(run), schema)


def identify(docs: DataFrame, profile: int = PROFILE, top: int = TOP) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learnt from the labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    A null doc_id counts as held out.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))
    profiles = fit(docs.where(~held), profile=profile)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), profiles, top=top).drop("text")
