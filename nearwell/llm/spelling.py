"""Spelling variants by anagram hashing.

A word's anagram key is the sum of a power of each of its letters, so it says which letters a word has but not in which order. Two words
that differ by one letter added or removed have keys that differ by that letter's value, and two that differ by one letter exchanged have
keys that differ by the difference of two values. Each word is therefore listed under its own key and under its key less each of its
letters: a word and one with a letter more meet under the smaller key, two words with a letter exchanged meet under what they have left.
The order of letters is verified within a key: removing a letter's places one by one gives remainders, which meet by (hash, place) in a
sort and are then compared letter by letter. What meets there differs in the one letter at that place, so a word has at most as many
partners there as there are letters; pairs of a key are never listed. A key with more than CROWDED rows (very many words of the same
letters) is dealt over tasks by what its remainders hash to.

Counting comes first: runs of letters are counted per document by each task and added up before they are shuffled. A word's roots are
found by pointer jumping over its forms: a form has at least twice the occurrences of its word, so chains are short.

Defined cases: a null text has no words; a null doc_id counts as an empty one; repeated rows count again; an empty table gives no rows;
other columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix64, partitions, released, text_array
from .shingles import powers

LEAST_LENGTH, LEAST_COUNT = 5, 3
MISSPELT = 97  # one of so many (document, run) pairs is given an error
DOMINANT = 2  # a form occurs so many times as often as its word
POWER = 5
COUNTED = 1 << 18  # words that a task counts before it hands them on
KEY_BYTES = 4 << 20  # bytes of words whose remainders are compared at a time
CROWDED = 1 << 15  # rows of a key that one task takes
SHARES = 64  # groups that a crowded key is dealt into
_RUNS = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")  # of UTF-8, once A-Z are lower-cased: a-z and U+00C0 to U+00FF
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_PLAIN = bytes(range(128)) + bytes(range(0x80, 0xC0)) + b"\xc3"
_DIVIDED = bytes(32 if c < 128 and not chr(c).isalpha() else _LOWER[c] for c in range(256))


def runs(text: bytes) -> list[bytes]:
    """The maximal runs of letters in UTF-8 text, A-Z lower-cased."""
    if not text.translate(None, _PLAIN):  # U+00C0 to U+00FF are the only signs beyond ASCII: what divides runs is ASCII
        return text.translate(_DIVIDED).split()
    return _RUNS.findall(text.translate(_LOWER))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) from (doc_id as text, text): words of LEAST_LENGTH letters or more, with the errors that the data set defines."""
    total: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        words = {w.decode(): n for w, n in total.items() if n and len(w) >= LEAST_LENGTH}
        words = {w: n for w, n in words.items() if len(w) >= LEAST_LENGTH}
        total.clear()
        return pa.record_batch([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    crc = zlib.crc32
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), text_array(b.column(1)), strict=True):
            found = runs(text.as_buffer().to_pybytes())
            total.update(found)
            start = crc(f"{doc or ''}:".encode())
            wrong = [r for r in set(found) if not crc(r, start) % MISSPELT]
            times = Counter(found) if len(wrong) > 20 else {r: found.count(r) for r in wrong}
            for r in wrong:
                points = r.decode()
                at = crc(r, start) % len(points)
                total[r] -= times[r]
                total[(points[:at] + points[at + 1 :]).encode()] += times[r]
            if len(total) > COUNTED:
                yield out()
    if total:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of documents (doc_id, text): words that occur LEAST_COUNT times or more."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text"))
    counts = rows.mapInArrow(released(_counted), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the code points of all words, where each begins and the end)."""
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    return points, np.concatenate(([0], np.cumsum(pc.utf8_length(words).to_numpy().astype(np.int64))))


def _letter_sums(points: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the value of every letter, the sum of every word's), modulo 2**64."""
    value = points.astype(np.uint64) ** np.uint64(POWER)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    return value, total[edge[1:]] - total[edge[:-1]]


def _remainders(points: np.ndarray, edge: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The hash of word number of less its letter at the place at (of all points); where at lies behind the word, of the whole word."""
    up, down = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points.astype(np.uint64) * up[: len(points)], out=sums[1:])
    a, z = edge[of], edge[of + 1]
    behind = np.minimum(at + 1, z)
    return mix64(((sums[at] - sums[a]) + (sums[z] - sums[behind]) * down[1]) * down[a])


LISTED = "key long, share int, letter int, place int, word string, n long"


def _lister(crowded):
    """(key, share, letter, place, word, n) from (word, n): the word under its own key (letter 0), and under its key less each letter that it
    has. Under a crowded key there is a row per place of the letter, with the share of what is left there; elsewhere one for all (-1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            points, edge = letters(b.column(0))
            _, own = _letter_sums(points, edge)
            word = np.repeat(np.arange(b.num_rows), np.diff(edge))
            each = np.unique(word.astype(np.uint64) << np.uint64(32) | points)  # the letters of each word, once
            row, letter = (each >> np.uint64(32)).astype(np.int64), (each & np.uint64(0xFFFFFFFF)).astype(np.int64)
            rows, letter = np.concatenate((np.arange(b.num_rows), row)), np.concatenate((np.zeros(b.num_rows, np.int64), letter))
            key = (own[rows] - letter.astype(np.uint64) ** np.uint64(POWER)).view(np.int64)
            share, place = np.zeros(len(rows), np.int64), np.full(len(rows), -1)
            if len(crowded.value):
                many = np.isin(key, crowded.value)
                whole = np.flatnonzero(many & (letter == 0))
                share[whole] = (_remainders(points, edge, edge[rows[whole] + 1], rows[whole]) % np.uint64(SHARES)).astype(np.int64)
                at = np.arange(len(points))
                less = (own[word[at]] - points[at].astype(np.uint64) ** np.uint64(POWER)).view(np.int64)
                at, less = at[np.isin(less, crowded.value)], less[np.isin(less, crowded.value)]
                kept = np.flatnonzero(~many | (letter == 0))
                rows, letter, key = (np.concatenate((x[kept], y)) for x, y in ((rows, word[at]), (letter, points[at].astype(np.int64)), (key, less)))
                share = np.concatenate((share[kept], (_remainders(points, edge, at, word[at]) % np.uint64(SHARES)).astype(np.int64)))
                place = np.concatenate((place[kept], at - edge[word[at]]))
            small = [pa.array(x.astype(np.int32)) for x in (share, letter, place)]
            yield pa.record_batch([pa.array(key), *small, b.column(0).take(pa.array(rows)), b.column(1).take(pa.array(rows))], names=["key", "share", "letter", "place", "word", "n"])

    return run


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and share, some whole groups at a time: about KEY_BYTES, and more only where one group has more."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for b in batches:
        if not b.num_rows:
            continue
        key, share = b.column(0).to_numpy(), b.column(1).to_numpy()
        edge = np.flatnonzero((key[1:] != key[:-1]) | (share[1:] != share[:-1])) + 1
        if held and size > KEY_BYTES:
            if (key[0], share[0]) != last:
                yield pa.concat_batches(held)
                held, size = [], 0
            elif len(edge):
                yield pa.concat_batches([*held, b.slice(0, int(edge[-1]))])
                held, size, b = [], 0, b.slice(int(edge[-1]))
        held.append(b)
        size += b.nbytes
        last = (key[-1], share[-1])
    if held:
        yield pa.concat_batches(held)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n, near, n_near, best_n, best): for each word of a key how many near words it meets there, and the most frequent of them."""
    for b in _whole_keys(batches):
        words, n = b.column(4), b.column(5).to_numpy()
        found = _links(*(b.column(i).to_numpy() for i in range(4)), words)
        if not len(found):
            continue
        left, right = words.take(pa.array(found[:, 0])).to_pylist(), words.take(pa.array(found[:, 1])).to_pylist()
        met: dict[str, list] = {}
        for w, x, a, z in zip(left, right, n[found[:, 0]].tolist(), n[found[:, 1]].tolist(), strict=True):
            for one, k, other, m in ((w, a, x, z), (x, z, w, a)):
                if (e := met.get(one)) is None:
                    met[one] = [k, 1, m, other]
                else:
                    e[1] += 1
                    if m > e[2] or m == e[2] and other < e[3]:
                        e[2:] = m, other
        yield pa.record_batch([pa.array(list(met), pa.string()), *(pa.array([e[i] for e in met.values()], pa.int64()) for i in (0, 1, 2)), pa.array([e[3] for e in met.values()], pa.string())], names=["word", "n", "n_near", "best_n", "best"])


def _links(key: np.ndarray, share: np.ndarray, letter: np.ndarray, place: np.ndarray, words: pa.Array) -> np.ndarray:
    """(row, row) of near words that meet under a key, each pair once; rows are sorted by key and share."""
    points, edge = letters(words)
    row = np.repeat(np.arange(len(words)), np.diff(edge))
    group = np.cumsum(np.concatenate(([True], (key[1:] != key[:-1]) | (share[1:] != share[:-1]))))
    salt = mix64(group.astype(np.uint64))
    at = np.flatnonzero((points == letter[row]) & ((place[row] < 0) | (place[row] == np.arange(len(points)) - edge[row])))
    of = row[at]
    place = at - edge[of]
    rest = mix64(_remainders(points, edge, at, of) + salt[of])
    whole = np.flatnonzero(letter == 0)
    full = mix64(_remainders(points, edge, edge[whole + 1], whole) + salt[whole])
    text = points.tobytes()
    cut = lambda i, p: text[4 * edge[i] : 4 * (edge[i] + p)] + text[4 * (edge[i] + p + 1) : 4 * edge[i + 1]]
    out = []
    # a letter more: a remainder that is a word; of a run of equal letters the first is taken, as all of them leave the same
    order = np.argsort(full, kind="stable")
    lo, hi = np.searchsorted(full[order], rest), np.searchsorted(full[order], rest, side="right")
    first = (place == 0) | (points[at] != points[at - 1])
    for j in np.flatnonzero(first & (hi > lo)).tolist():
        for i in whole[order[lo[j] : hi[j]]].tolist():
            if group[i] == group[of[j]] and cut(int(of[j]), int(place[j])) == text[4 * edge[i] : 4 * edge[i + 1]]:
                out.append((int(of[j]), i))
    # a letter exchanged: equal remainders at one place
    mark = mix64(rest + place.astype(np.uint64))
    order = np.argsort(mark, kind="stable")
    bound = np.flatnonzero(np.concatenate(([True], mark[order][1:] != mark[order][:-1], [True])))
    for a, z in zip(bound[:-1][np.diff(bound) > 1].tolist(), bound[1:][np.diff(bound) > 1].tolist(), strict=True):
        some = order[a:z].tolist()
        same: dict[tuple, list[int]] = {}
        for j in some:
            same.setdefault((int(group[of[j]]), int(place[j]), cut(int(of[j]), int(place[j]))), []).append(int(of[j]))
        for members in same.values():
            out.extend((x, y) for k, x in enumerate(members) for y in members[k + 1 :])
    return np.array(out, np.int64).reshape(-1, 2)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of (word, n): how many words are near, and the most frequent of them (ties: the least)."""
    spark = words.sparkSession
    listed = lambda keys: words.select("word", "n").mapInArrow(_lister(spark.sparkContext.broadcast(keys)), LISTED)
    often = listed(np.zeros(0, np.int64)).groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > CROWDED)
    crowded = np.array([r["key"] for r in often.collect()], np.int64)  # one for every CROWDED rows at most
    sorted_keys = listed(crowded).repartition(partitions(spark), "key", "share").sortWithinPartitions("key", "share")
    met = sorted_keys.mapInArrow(released(_near), "word string, n long, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form that a word's forms lead to. Every step doubles the reach of all words at once."""
    reach = materialize(spark, forms.select("word", F.col("form").alias("root")), "reach")
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = reach.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = materialize(spark, moved, "reach")
        reach = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return reach


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of documents (doc_id, text)."""
    spark = docs.sparkSession
    words = materialize(spark, vocabulary(docs), "words")
    found = materialize(spark, words.join(near_words(words), "word", "left"), "near")
    is_form = F.col("best_n") >= DOMINANT * F.col("n")
    forms = found.where(is_form).select("word", F.col("best").alias("form"))
    out = found.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n"))
    out = out.join(roots(spark, forms), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """The same in DuckDB SQL: words are near that leave the same when a letter is taken away, at one place, or of one of them only."""
    upper, lower = (bytes(range(a, a + 26)).decode() for a in (65, 97))
    return f"""WITH RECURSIVE
c AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(i))),
t AS (SELECT doc, run, count(*) AS k FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{upper}', '{lower}') AS run FROM documents) GROUP BY doc, run),
p AS (SELECT doc || ':' || run AS key, run, k FROM t),
b AS (SELECT run, k, flatten(list_transform(string_split(key, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [(192 + (unicode(s) >> 6))::BIGINT, (128 + (unicode(s) & 63))::BIGINT] END)) AS bytes FROM p),
h AS (SELECT run, k, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda x, y: xor(x >> 8, crc[(xor(x, y) & 255) + 1])), 4294967295) AS h FROM b, c),
o AS (SELECT CASE WHEN h % {MISSPELT} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM o WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
d AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
l AS (SELECT a.word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON w.word = d.rest UNION SELECT w.word, d.word, d.n FROM d JOIN w ON w.word = d.rest),
s AS (SELECT word, count(*) AS n_near, max(m) AS best_n FROM l GROUP BY word),
g AS (SELECT s.word, s.n_near, s.best_n, min(l.near) AS best FROM s JOIN l ON l.word = s.word AND l.m = s.best_n GROUP BY ALL),
f AS (SELECT w.word, CASE WHEN best_n >= {DOMINANT} * n THEN best END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= {DOMINANT} * n THEN best_n END::BIGINT AS form_n FROM w LEFT JOIN g ON g.word = w.word),
r AS (SELECT word, word AS at FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.at AS root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT r.word, r.at FROM r JOIN f ON f.word = r.at WHERE f.form IS NULL) e ON e.word = f.word"""
