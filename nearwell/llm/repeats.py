"""Removal of long repeated passages with a run-length index.

A byte goes if a string of 400 bytes that covers it also starts elsewhere (Measure BYTES); besides, passages of 51 words that stand in
another document too are counted (Measure WORDS, words as in shingles). Both take the same way, over bytes and over words as symbols.

Every string of a measure's length holds an anchor, its leftmost least-hashed gram, at the same place wherever the string stands. So equal
strings meet at equal anchors: the strings of one anchor lie in its context, and contexts meet by their gram. Contexts that are equal are
one class. The classes of a gram (and the one class of a gram that several places share) go to a run-length index, block by block: a
context is its symbols with the gram as a single symbol, as in a prefix-free parse; suffixes are sorted, the Burrows-Wheeler transform is
run-length compressed, and the index keeps its samples at the run ends and the match lengths there only. Streaming through the text gives
every position's longest match with another owner (one less per step until the next sample), equal contexts being a run of twins. What
matches over the whole length is marked in every member of the class.

A gram whose classes are too many for one index has them dealt anew by longer grams, around narrower ranges of strings, until the groups
are small enough. A gram that so many contexts share that they can't go to one task is treated in the same way between tasks; a group of
one class only is a single run of twins then. Such grams are found on a sample (which decides where rows are sent, nothing else) or while
rows stream by.

Defined cases: a null or empty text keeps its no bytes; repeated rows (equal doc_id and text) are copies of one another, as other equal
texts are, for bytes; for words they are one document. Overlapping repetitions within a text count for bytes, and not for words. A null
doc_id is a document like any other; extra columns are ignored. A text is its UTF-8 bytes as Spark holds them. Documents and contexts are
told apart by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, crowded_keys, key_bitmap, materialize, mix64, partitions, released, sorted_runs, text_array, text_slices
from .shingles import powers, word_hashes

HOT = 1 << 15  # contexts of a gram that one task takes
BLOCK = 1 << 16  # symbols that are indexed together, about
CROWD = 1 << 18  # symbols of a gram's classes from which they are dealt anew within the task
WIDTHS = (16, 1)  # strings of a range when a gram's contexts are dealt anew
SAMPLE = 32  # one of so many documents tells which grams are very common


@dataclass(frozen=True)
class Measure:
    """length: symbols of a string; gram: symbols of an anchor; apart: a match must lie in another document."""

    length: int
    gram: int
    apart: bool


BYTES, WORDS = Measure(400, 200, False), Measure(51, 12, True)
ROWS = "key long, cls long, doc long, ats binary, lead int, core int, size int, several boolean"
NAMES = ["key", "cls", "doc", "ats", "lead", "core", "size", "several"]


def _sliding(x: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every w consecutive values: by prefixes and suffixes of blocks of w."""
    pick = np.minimum if least else np.maximum
    n = len(x)
    rows = -(-n // w)
    fill = np.iinfo(x.dtype).max if least else np.iinfo(x.dtype).min
    y = np.full(rows * w, fill, x.dtype)
    y[:n] = x
    y = y.reshape(rows, w)
    ahead = pick.accumulate(y, axis=1).ravel()
    behind = pick.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[: n - w + 1], ahead[w - 1 : n])


def minimisers(h: np.ndarray, w: int) -> np.ndarray:
    """The positions whose hash is the least of some w consecutive ones; equal least ones all count."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    low = _sliding(h, w, True)
    padded = np.concatenate((np.zeros(w - 1, h.dtype), low, np.zeros(w - 1, h.dtype)))
    return np.flatnonzero(_sliding(padded, w, False) == h)


class _Symbols:
    """Polynomial values of any stretch of a slice's symbols, alike wherever the stretch stands."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def value(self, start, stop):
        return (self.sums[stop] - self.sums[start]) * self.down[start]


def _read(data: np.ndarray, offsets: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(symbols as numbers, each text's first symbol and the end)."""
    return word_hashes(data, offsets) if words else (data.astype(np.uint64) + np.uint64(1), offsets)


def _signed(x: np.ndarray, words: bool) -> np.ndarray:
    """Keys of words are negative, so that sorted rows hold one measure after the other."""
    return ((x >> np.uint64(1)) | (np.uint64(words) << np.uint64(63))).view(np.int64)


def _rows(symbols: _Symbols, key: np.ndarray, text: np.ndarray, doc: np.ndarray, first: np.ndarray, start, core, core_stop, stop, apart: bool) -> pa.RecordBatch:
    """ROWS of contexts start .. stop with a core; those of one text that are equal are one row with several places."""
    size, lead = stop - start, core - start
    cls = mix64(symbols.value(start, stop) ^ mix64((lead * 65536 + size + 1).astype(np.uint64))).view(np.int64)
    order = np.lexsort((start, cls, key, text))
    key, cls, text, start, lead, size, span = (x[order] for x in (key, cls, text, start, lead, size, core_stop - core))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]) | (text[1:] != text[:-1])
    one = np.flatnonzero(new)
    many = np.diff(np.concatenate((one, [len(key)])))
    at = (start - first[text]).astype("<i4")
    ats = pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(np.concatenate((one, [len(key)])).astype(np.int32) * np.int32(4)), pa.py_buffer(at)])
    numbers = [pa.array(x[one].astype(np.int32)) for x in (lead, span, size)]
    return pa.record_batch([pa.array(key[one]), pa.array(cls[one]), pa.array(doc[text[one]]), ats, *numbers, pa.array((many > 1) & (not apart))], names=NAMES)


def _anchored(values: np.ndarray, offsets: np.ndarray, doc: np.ndarray, m: Measure, words: bool) -> pa.RecordBatch | None:
    """The contexts of all anchors of a slice's texts: the strings that an anchor has, which are those whose leftmost least gram it is."""
    n, w = len(values), m.length - m.gram + 1
    if n < m.length:
        return None
    symbols = _Symbols(values)
    every = np.arange(n - m.gram + 1)
    h = mix64(symbols.value(every, every + m.gram)) >> np.uint64(1)
    for end in offsets[1:-1].tolist():  # no gram lies across two texts
        h[max(0, end - m.gram + 1) : end] = np.iinfo(np.uint64).max
    p = minimisers(h, w)
    p = p[h[p] != np.iinfo(np.uint64).max]
    if not len(p):
        return None
    v = h[p]
    low, high = p - w + 1, p.copy()
    for t in range(1, min(5, len(p))):  # a near gram that is as low before, or lower behind, has the other strings
        near = p[t:] - p[:-t] < w
        low[t:] = np.where(near & (v[:-t] <= v[t:]), np.maximum(low[t:], p[:-t] + 1), low[t:])
        high[:-t] = np.where(near & (v[t:] < v[:-t]), np.minimum(high[:-t], p[t:] - w), high[:-t])
    text = np.searchsorted(offsets, p, side="right") - 1
    low, high = np.maximum(low, offsets[text]), np.minimum(high, offsets[text + 1] - m.length)
    ok = low <= high
    p, v, text, low, high = (x[ok] for x in (p, v, text, low, high))
    if not len(p):
        return None
    return _rows(symbols, _signed(mix64(v + np.uint64(words)), words), text, doc, offsets[:-1], low, p, p + m.gram, high + m.length, m.apart)


def _keyed(hot: np.ndarray, parts: int):
    """ROWS of texts (doc, text) by both measures, and a salt: those of grams in hot are dealt over so many parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, data, offsets in text_slices(text_array(batch.column(1))):
                for words, m in enumerate((BYTES, WORDS)):
                    out = _anchored(*_read(data, offsets, bool(words)), ids[a:b], m, bool(words))
                    if out is not None:
                        salt = np.where(np.isin(out.column(0).to_numpy(), hot), out.column(2).to_numpy() % parts, 0)
                        yield pa.record_batch([*out.columns, pa.array(salt.astype(np.int32))], names=[*NAMES, "salt"])

    return run


def _finer(width: int):
    """ROWS of (doc, text, asked) for the asked contexts, by ranges of width strings: the core of a range is what all of them share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for i in range(batch.num_rows):
                doc, asked = batch.column(0).slice(i, 1).to_numpy(), lists[i].values
                key, lead, core, size = (asked.field(c).to_numpy() for c in ("key", "lead", "core", "size"))
                ats = asked.field("ats").to_pylist()
                for _, _, data, offsets in text_slices(text_array(batch.column(1).slice(i, 1))):
                    for words, m in enumerate((BYTES, WORDS)):
                        mine = np.flatnonzero((key < 0) == bool(words))
                        if len(mine):
                            values, _ = _read(data, offsets, bool(words))
                            yield _ranges(values, doc, m, bool(words), width, [(key[k], np.frombuffer(ats[k], "<i4"), lead[k], size[k]) for k in mine])

    return run


def _ranges(values: np.ndarray, doc: np.ndarray, m: Measure, words: bool, width: int, contexts: list) -> pa.RecordBatch:
    symbols, out = _Symbols(values), []
    for key, ats, lead, size in contexts:
        lead, size = int(lead), int(size)
        most, least = lead, lead - (size - m.length)  # of a string's way from its start to the core
        for j in range(least // width, most // width + 1):
            near, far = width * j, width * j + width - 1
            for at in ats.tolist():
                p = at + lead
                out.append((key, j, p - min(far, most), p - near, p - far + m.length, p - max(near, least) + m.length))
    key, j, start, core, core_stop, stop = (np.array(c, np.int64) for c in zip(*out, strict=True))
    # the core of an edge range may begin before the text's first string of it
    name = mix64(symbols.value(core, core_stop) ^ mix64(key.view(np.uint64) + j.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    zero = np.zeros(len(key), np.int64)
    return _rows(symbols, _signed(name, words), zero, doc, zero[:1], start, core, core_stop, stop, m.apart)


def _met(hot: np.ndarray, most: int):
    """From ROWS sorted by (key, cls, doc): classes that can match (first: their first member; twin: another member matches it all).

    Of grams in hot, and of those with more than most rows here, every row as it is (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, large in sorted_runs(batches, most):
            key = rows.column(0).to_numpy()
            away = np.full(len(key), True) if large else np.isin(key, hot)
            if away.any():
                some = rows.filter(pa.array(away))
                yield _labelled(some, 1, np.zeros(some.num_rows, bool), np.zeros(some.num_rows, bool))
            if not away.all():
                out = settle(rows.filter(pa.array(~away)))
                if out is not None:
                    yield out

    def settle(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        key, cls, doc = (rows.column(i).to_numpy() for i in range(3))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1]) | (doc[1:] != doc[:-1])
        again = np.zeros(len(key), bool)  # the row of a repeated document
        again[:-1] = ~new[1:]
        several = np.asarray(rows.column(7)) | (again & (key >= 0))
        some = np.flatnonzero(new)
        rows, key, cls, doc, several = rows.take(pa.array(some)), key[some], cls[some], doc[some], several[some]
        opens = np.ones(len(key), bool)
        opens[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        at = np.flatnonzero(opens)
        members = np.diff(np.concatenate((at, [len(key)])))
        twin = (members > 1) | np.logical_or.reduceat(several, at)
        head = np.flatnonzero(np.concatenate(([True], key[at][1:] != key[at][:-1])))  # of keys among classes
        classes = np.diff(np.concatenate((head, [len(at)])))
        place = at[head]
        apart = np.minimum.reduceat(doc, place) != np.maximum.reduceat(doc, place)
        use = np.where(key[place] < 0, apart, (classes > 1) | np.logical_or.reduceat(twin, head))
        use = np.repeat(np.repeat(use, classes), members)
        if not use.any():
            return None
        return _labelled(rows.filter(pa.array(use)), 0, opens[use], np.repeat(twin, members)[use])

    return run


def _labelled(rows: pa.RecordBatch, kind: int, first: np.ndarray, twin: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([*rows.columns, pa.array(np.full(rows.num_rows, kind, np.int8)), pa.array(first), pa.array(twin)], names=[*NAMES, "kind", "first", "twin"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cls, context) of (doc, text, asked): the symbols before and behind the core, bytes or words' hashes."""
    for batch in batches:
        keys, classes, found = [], [], []
        for i in range(batch.num_rows):
            asked = batch.column(2)[i].values
            data = batch.column(1)[i].as_py().encode("utf-8")
            key, cls, lead, core, size = (asked.field(c).to_numpy() for c in ("key", "cls", "lead", "core", "size"))
            at = np.frombuffer(b"".join(asked.field("at").to_pylist()), "<i4")
            whole = None
            for k, a, b, c, d in zip(key.tolist(), at.tolist(), (at + lead).tolist(), (at + lead + core).tolist(), (at + size).tolist(), strict=True):
                if k >= 0:
                    found.append(data[a:b] + data[c:d])
                else:
                    if whole is None:
                        whole = word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0].astype("<u8").tobytes()
                    found.append(whole[8 * a : 8 * b] + whole[8 * c : 8 * d])
            keys.append(key)
            classes.append(cls)
        if found:
            yield pa.record_batch([pa.array(np.concatenate(keys)), pa.array(np.concatenate(classes)), pa.array(found, pa.binary())], names=["key", "cls", "context"])


class RunLengthIndex:
    """What a run-length Burrows-Wheeler transform of several strings holds at the ends of its runs.

    text is the strings' symbols, each string closed by a 0; owner tells whose a string is. A run of the transform goes on while the symbol
    before a suffix is that before its neighbour of another owner. Kept are the samples: text positions at the runs' ends, and how many
    symbols they share with that neighbour. runs counts them; the suffix order itself is given up after the build. upto: each string's last
    position that is asked for (all, if None); no samples are kept behind it.
    """

    def __init__(self, text: np.ndarray, starts: np.ndarray, owner: np.ndarray, upto: np.ndarray | None = None):
        self.text, self.starts, n = text, starts, len(text)
        sizes = np.diff(starts)
        self.left = np.repeat(starts[1:], sizes) - np.arange(n) - 1  # symbols up to the string's end
        order, levels = self._sorted()
        before = np.empty(n, np.int64)
        before[1:] = text[:-1]
        before[starts[:-1]] = -1 - np.arange(len(sizes))  # no symbol stands before a string: a run of its own
        sign, own = before[order], np.repeat(owner, sizes)[order]
        asked = np.ones(n, bool) if upto is None else (np.arange(n) <= np.repeat(upto, sizes))[order]
        new = np.ones(n, bool)
        new[1:] = own[1:] != own[:-1]
        self.samples: list[tuple[np.ndarray, np.ndarray]] = []
        self.runs = 0
        for side in (0, 1):  # the neighbour of another owner before a suffix in order, and the one behind it
            if side == 0:
                other = np.maximum.accumulate(np.where(new, np.arange(n), 0)) - 1
            else:
                last = np.concatenate((new[1:], [True]))
                other = np.minimum.accumulate(np.where(last, np.arange(n), n)[::-1])[::-1] + 1
                other[other == n] = -1
            head = np.flatnonzero(asked & (other >= 0) & (sign != sign[other]))
            a, b = order[head], order[other[head]]
            self.samples.append((a, self._common(a, b, levels)))
            self.runs += len(head)

    def _sorted(self) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The suffix order and, by prefix length, names of all prefixes: several symbols at once, then by doubling what isn't alone yet."""
        n, top = len(self.text), int(self.text.max(initial=0)) + 1
        names, size, base = self.text.astype(np.int64), 1, top
        levels = [(1, names)]
        while size < 4 and base * base < 1 << 62:
            names, size, base = names * base + self._behind(names, size), 2 * size, base * base
            levels.append((size, names))
        order = np.argsort(names)
        rank = np.empty(n, np.int32)
        y = names[order]
        new = np.concatenate((np.ones(min(n, 1), bool), y[1:] != y[:-1]))
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        longest = int(self.left.max(initial=0))
        while size <= longest:
            alone = new & np.concatenate((new[1:], [True]))
            slots = np.flatnonzero(~alone)
            if not len(slots):
                break
            levels.append((size, rank.copy()))
            mine = order[slots]
            at = mine + size
            behind = np.where(self.left[mine] >= size, rank[np.minimum(at, n - 1)].astype(np.int64) + 1, 0)
            x = rank[mine].astype(np.int64) * (n + 1) + behind
            by = np.argsort(x)
            order[slots], x = mine[by], x[by]
            new[slots] = np.concatenate(([True], x[1:] != x[:-1]))
            rank[order[slots]] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[slots]
            size *= 2
        levels.append((size, rank))
        return order, levels

    def _behind(self, names: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros_like(names)
        out[:-size] = np.where(self.left[:-size] >= size, names[size:], 0)
        return out

    def _common(self, a: np.ndarray, b: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
        """Length of the common prefix of suffixes a and b: from the longest prefixes down to single symbols."""
        out, n = np.zeros(len(a), np.int64), len(self.text)
        room = np.minimum(self.left[a], self.left[b])
        for size, names in reversed(levels):
            i, j = np.minimum(a + out, n - 1), np.minimum(b + out, n - 1)
            out += np.where((room - out >= size) & (names[i] == names[j]), size, 0)
        return out

    def reach(self, units: np.ndarray, twins: np.ndarray) -> np.ndarray:
        """For every position, in units, how far its longest match with another owner reaches; all of a string that is among twins.

        units: the units before each position, and their total. Between samples a match goes on with the next position.
        """
        out = np.zeros(len(self.text), np.int64)
        for at, common in self.samples:
            out[at] = np.maximum(out[at], units[at + common])
        first = self.starts[:-1][twins]
        out[first] = units[self.starts[1:][twins] - 1]
        return np.maximum.accumulate(out)


class _Classes:
    """Classes (key, context, lead, core, owner, twin) as one text of symbols: each context with its core as one symbol, closed by a 0."""

    def __init__(self, classes: list[tuple[int, bytes, int, int, int, bool]], words: bool):
        context = np.frombuffer(b"".join(c[1] for c in classes), "<u8" if words else np.uint8)
        sizes = np.array([len(c[1]) // (8 if words else 1) for c in classes], np.int64)
        self.lead = np.array([c[2] for c in classes], np.int64)
        stock, context = np.unique(context, return_inverse=True) if words else (np.arange(256), context)
        group = np.unique(np.array([c[0] for c in classes], np.int64), return_inverse=True)[1]
        self.starts = np.concatenate(([0], np.cumsum(sizes + 2)))
        string = np.repeat(np.arange(len(classes)), sizes)
        place = np.arange(len(context)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.text = np.zeros(self.starts[-1], np.int64)
        self.text[self.starts[:-1][string] + place + (place >= self.lead[string])] = context.astype(np.int64) + 1
        self.at_core = self.starts[:-1] + self.lead
        self.text[self.at_core] = len(stock) + 1 + group
        self.core = np.array([c[3] for c in classes], np.int64)
        self.owner = np.unique(np.array([c[4] for c in classes], np.int64), return_inverse=True)[1]
        self.twin = np.array([c[5] for c in classes], bool)


def marked(classes: list[tuple[int, bytes, int, int, int, bool]], m: Measure, words: bool) -> list[np.ndarray]:
    """Per class the starts of strings, counted from its first symbol, that match with another owner's."""
    c = _Classes(classes, words)
    unit = (c.text > 0).astype(np.int64)
    unit[c.at_core] = c.core
    units = np.concatenate(([0], np.cumsum(unit)))
    # a class that several documents have is an owner by itself, as is every class where a document's own matches count
    number = np.arange(len(classes))
    index = RunLengthIndex(c.text, c.starts, np.where(c.twin, len(classes) + number, c.owner) if m.apart else number, c.at_core)
    at = np.flatnonzero(index.reach(units, np.flatnonzero(c.twin)) - units[:-1] >= m.length)
    which = np.searchsorted(c.starts, at, side="right") - 1
    cut = np.searchsorted(which, np.arange(len(classes) + 1))
    inside = at - c.starts[:-1][which]
    return [inside[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def dealt(classes: list[tuple[int, bytes, int, int, int, bool]], m: Measure, words: bool, widths: tuple[int, ...] = WIDTHS, crowd: int = CROWD) -> list[np.ndarray]:
    """As marked, for the very many classes of a gram: ranges of their strings that share a longer core are classes of their own."""
    c, width, wide = _Classes(classes, words), widths[0], 8 if words else 1
    symbols = _Symbols(mix64(c.text.astype(np.uint64) + np.uint64(7)))
    high = c.lead  # of a string's way from its start to the core
    low = m.length - c.core - (np.diff(c.starts) - c.lead - 2)
    many = high // width - low // width + 1
    k = np.repeat(np.arange(len(classes)), many)
    near = (np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + low[k] // width) * width
    far, base, behind = near + width - 1, c.at_core[k], m.length - c.core[k]
    begin, stop = base - np.minimum(far, high[k]), base + 1 + behind - np.maximum(near, low[k])
    core, core_stop = base - near, base + 1 + np.maximum(behind - far, 0)
    key = mix64(symbols.value(core, core_stop) ^ mix64(near.astype(np.uint64)))
    cls = mix64(symbols.value(begin, stop) ^ mix64(((core - begin) * 65536 + stop - begin + 1).astype(np.uint64)))
    order = np.lexsort((cls, key))
    k, key, cls, begin, stop, core, core_stop = (x[order] for x in (k, key, cls, begin, stop, core, core_stop))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    at = np.flatnonzero(new)
    ends = np.concatenate((at[1:], [len(key)]))
    owner = c.owner[k] if m.apart else np.arange(len(k))
    twin = (np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)) | np.logical_or.reduceat(c.twin[k], at)
    head = np.flatnonzero(np.concatenate(([True], key[at][1:] != key[at][:-1])))  # of keys among classes
    spread = np.minimum.reduceat(owner, at[head]) != np.maximum.reduceat(owner, at[head])
    use = np.flatnonzero(spread | np.logical_or.reduceat(twin, head))
    tails = np.concatenate((head[1:], [len(at)]))
    found: list[list[np.ndarray]] = [[] for _ in classes]

    def settle(some: list[int], of) -> None:
        """Mark classes (by their number) and give the marks to all their members."""
        sub = []
        for i in some:
            a = at[i]
            mine, first = classes[k[a]], c.starts[k[a]]
            x, y, z, e = ((int(v) - int(first)) * wide for v in (begin[a], core[a], core_stop[a] - 1, stop[a] - 1))
            sub.append((int(key[a].view(np.int64)), mine[1][x:y] + mine[1][z:e], int(core[a] - begin[a]), int(c.core[k[a]] + core_stop[a] - core[a] - 1), int(c.owner[k[a]]), bool(twin[i])))
        for i, inside in zip(some, of(sub), strict=True):
            if len(inside):
                for a in range(at[i], ends[i]):
                    found[k[a]].append(inside + (begin[a] - c.starts[k[a]]))

    ready: list[int] = []
    size = 0
    for g in use.tolist():
        group = list(range(head[g], tails[g]))
        own = int((stop[at[group]] - begin[at[group]]).sum())
        if own > crowd and len(widths) > 1:
            settle(group, lambda sub: dealt(sub, m, words, widths[1:], crowd))
            continue
        if ready and size + own > BLOCK:
            settle(ready, lambda sub: marked(sub, m, words))
            ready, size = [], 0
        ready += group
        size += own
    if ready:
        settle(ready, lambda sub: marked(sub, m, words))
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in found]


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans (doc, words, start, stop) from contexts and members sorted by (key, cls, kind), whole keys in blocks of about BLOCK symbols."""
    for rows, _ in sorted_runs(batches):
        key, cls, kind = (rows.column(i).to_numpy() for i in range(3))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
        first, which = np.flatnonzero(new), np.cumsum(new) - 1
        some = np.flatnonzero(kind == 1)
        members, of = rows.take(pa.array(some)), which[some]
        one = np.searchsorted(of, np.arange(len(first)))  # a class has a context, and members
        doc = members.column(4).to_numpy()
        lead, core, owner = (members.column(i).to_numpy()[one].tolist() for i in (6, 7, 4))
        contexts, names = rows.column(3).take(pa.array(first)).to_pylist(), key[first]
        classes = list(zip(names.tolist(), contexts, lead, core, owner, np.asarray(members.column(8))[one].tolist(), strict=True))
        place, many = _places(members.column(5))
        of, doc = np.repeat(of, many), np.repeat(doc, many)
        size = np.cumsum([len(c) // (8 if k < 0 else 1) + 2 for c, k in zip(contexts, names.tolist(), strict=True)])
        heads = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1], [True])))  # of keys, and the end
        at = 0
        while at < len(heads) - 1:
            a = int(heads[at])
            words = bool(names[a] < 0)
            before = int(size[a - 1]) if a else 0
            upto = int(np.searchsorted(size[heads[1:] - 1], before + BLOCK, side="right"))  # keys that end within the block
            if not words:
                upto = min(upto, len(heads) - 1)
            else:
                upto = min(upto, int(np.searchsorted(names[heads[:-1]], 0)))  # words stand before bytes
            at = max(upto, at + 1)
            b = int(heads[at])
            m = WORDS if words else BYTES
            found = (dealt if int(size[b - 1]) - before > CROWD else marked)(classes[a:b], m, words)
            out = _spans(found, a, np.searchsorted(of, (a, b)), of, doc, place, m.length, words)
            if out.num_rows:
                yield out


def _places(ats: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(all places, how many each row has) of a binary column of 32-bit numbers."""
    if not len(ats):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    offsets = np.frombuffer(ats.buffers()[1], np.int32)[ats.offset : ats.offset + len(ats) + 1] // 4
    return np.frombuffer(ats.buffers()[2], "<i4", count=int(offsets[-1]))[offsets[0] :], np.diff(offsets)


def _spans(found: list[np.ndarray], a: int, edge: np.ndarray, of: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int, words: bool) -> pa.RecordBatch:
    """The runs of marked starts of classes a and on, at the places edge of their members."""
    starts = np.concatenate(found)
    cls = np.repeat(np.arange(len(found)), [len(x) for x in found])
    opens = np.ones(len(starts), bool)
    opens[1:] = (cls[1:] != cls[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(opens)
    last = starts[np.concatenate((begin[1:], [len(starts)]))[: len(begin)] - 1] + length
    first = np.searchsorted(cls[begin], np.arange(len(found) + 1))
    mine = slice(int(edge[0]), int(edge[1]))
    c = of[mine] - a
    many = np.diff(first)[c]
    at = np.repeat(first[c] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    base = np.repeat(place[mine], many)
    return pa.record_batch([pa.array(np.repeat(doc[mine], many)), pa.array(np.full(len(at), words)), pa.array((base + starts[begin][at]).astype(np.int32)), pa.array((base + last[at]).astype(np.int32))], names=["doc", "words", "start", "stop"])


def _gone(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """The maximal runs of spans, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        stop = min(stop, size)
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_words long"


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """RESULT of (doc_id, text, spans)."""
    for batch in batches:
        out = []
        for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = (text or "").encode("utf-8")
            gone = _gone([(x["start"], x["stop"]) for x in spans or () if not x["words"]], len(data))
            words = _gone([(x["start"], x["stop"]) for x in spans or () if x["words"]], len(data))
            edges = [0, *(x for s in gone for x in s), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append((doc, len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), sum(b - a for a, b in words)))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])


def _named(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): a hash of both names a document."""
    body = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.xxhash64("doc_id", body).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"))


def _asked(hashed: DataFrame, wanted: DataFrame, run, schema: str) -> DataFrame:
    """run over (doc, text, asked) of the documents that wanted (doc, asked) names; a bitmap keeps most others from the shuffle."""
    bits = key_bitmap(wanted, "doc")
    near = hashed.select("doc", "text").mapInArrow(chosen(bits, "doc"), "doc long, text string")
    return near.join(wanted, "doc").mapInArrow(released(run), schema)


def repeated_spans(docs: DataFrame, most: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """(doc, spans): per document (see _named) an array of (words, start, stop), ranges of bytes and of words that may overlap.

    most: contexts of a gram that one task takes; sample: one of so many documents tells which grams are very common. Both leave the rows alone.
    """
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    hashed = _named(docs)
    long = hashed.select("doc", "text").where(F.octet_length("text") >= 2 * WORDS.length - 1)

    # where to send rows: grams that a sample shows too often for one task
    sampled = long.where(F.pmod(F.col("doc"), F.lit(sample)) == 0).mapInArrow(released(_keyed(np.zeros(0, np.int64), 1)), f"{ROWS}, salt int")
    hot = crowded_keys(sampled, "key", n, most // sample)
    labels = "kind tinyint, first boolean, twin boolean"
    rows = long.mapInArrow(released(_keyed(hot, n)), f"{ROWS}, salt int")
    rows = rows.repartition(n, "key", "salt").sortWithinPartitions("key", "cls", "doc").drop("salt")
    met = materialize(spark, rows.mapInArrow(_met(hot, most), f"{ROWS}, {labels}"), "met")
    members, direct = met.where("kind = 0"), []

    rows = met.where("kind = 1").select(*NAMES)
    for width in WIDTHS:
        if not rows.take(1):
            break
        many = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min("cls").alias("c0"), F.max("cls").alias("c1"), F.max(F.col("several").cast("int")).alias("twice"))
        # repeated rows of a document count as copies for bytes only
        many = many.where((F.col("d0") != F.col("d1")) | ((F.col("key") >= 0) & ((F.col("twice") > 0) | (F.col("n") > 1))))
        many = materialize(spark, many.select("key", "n", (F.col("c0") == F.col("c1")).alias("one")), "common")
        rows = materialize(spark, rows.join(many, "key"), "crowd")
        direct.append(rows.where("one").select("doc", "key", "ats", "size"))
        few = rows.where(f"not one and n <= {most}").select(*NAMES).repartition(n, "key").sortWithinPartitions("key", "cls", "doc")
        members = members.unionByName(materialize(spark, few.mapInArrow(_met(np.zeros(0, np.int64), most), f"{ROWS}, {labels}"), "few"))
        wanted = rows.where(f"not one and n > {most}").groupBy("doc").agg(F.collect_list(F.struct("key", "lead", "core", "size", "ats")).alias("asked"))
        wanted = materialize(spark, wanted, "wanted")
        rows = materialize(spark, _asked(hashed, wanted, _finer(width), ROWS), "finer")
    else:  # single strings: whatever a gram's rows are, they are equal
        many = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.max(F.col("several").cast("int")).alias("twice"))
        many = many.where((F.col("d0") != F.col("d1")) | ((F.col("key") >= 0) & ((F.col("twice") > 0) | (F.col("n") > 1)))).select("key")
        direct.append(rows.join(many, "key").select("doc", "key", "ats", "size"))

    asked = members.where("first").select("doc", F.struct("key", "cls", F.expr("substring(ats, 1, 4)").alias("at"), "lead", "core", "size").alias("x"))
    asked = materialize(spark, asked.groupBy("doc").agg(F.collect_list("x").alias("asked")), "asked")
    contexts = _asked(hashed, asked, _contexts, "key long, cls long, context binary")
    none = F.lit(None)
    contexts = contexts.select("key", "cls", F.lit(0).alias("kind"), "context", none.cast("long").alias("doc"), none.cast("binary").alias("ats"), none.cast("int").alias("lead"), none.cast("int").alias("core"), none.cast("boolean").alias("twin"))
    both = contexts.unionByName(members.select("key", "cls", F.lit(1).alias("kind"), none.cast("binary").alias("context"), "doc", "ats", "lead", "core", "twin"))
    both = both.repartition(n, "key").sortWithinPartitions("key", "cls", "kind")
    spans = both.mapInArrow(released(_indexed), "doc long, words boolean, start int, stop int")
    for crowd in direct:
        spans = spans.unionByName(crowd.mapInArrow(_whole, "doc long, words boolean, start int, stop int"))
    spans = spans.groupBy("doc").agg(F.collect_set(F.struct("words", "start", "stop")).alias("spans"))
    return materialize(spark, spans, "spans")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of (doc, key, ats, size): the whole context at each of its places."""
    for batch in batches:
        at, many = _places(batch.column(2))
        doc, key, size = (np.repeat(batch.column(i).to_numpy(), many) for i in (0, 1, 3))
        yield pa.record_batch([pa.array(doc), pa.array(key < 0), pa.array(at.astype(np.int32)), pa.array((at + size).astype(np.int32))], names=["doc", "words", "start", "stop"])


def removed(docs: DataFrame, most: int = HOT, sample: int = SAMPLE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs, and n_passage_words: words of passages of 51 words or more that another document has too."""
    spans = repeated_spans(docs, most, sample)
    bits, rows = key_bitmap(spans, "doc"), _named(docs)
    others = chosen(bits, "doc", False)

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _kept(pa.record_batch([b.column(1), b.column(2), pa.nulls(b.num_rows)], names=["doc_id", "text", "spans"]) for b in others(batches))

    near = rows.mapInArrow(chosen(bits, "doc"), "doc long, doc_id long, text string").join(spans, "doc", "left").select("doc_id", "text", "spans")
    return near.mapInArrow(_kept, RESULT).unionByName(rows.mapInArrow(plain, RESULT))
