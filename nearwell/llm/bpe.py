"""Byte-level BPE encoding and decoding by DuckDB recursive queries.

A text is cut into pieces by the tokenizer's pattern (a vectorised scan over Unicode classes). The distinct pieces of a batch that the
worker has not met before go to DuckDB: their token positions are joined to the merge table, the leftmost pair of least rank of every
piece is contracted, and a recursive query repeats that until no pair joins. Decoding joins token ids to their bytes and concatenates
them by ordered aggregation.

A long piece is first cut between bytes that stand side by side in no token: nothing can be merged across, so the parts are words of their
own. What is still long is contracted by a second recursive query that takes all pairs of the least rank in one step, from the left, up to
the first that would make a pair of lower rank with its neighbours. Both give what one contraction at a time gives.

Defined cases: a null text counts as empty and has no tokens; rows may repeat; other columns pass through, but those with the name of a
column that is added (ids, n_tokens, ids_sha256, decoded_sha256, decoded) give way to it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, released, text_array, text_slices
from .shingles import powers

#: Distinct pieces that one recursive query takes, bytes of those that a worker remembers, and tokens from which a word counts as long.
PIECES = 32_000
SYMBOLS = 1 << 19  # bytes of words that one recursive query takes; a quarter of them if they are long, and half as many ids to decode
REMEMBERED_BYTES = 64 << 20
LONG = 64
MEMORY_MB = 96  # of a worker's DuckDB; one very long word gets more
#: Characters of text that are cut at a time, and bytes of those whose new pieces are encoded together.
PART_CHARS = 1 << 18
GROUP_CHARS = 1 << 20

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
#: The contractions of the splitting pattern.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

_classes: list[np.ndarray] = []
_engines: dict[str, Engine] = {}


def classes() -> np.ndarray:
    """The class of every code point (letter, number, white space or other), as tiktoken's own patterns see it."""
    if not _classes:
        import tiktoken

        table = np.full(0x110000, _OTHER, np.uint8)
        probes = [(tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={}), kind) for pattern, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _SPACE))]
        for at in range(0, len(table), 1 << 14):
            some = "".join(chr(c) for c in range(at, at + (1 << 14)) if not 0xD800 <= c < 0xE000)
            for probe, kind in probes:
                found = bytes(probe.encode_ordinary(some)).decode("utf-8")
                table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
        _classes.append(table)
    return _classes[0]


def _hashes(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every piece, from prefix sums of polynomials modulo 2**64."""
    up, down = powers(len(points))
    x = points.astype(np.uint64) + np.uint64(1)
    out = []
    for value in (x, mix64(x)):
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value * up[: len(points)], out=sums[1:])
        out.append(mix64((sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]]))
    return out[0], out[1]


def split_many(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(all texts joined, where pieces begin and the end, the index of each text's first piece).

    Pieces are contractions, runs of letters, numbers or other signs with one blank before them, and white space.
    """
    joined = "".join(texts)
    n = len(joined)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    if n == 0:
        return joined, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[points]
    opens = np.zeros(n + 1, bool)
    opens[bounds] = True
    begins = opens[:-1].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(begins)
    ends = np.concatenate((starts[1:], [n]))
    space = kind[starts] == _SPACE
    # white space before another run of its text gives up its last sign: a blank joins that run, anything else stands alone
    before = space & ~opens[ends]
    joins = before & (points[ends - 1] == 0x20)
    moved = np.zeros(len(starts), bool)
    moved[1:] = joins[:-1]
    whole = ~before | (ends - starts > 1)
    at = np.concatenate((starts[whole] - moved[whole], (ends - 1)[before & ~joins]))
    apart = np.flatnonzero((points[starts] == 0x27) & ~space & ~moved & (ends - starts == 1) & ~opens[ends])
    gone, new = [], []
    for k in apart.tolist():
        a, b = int(starts[k + 1]), int(ends[k + 1])
        for c in CONTRACTIONS if kind[a] == _LETTER else ():
            if joined.startswith(c, a) and a + len(c) <= b:
                gone.append(a)
                new.extend([a + len(c)] * (a + len(c) < b))
                break
    if gone:
        at = np.concatenate((at[~np.isin(at, gone)], np.array(new, np.int64)))
    at = np.concatenate((np.sort(at), [n]))
    return joined, at, np.searchsorted(at, bounds)


def split(text: str) -> list[str]:
    """The pieces of one text."""
    joined, at, _ = split_many([text])
    return [joined[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def unify(parts: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[list[str], np.ndarray]:
    """The distinct pieces of split_many's results and, for every piece in order, its index among them."""
    hashes = [_hashes(np.frombuffer(j.encode("utf-32-le", "surrogatepass"), np.uint32), at) for j, at, _ in parts]
    h, check = (np.concatenate([x[i] for x in hashes]) for i in (0, 1))
    order = np.argsort(h)
    h, check = h[order], check[order]
    new = np.concatenate((np.ones(min(len(h), 1), bool), h[1:] != h[:-1]))
    if (~new[1:] & (check[1:] != check[:-1])).any():  # two pieces with one hash: tell them apart as strings
        pieces = [j[a:b] for j, at, _ in parts for a, b in zip(at.tolist(), at.tolist()[1:], strict=False)]
        distinct = {p: i for i, p in enumerate(dict.fromkeys(pieces))}
        return list(distinct), np.array([distinct[p] for p in pieces], np.int64)
    index = np.empty(len(h), np.int32)
    index[order] = np.cumsum(new) - 1
    at = order[new]
    edges = np.concatenate(([0], np.cumsum([len(x[0]) for x in hashes])))
    part = np.searchsorted(edges, at, side="right") - 1
    out: list[str] = [""] * len(at)
    for k, (joined, cut, _) in enumerate(parts):
        mine = np.flatnonzero(part == k)
        first = at[mine] - edges[k]
        for i, a, b in zip(mine.tolist(), cut[first].tolist(), cut[first + 1].tolist(), strict=True):
            out[i] = joined[a:b]
    return out, index


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class Engine:
    """A DuckDB connection with the vocabulary and its merge table, and the pieces encoded so far."""

    #: Keyed by word: a step replaces the tokens of the words that it contracts, and only those are looked at by the next.
    ENCODE = """
        WITH RECURSIVE bpe(w, toks) USING KEY (w) AS (
            SELECT w, toks FROM words
            UNION
            SELECT s.w, s.toks[:b.i - 1] || [b.m] || s.toks[b.i + 2:]
            FROM bpe s
            JOIN (
                SELECT w, (best // 16777216)::INTEGER AS m, best % 16777216 AS i
                FROM (
                    SELECT p.w, min(merges.m::BIGINT * 16777216 + p.i) AS best
                    FROM (SELECT w, unnest(toks) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks, 1) AS i FROM bpe) p
                    JOIN merges ON merges.pair = p.l::BIGINT * 4194304 + p.r
                    GROUP BY p.w
                )
            ) b ON b.w = s.w
        )
        SELECT w, toks FROM bpe ORDER BY w
    """
    ENCODE_LONG = """
        WITH RECURSIVE bpe(w, toks) USING KEY (w) AS (
            SELECT w, toks FROM words
            UNION
            SELECT p.w, list(coalesce(c.m, p.l) ORDER BY p.i) FILTER (WHERE NOT coalesce(d.gone, false))
            FROM (SELECT w, unnest(toks) AS l, generate_subscripts(toks, 1) AS i FROM bpe) p
            LEFT JOIN {chosen} c ON c.w = p.w AND c.i = p.i
            LEFT JOIN (SELECT w, i + 1 AS i, true AS gone FROM {chosen}) d ON d.w = p.w AND d.i = p.i
            GROUP BY p.w
            HAVING count(c.m) > 0
        )
        SELECT w, toks FROM bpe ORDER BY w
    """
    #: The contractions of a step: pairs of a word's least rank, every other of a run of overlapping ones, up to the first that makes a pair of lower rank.
    CHOSEN = """(
        SELECT w, i, m FROM (
            SELECT w, i, m, i - min(i) OVER (PARTITION BY w, run) AS inside, min(CASE WHEN lower THEN i END) OVER (PARTITION BY w) AS stop
            FROM (
                SELECT p.w, p.i, p.m, p.i - row_number() OVER (PARTITION BY p.w ORDER BY p.i) AS run,
                    coalesce(a.m < p.m, false) OR coalesce(b.m < p.m, false) OR coalesce(c.m < p.m, false) AS lower
                FROM (
                    SELECT p.*, merges.m, min(merges.m) OVER (PARTITION BY p.w) AS least
                    FROM (SELECT w, unnest([-1] || toks) AS x, unnest(toks) AS l, unnest(toks[2:]) AS r, unnest(toks[3:]) AS y, generate_subscripts(toks, 1) AS i FROM bpe) p
                    JOIN merges ON merges.pair = p.l::BIGINT * 4194304 + p.r
                ) p
                LEFT JOIN merges a ON a.pair = p.x::BIGINT * 4194304 + p.m
                LEFT JOIN merges b ON b.pair = p.m::BIGINT * 4194304 + p.y
                LEFT JOIN merges c ON c.pair = p.m::BIGINT * 4194304 + p.m
                WHERE p.m = p.least
            )
        ) WHERE inside % 2 = 0 AND (stop IS NULL OR i <= stop)
    )"""
    #: Of all words at once: one sort instead of one per word. Where a word ends follows from its tokens' sizes.
    DECODE = """
        SELECT unhex(string_agg(v.hex, '' ORDER BY i)) AS bytes FROM coded JOIN vocabulary v USING (id)
    """

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        if len(ranks) >= 1 << 22:
            raise ValueError("ids must be below 2**22")
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.ids = np.array(sorted(ranks.values()), np.int32)
        self.size = np.zeros(int(self.ids[-1]) + 1, np.int64)  # bytes of every token
        for t, r in ranks.items():
            self.size[r] = len(t)
        self.known: dict[str, bytes] = {}  # ids in decimal, joined by commas, then | and the bytes decoded from them
        self.older: dict[str, bytes] = {}  # what was known before the last turn
        self.held = 0  # bytes of known, about
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": ""})
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 3
        self.con.register("given", pa.table({"pair": left * 4194304 + right, "m": pa.array(merged, pa.int32())}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.con.unregister("given")
        self.beside = np.zeros((256, 256), bool)  # bytes that stand side by side in some token
        for t in ranks:
            for a, b in zip(t, t[1:], strict=False):
                self.beside[a, b] = True
        self.con.register("given", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        self.con.unregister("given")

    def _ask(self, name: str, table: pa.Table, query: str) -> pa.Table:
        self.con.register(name, table)
        try:
            return self.con.sql(query).to_arrow_table()
        finally:
            self.con.unregister(name)

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of every piece; one that is in the vocabulary is its own token."""
        flat, counts = self._encoded(pieces)
        return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] if pieces else []

    def _encoded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all pieces in order, how many each has)."""
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        size = np.array([len(p) for p in pieces], np.int64)
        some, short = np.flatnonzero(whole >= 0), np.flatnonzero((whole < 0) & (size > 0) & (size <= LONG))
        counts = (whole >= 0).astype(np.int64)
        found = [(some, whole[some].astype(np.int32)), (short, np.zeros(0, np.int32))]
        if len(short):
            ids, counts[short] = self._contracted([pieces[k] for k in short.tolist()], self.ENCODE)
            found[1] = (short, ids)
        long = np.flatnonzero((whole < 0) & (size > LONG))
        if len(long):
            lists = self._long([pieces[k] for k in long.tolist()])
            counts[long] = [len(x) for x in lists]
            found.append((long, np.concatenate([np.array(x, np.int32) for x in lists])))
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for at, ids in found:
            n = counts[at]
            out[np.repeat(starts[at] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, counts

    def _long(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of long pieces, from those of their parts."""
        parts = [self._apart(p) for p in pieces]
        words = list(dict.fromkeys(w for p in parts for w in p))
        found = {w: [self.ranks[w]] for w in words if w in self.ranks}
        for some, query in (([w for w in words if w not in found and len(w) <= LONG], self.ENCODE), ([w for w in words if w not in found and len(w) > LONG], self.ENCODE_LONG.format(chosen=self.CHOSEN))):
            if some:
                ids, counts = self._contracted(some, query)
                found |= zip(some, (x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])), strict=True)
        return [[i for w in p for i in found[w]] for p in parts]

    def _apart(self, piece: bytes) -> list[bytes]:
        """piece cut between bytes that no token holds side by side."""
        x = np.frombuffer(piece, np.uint8)
        cut = [0, *(np.flatnonzero(~self.beside[x[:-1], x[1:]]) + 1).tolist(), len(piece)]
        return [piece[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def _contracted(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """(the tokens of words of several bytes in order, how many each has); a query takes PIECES words, and fewer where they are long."""
        ids, counts = [], []
        flat = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        edge = np.concatenate(([0], np.cumsum([len(w) for w in words])))
        for at, end in self._chunks(edge, PIECES, SYMBOLS if query is self.ENCODE else SYMBOLS // 4):
            lists = pa.ListArray.from_arrays(pa.array((edge[at : end + 1] - edge[at]).astype(np.int32)), pa.array(flat[edge[at] : edge[end]]))
            done = self._ask("words", pa.table({"w": pa.array(np.arange(end - at)), "toks": lists}), query).column("toks").combine_chunks()
            ids.append(done.flatten().to_numpy())
            counts.append(np.diff(done.offsets.to_numpy()))
        return np.concatenate(ids), np.concatenate(counts)

    def _chunks(self, edge: np.ndarray, most: int, size: int) -> Iterator[tuple[int, int]]:
        """Ranges of words whose ends are edge: at most so many words and so long together, or one longer word, for which DuckDB gets more memory."""
        at = 0
        while at < len(edge) - 1:
            end = max(at + 1, min(at + most, int(np.searchsorted(edge, edge[at] + size, side="right")) - 1))
            own = int(edge[end] - edge[at])
            if own > size:  # its steps hold a few hundred bytes a token
                self.con.execute(f"SET memory_limit = '{MEMORY_MB + own // 2000}MB'")
            yield at, end
            at = end

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of every list of ids; an id outside the vocabulary raises an error."""
        counts = np.array([len(x) for x in ids], np.int64)
        return [b for b, _ in self._decoded(np.array([i for x in ids for i in x], np.int32), counts)]

    def _decoded(self, flat: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, str]]:
        """(bytes, ids in decimal joined by commas) of every list of ids."""
        if not np.isin(flat, self.ids).all():
            raise ValueError("an id is outside the vocabulary")
        out: list[tuple[bytes, str]] = [(b"", "")] * len(counts)
        edge = np.concatenate(([0], np.cumsum(counts)))
        for at, end in self._chunks(edge, 8 * PIECES, SYMBOLS // 2):
            part = flat[edge[at] : edge[end]]
            if not len(part):
                continue
            done = self._ask("coded", pa.table({"id": pa.array(part), "i": pa.array(np.arange(len(part)))}), self.DECODE)
            decoded, names = done.column("bytes")[0].as_py(), list(map(str, part.tolist()))
            place = np.concatenate(([0], np.cumsum(self.size[part])))[edge[at : end + 1] - edge[at]].tolist()
            cut = (edge[at : end + 1] - edge[at]).tolist()
            for k in range(end - at):
                out[at + k] = decoded[place[k] : place[k + 1]], ",".join(names[cut[k] : cut[k + 1]])
        return out

    def meet(self, pieces: list[str]) -> list[bytes]:
        """Of distinct pieces the ids in decimal, joined by commas, then | and the bytes decoded from them; those met lately are remembered."""
        if self.held > REMEMBERED_BYTES // 2:
            self.known, self.older, self.held = {}, self.known, 0
        new = []
        for p in pieces:
            if p not in self.known:
                if (x := self.older.get(p)) is None:
                    new.append(p)
                else:
                    self._remember(p, x)
        given = [p.encode("utf-8", "surrogatepass") for p in new]
        for p, b, (decoded, ids) in zip(new, given, self._decoded(*self._encoded(given)), strict=True):
            if decoded != b:
                raise ValueError("the vocabulary doesn't decode to what it encodes")
            self._remember(p, ids.encode() + b"|" + decoded)
        return [self.known[p] for p in pieces]

    def _remember(self, piece: str, coded: bytes) -> None:
        self.known[piece] = coded
        self.held += 200 + 2 * len(piece) + len(coded)


def engine(content: bytes) -> Engine:
    """The worker's engine for a rank file."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _engines:
        _engines.clear()
        _engines[key] = Engine(read_ranks(content))
    return _engines[key]


def _batched(texts: list[str | None], limit: int) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def _mapped(docs: DataFrame, text: str, ranks_file: str, fields: list[T.StructField], of):
    docs = docs.drop(*[f.name for f in fields])
    with open(ranks_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = engine(shared.value)
        for batch in batches:
            for a, b, _, _ in text_slices(text_array(batch.column(at)), GROUP_CHARS):
                rows = batch.slice(a, b - a)
                columns: list[list] = [[] for _ in fields]
                parts = [split_many(part) for part in _batched(rows.column(at).to_pylist(), PART_CHARS)]
                distinct, index = unify(parts)
                known = e.meet(distinct)
                halves = [x.partition(b"|") for x in known]
                coded, decoded = [x[0] for x in halves], [x[2] for x in halves]
                k = 0
                for _, _, first in parts:
                    for x, y in zip(first.tolist(), first.tolist()[1:], strict=False):
                        at_pieces = index[k + x : k + y].tolist()
                        made = of(b",".join([coded[i] for i in at_pieces]), b"".join([decoded[i] for i in at_pieces]))
                        for column, v in zip(columns, made, strict=True):
                            column.append(v)
                    k += int(first[-1])
                made = [pa.array(c, kind) for c, kind in zip(columns, of.types, strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=[*batch.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(released(run), schema)


def _numbers(ids: bytes) -> np.ndarray:
    return np.fromstring(ids.decode(), np.int32, sep=",") if ids else np.zeros(0, np.int32)


class _Ids:
    types = (pa.list_(pa.int32()),)

    def __call__(self, ids: bytes, decoded: bytes):
        return (_numbers(ids),)


class _Tokens:
    types = (pa.int64(), pa.list_(pa.int32()), pa.string())

    def __call__(self, ids: bytes, decoded: bytes):
        numbers = _numbers(ids)
        return len(numbers), numbers, hashlib.sha256(decoded).hexdigest()


class _Digests:
    types = (pa.int64(), pa.string(), pa.string())

    def __call__(self, ids: bytes, decoded: bytes):
        return ids.count(b",") + bool(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


def encode(docs: DataFrame, ranks_file: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the token ids of text; ranks_file lists the vocabulary, a base64 token and its rank per line."""
    return _mapped(docs, text, ranks_file, [T.StructField(out, T.ArrayType(T.IntegerType()))], _Ids())


def decode(coded: DataFrame, ranks_file: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with the bytes of its token ids (null for null)."""
    coded = coded.drop(out)
    with open(ranks_file, "rb") as f:
        shared = coded.sparkSession.sparkContext.broadcast(f.read())
    at = coded.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = engine(shared.value)
        for batch in batches:
            lists = batch.column(at).to_pylist()
            found = e.decode([x or [] for x in lists])
            made = pa.array([None if x is None else b for x, b in zip(lists, found, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, out])

    return coded.mapInArrow(released(run), T.StructType([*coded.schema.fields, T.StructField(out, T.BinaryType())]))


def digests(docs: DataFrame, ranks_file: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 (of the ids in decimal, joined by commas) and decoded_sha256 (of the bytes decoded from the ids).

    The ids of a text are those of its pieces in order and its bytes those decoded from them, so both are put together from the pieces'.
    """
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, text, ranks_file, fields, _Digests())


def tokenised(docs: DataFrame, ranks_file: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids and decoded_sha256."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded_sha256", T.StringType())]
    return _mapped(docs, text, ranks_file, fields, _Tokens())


def token_digests(docs: DataFrame, ranks_file: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs."""
    return digests(docs.select("doc_id", F.col("text")), ranks_file).drop("text")
