"""Chat formatting by token-level assembly.

A conversation is its turns in order of (turn, role, text). Roles and texts are encoded each by itself, so no token ever reaches over a
border; reserved ids behind the vocabulary open a turn, divide the role from the text and close the turn. Where a segment starts is the
prefix sum of the lengths before it, and the loss mask is the prefix sum of +1 where a speaker's text begins and -1 where it ends.

Written as text the template is `<turn>role<says>text</turn>`. Control strings (CONTROLS: the template's own and those of a plain template
that readers know) are escaped wherever a role or a text holds them: every backslash is doubled, and a backslash goes behind the first
sign of a control string. So no content can open or close a turn, neither as ids nor as text, and `unescape` gives back every sign.

Turns of a conversation meet in one task, sorted, and stream through it; nothing holds a conversation whole. What is assembled is a row per
conversation (conv_id, part, ids, loss), and several parts of about PART_TOKENS tokens where one is longer.

Defined cases: a null role or text counts as empty; rows without a conv_id are one conversation, whose conv_id is null; a null turn comes
first; repeated rows are turns of their own; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import partitions, released

OPEN, SAYS, CLOSE = "<turn>", "<says>", "</turn>"
#: No backslash in any of them, and none ends as another begins: breaking one up can't make another.
CONTROLS = (OPEN, SAYS, CLOSE, "### System:", "### User:", "### Assistant:")
PART_TOKENS = 1 << 20
ASSEMBLED = "conv_id long, part int, ids array<int>, loss array<boolean>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: Column) -> Column:
    """text without control strings: backslashes doubled, and one behind the first sign of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: bytes) -> bytes:
    """What escape was given."""
    return re.sub(rb"\\(.)", rb"\1", text, flags=re.DOTALL) if b"\\" in text else text


def reserved(ranks_file: str) -> dict[str, int]:
    """The ids of OPEN, SAYS and CLOSE: the first three behind the vocabulary."""
    with open(ranks_file, "rb") as f:
        first = max(bpe.read_ranks(f.read()).values()) + 1
    return {name: first + i for i, name in enumerate((OPEN, SAYS, CLOSE))}


def _whole(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of whole conversations (first column conv_id, last one ids); of one with more than most tokens, some rows at a time."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        held = b if held is None else pa.concat_batches([held, b])
        key, null = held.column(0).fill_null(0).to_numpy(), held.column(0).is_null().to_numpy(False)
        edge = np.flatnonzero((key[1:] != key[:-1]) | (null[1:] != null[:-1]))
        last = int(edge[-1]) + 1 if len(edge) else 0
        if last:
            yield held.slice(0, last)
            held = held.slice(last)
        if len(held.column(held.num_columns - 1).flatten()) > most:
            yield held
            held = None
    if held is not None:
        yield held


def _assembler(mark: dict[str, int], most: int):
    opens, says, close = mark[OPEN], mark[SAYS], mark[CLOSE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, part = (False, None), 0  # the conversation that the rows before ended with
        for b in _whole(batches, most):
            is_text, speaks = (b.column(c).to_numpy(False) for c in (1, 2))
            lists = b.column(3)
            flat, count = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            # a role is opened and divided from its text, a text is closed
            size = count + np.where(is_text, 1, 2)
            start = np.cumsum(size) - size
            body = start + np.where(is_text, 0, 1)
            ids = np.empty(int(size.sum()), np.int32)
            ids[np.repeat(body - (np.cumsum(count) - count), count) + np.arange(len(flat))] = flat
            ids[start[~is_text]] = opens
            ids[start[~is_text] + size[~is_text] - 1] = says
            ids[start[is_text] + size[is_text] - 1] = close
            step = np.zeros(len(ids) + 1, np.int8)
            taught = is_text & speaks & (count > 0)
            step[body[taught]] += 1
            step[body[taught] + count[taught]] -= 1
            loss = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
            conv = b.column(0)
            key, null = conv.fill_null(0).to_numpy(), conv.is_null().to_numpy(False)
            first = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (null[1:] != null[:-1])) + 1))
            names = [conv[int(i)].as_py() for i in first]
            parts = np.zeros(len(first), np.int32)
            if met == (True, names[0]):
                parts[0] = part + 1
            met, part = (True, names[-1]), int(parts[-1])
            offsets = pa.array(np.concatenate((start[first], [len(ids)])).astype(np.int32))
            yield pa.record_batch([pa.array(names, pa.int64()), pa.array(parts), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(loss))], names=["conv_id", "part", "ids", "loss"])

    return run


def assemble(conversations: DataFrame, ranks_file: str, speakers: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, part, ids, loss) of conversations (conv_id, turn, role, text): loss marks the tokens of what speakers say.

    Rows of a conversation lie together and in order of part.
    """
    spark = conversations.sparkSession
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    segments = turns.select("conv_id", F.col("role").isin(*speakers).alias("speaks"), F.posexplode(F.array(escape(F.col("role")), escape(F.col("text")))).alias("place", "text"))
    segments = segments.select("conv_id", (F.col("place") == 1).alias("is_text"), "speaks", "text")
    coded = bpe.encode(segments, ranks_file).select("conv_id", "is_text", "speaks", "ids")
    return coded.mapInArrow(_assembler(reserved(ranks_file), PART_TOKENS), ASSEMBLED)


class _Reading:
    """A conversation that is being read back from its parts."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def segment(self, content: bytes, closes: bool) -> None:
        self.turns.update(unescape(content))
        self.turns.update(b"\n")
        self.n_turns += closes

    def taught(self, content: bytes) -> None:
        content = unescape(content)
        self.loss.update(content)
        self.loss_chars += len(content.decode("utf-8"))

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


class Renderer:
    """The text of token ids, reserved ones written as their control strings."""

    def __init__(self, content: bytes, mark: dict[str, int]):
        tokens = {i: t for t, i in bpe.read_ranks(content).items()} | {i: name.encode() for name, i in mark.items()}
        self.size = np.zeros(max(tokens) + 1, np.int64)
        for i, t in tokens.items():
            self.size[i] = len(t)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens[i] for i in sorted(tokens)), np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes, where each token's begin and the end). An id without a token raises ValueError."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size) or not self.size[ids].all()):
            raise ValueError("an id is outside the vocabulary")
        size = self.size[ids]
        edge = np.concatenate(([0], np.cumsum(size)))
        return self.bytes[np.repeat(self.at[ids] - edge[:-1], size) + np.arange(edge[-1])], edge


def _reader(content, mark: dict[str, int]):
    opens, says, close = mark[OPEN], mark[SAYS], mark[CLOSE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = Renderer(content.value, mark)
        name, reading = None, None
        for b in batches:
            done = []
            lists, masks = b.column(2), b.column(3)
            for k, (conv, part) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if part == 0:
                    if reading is not None:
                        done.append((name, *reading.row()))
                    name, reading = conv, _Reading()
                ids, loss = lists[k].values.to_numpy(), masks[k].values.to_numpy(False)
                text, edge = render(ids)
                reading.formatted_chars += int(((text & 0xC0) != 0x80).sum())
                at = np.flatnonzero((ids == opens) | (ids == says) | (ids == close))
                if len(at) and ids[at[0]] == close:  # the text of a turn that the part before opened
                    reading.segment(text[: edge[at[0]]].tobytes(), True)
                for a, z in zip(at.tolist(), at.tolist()[1:], strict=False):
                    if ids[z] != opens:
                        reading.segment(text[edge[a + 1] : edge[z]].tobytes(), bool(ids[z] == close))
                step = np.diff(np.concatenate(([0], loss.astype(np.int8), [0])))
                for a, z in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
                    reading.taught(text[edge[a] : edge[z]].tobytes())
            if done:
                yield _rows(done)
        if reading is not None:
            yield _rows([(name, *reading.row())])

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def read_back(assembled: DataFrame, ranks_file: str) -> DataFrame:
    """A row per conversation, from ids and loss alone: turns, digest of roles and texts, size and digest of the text under the mask, and
    the length of the formatted text. Takes rows as assemble leaves them (by conversation and part)."""
    with open(ranks_file, "rb") as f:
        content = assembled.sparkSession.sparkContext.broadcast(f.read())
    return assembled.select("conv_id", "part", "ids", "loss").mapInArrow(released(_reader(content, reserved(ranks_file))), DIGESTS)


def rendered(assembled: DataFrame, ranks_file: str) -> DataFrame:
    """(conv_id, part, formatted): the ids written as text."""
    with open(ranks_file, "rb") as f:
        content = assembled.sparkSession.sparkContext.broadcast(f.read())
    mark = reserved(ranks_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = Renderer(content.value, mark)
        for b in batches:
            texts = [render(b.column(2)[k].values.to_numpy())[0].tobytes().decode("utf-8") for k in range(b.num_rows)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["conv_id", "part", "formatted"])

    return assembled.select("conv_id", "part", "ids").mapInArrow(run, "conv_id long, part int, formatted string")


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def oracle(extra: list[tuple]) -> str:
    """The digests of conversations and of further (conv_id, turn, role, text) rows in DuckDB SQL."""
    rows = ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in extra)
    marks = len(OPEN) + len(SAYS) + len(CLOSE)
    return f"""WITH a AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {rows})),
t AS (SELECT conv_id::BIGINT AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM a)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_sql_escaped("role")}) + length({_sql_escaped("text")}) + {marks})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""
