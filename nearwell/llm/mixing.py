"""Mixing sources to target weights: temperature mixing realised as budgeted block permutations.

Every source's share of the tokens is raised to an exponent, which a bisection on a grid of 2**-20 sets so that no source is read more
often than a repetition limit, or so that the weights reach a target entropy. The weights times the token budget give whole passes over a
source and a part of one more. A source's documents lie in blocks by a keyed hash; in each pass an affine map modulo the number of blocks
permutes the blocks. The part takes whole blocks in that order while they fit its tokens, and of the next block the documents in hash
order while they fit. All of it is DataFrame expressions; only a row per source reaches the driver, and its number is checked.

Defined cases: a null source is a source of its own; null and empty texts have no tokens; a source without tokens has weight 0 and is
passed once; an empty table gives an empty result; documents of one hash and equal rows are taken or left together; other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
GRID = 1 << 20
MULTIPLIERS = 8
MAX_SOURCES = 100_000
BLOCK_TOKENS = 1 << 16
MAX_BLOCKS = 1 << 22


def count_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def hash48(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def _hash48(*parts: object) -> int:
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16)


@dataclass
class Share:
    """What is read of one source: whole passes, then blocks of rank below cut, then of that block the hashes up to last."""

    source: str
    tokens: int
    weight: float
    target: int
    blocks: int
    multipliers: list[int]
    passes: int
    cut: int = 0
    last: int = -1


def weights(tokens: dict[str, int], alpha: float) -> dict[str, float]:
    total = sum(tokens.values())
    raised = {s: (n / total) ** alpha if n else 0.0 for s, n in tokens.items()}
    norm = sum(raised.values())
    return {s: x / norm for s, x in raised.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(x * math.log2(x) for x in w.values() if x > 0)


def solve_exponent(tokens: dict[str, int], budget: int | None, max_repetition: float | None = None, target_entropy: float | None = None) -> float:
    """The exponent in [0, 1]: the least that keeps every source within max_repetition passes, or the largest that reaches target_entropy bits.

    Without a budget the repetition is counted against the source that is read least (once). If 1 still repeats too much or 0 has too
    little entropy, that end of the range is the result.
    """
    tokens = {s: n for s, n in tokens.items() if n}
    if not tokens:
        return 1.0

    def fits(k: int) -> bool:
        w = weights(tokens, k / GRID)
        if max_repetition is not None:
            passes = [w[s] / n for s, n in tokens.items()]
            return max(passes) * (budget if budget is not None else 1 / min(passes)) <= max_repetition
        return entropy(w) < target_entropy

    low, high = 0, GRID
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low / GRID if max_repetition is not None else max(0, low - (0 if not fits(low) else 1)) / GRID


def plan(counted: DataFrame, budget: int | None = None, max_repetition: float | None = None, target_entropy: float | None = None, seed: int = 0, block_tokens: int = BLOCK_TOKENS, max_sources: int = MAX_SOURCES) -> list[Share]:
    """Shares by source for rows (src, hash, n). Without a budget it is the least under which every source is read once as a whole."""
    if (max_repetition is None) == (target_entropy is None):
        raise ValueError("give one of max_repetition and target_entropy")
    rows = counted.groupBy("src").agg(F.sum("n").alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    tokens = {r["src"]: r["n"] for r in sorted(rows)}
    total = sum(tokens.values())
    if not total:
        return [Share(s, 0, 0.0, 0, 1, [1] * MULTIPLIERS, 1) for s in tokens]
    w = weights(tokens, solve_exponent(tokens, budget, max_repetition, target_entropy))
    whole = budget is None
    budget = budget if budget is not None else max(n / w[s] for s, n in tokens.items() if n)
    size = max(block_tokens, -(-total // MAX_BLOCKS))
    shares = []
    for s, n in tokens.items():
        blocks = max(1, -(-n // size))
        target = max(math.floor(budget * w[s]), n if whole else 0)
        if max_repetition is not None:
            target = min(target, math.floor(max_repetition * n))
        mult = []
        for j in range(MULTIPLIERS):
            x = 1 + _hash48(seed, s, j) % blocks
            while math.gcd(x, blocks) > 1:
                x += 1
            mult.append(x)
        shares.append(Share(s, n, w[s], target, blocks, mult, target // n if n else 1))
    _cut(counted, [x for x in shares if x.tokens and x.target % x.tokens], seed)
    return shares


def _table(spark, shares: list[Share]) -> DataFrame:
    """A row per source: at most max_sources rows, so it may be broadcast."""
    rows = [(x.source, x.tokens, x.weight, x.target, x.blocks, x.multipliers, x.passes, x.cut, x.last) for x in shares]
    return F.broadcast(spark.createDataFrame(rows, "src string, src_tokens long, weight double, target long, blocks long, multipliers array<bigint>, passes long, cut long, last long"))


def _rank(epoch: Column, seed: int) -> Column:
    """The place of a row's block in the order of a pass."""
    a = F.get(F.col("multipliers"), (epoch % MULTIPLIERS).cast("int"))
    shift = hash48(F.lit(seed), F.col("src"), F.lit("pass"), epoch)
    return F.pmod(a * F.col("block") + F.pmod(shift, F.col("blocks")), F.col("blocks"))


def _cut(counted: DataFrame, shares: list[Share], seed: int) -> None:
    if not shares:
        return
    spark = counted.sparkSession
    placed = counted.join(_table(spark, shares), "src").withColumn("block", F.pmod("hash", "blocks")).withColumn("rank", _rank(F.col("passes"), seed)).withColumn("rest", F.col("target") % F.col("src_tokens"))
    blocks = placed.groupBy("src", "rank", "rest").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("src").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1))
    found = blocks.withColumn("before", F.coalesce(before, F.lit(0))).where("before <= rest and before + n > rest").select("src", "rank", (F.col("rest") - F.col("before")).alias("room")).collect()
    at = {x.source: x for x in shares}
    for r in found:
        at[r["src"]].cut = r["rank"]
    here = F.broadcast(spark.createDataFrame([tuple(r) for r in found], "src string, rank long, room long"))
    inside = placed.join(here, ["src", "rank"])
    upto = F.sum("n").over(Window.partitionBy("src").orderBy("hash").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    for r in inside.withColumn("upto", upto).where("upto <= room").groupBy("src").agg(F.max("hash").alias("last")).collect():
        at[r["src"]].last = r["last"]


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", tokens: str | None = None, budget: int | None = None, max_repetition: float | None = None, target_entropy: float | None = None, seed: int = 0, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """docs, each row once per reading, with mix_epoch (from 0), mix_place (0 to 1: reading in this order keeps the weights throughout) and mix_weight.

    tokens names a column of token counts; without it the words of text are counted.
    """
    spark = docs.sparkSession
    count = F.coalesce(F.col(tokens).cast("long"), F.lit(0)) if tokens else count_tokens(F.col(text))
    src, key48 = source_key(F.col(source)), hash48(F.lit(seed), F.col(key))
    counted = docs.select(src.alias("src"), key48.alias("hash"), count.alias("n"))
    shares = plan(counted if tokens else materialize(spark, counted, "tokens"), budget, max_repetition, target_entropy, seed, block_tokens)
    row = docs.drop("mix_epoch", "mix_place", "mix_weight").select(F.struct("*").alias("row"), src.alias("src"), key48.alias("hash"))
    row = row.join(_table(spark, shares), "src").withColumn("block", F.pmod("hash", "blocks"))
    rank = _rank(F.col("passes"), seed)
    part = (F.col("src_tokens") > 0) & (F.col("target") % F.col("src_tokens") > 0) & ((rank < F.col("cut")) | ((rank == F.col("cut")) & (F.col("hash") <= F.col("last"))))
    times = F.col("passes") + F.when(part, 1).otherwise(0)
    row = row.withColumn("times", times).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    place = (F.col("epoch") + (_rank(F.col("epoch"), seed) + F.col("hash") / F.lit(float(1 << 48))) / F.col("blocks")) / F.greatest(F.lit(1.0), F.col("target") / F.greatest(F.col("src_tokens"), F.lit(1)))
    return row.select("row.*", F.col("epoch").alias("mix_epoch"), F.least(place, F.lit(1.0)).alias("mix_place"), F.col("weight").alias("mix_weight"))


def oracle(seed: int, max_repetition: float, table: str = "documents") -> str:
    """DuckDB SQL of mix() over doc_id and source for a budget of as many tokens as the table has: every exponent of the grid is tried."""
    h = lambda *parts: f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12))::BIGINT"
    rank = lambda epoch: f"((mult[({epoch}) % {MULTIPLIERS} + 1] * (h % blocks) + {h(repr(str(seed)), 'src', repr('pass'), f'({epoch})::VARCHAR')} % blocks) % blocks)"
    return f"""
WITH d AS (
    SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n_tokens,
        coalesce('s' || source, 'n') AS src, {h(repr(str(seed)), 'doc_id::VARCHAR')} AS h
    FROM {table}
),
t AS (SELECT src, sum(n_tokens)::BIGINT AS n FROM d GROUP BY src),
b AS (SELECT sum(n)::BIGINT AS budget, greatest({BLOCK_TOKENS}, ceil(sum(n) / {MAX_BLOCKS}))::BIGINT AS size FROM t),
tried AS (SELECT k, sum(power(n / budget, k / {GRID}.0)) AS norm, max(power(n / budget, k / {GRID}.0) / n) AS most FROM t, b, (SELECT unnest(range(0, {GRID} + 1)) AS k) WHERE n > 0 GROUP BY k),
chosen AS (SELECT coalesce((SELECT min(k) FROM tried, b WHERE most / norm * budget <= {max_repetition}), {GRID}) AS k),
w AS (SELECT src, n, CASE WHEN n > 0 THEN power(n / budget, chosen.k / {GRID}.0) / norm ELSE 0 END AS weight FROM t, b, chosen JOIN tried ON tried.k = chosen.k),
s AS (
    SELECT src, n, weight, least(floor(budget * weight), floor({max_repetition} * n))::BIGINT AS target, greatest(1, ceil(n / size))::BIGINT AS blocks FROM w, b
),
m AS (
    SELECT *, CASE WHEN n > 0 THEN target // n ELSE 1 END AS passes, CASE WHEN n > 0 THEN target % n ELSE 0 END AS rest,
        [{', '.join(f"list_filter(range(1 + {h(repr(str(seed)), 'src', repr(str(j)))} % blocks, 2 + 2 * blocks), lambda x: gcd(x, blocks) = 1)[1]" for j in range(MULTIPLIERS))}] AS mult
    FROM s
),
p AS (SELECT d.*, m.* EXCLUDE (src), {rank('passes')} AS r FROM d JOIN m USING (src)),
q AS (SELECT src, r, rest, sum(n_tokens) AS n, coalesce(sum(sum(n_tokens)) OVER (PARTITION BY src ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WHERE rest > 0 GROUP BY src, r, rest),
c AS (SELECT src, r AS cut, rest - before AS room FROM q WHERE before <= rest AND before + n > rest),
u AS (SELECT src, h, room, sum(n_tokens) OVER (PARTITION BY src ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM p JOIN c USING (src) WHERE r = cut),
l AS (SELECT src, max(h) AS last FROM u WHERE upto <= room GROUP BY src),
x AS (
    SELECT p.*, passes + CASE WHEN rest > 0 AND (r < coalesce(cut, 0) OR (r = coalesce(cut, 0) AND h <= coalesce(last, -1))) THEN 1 ELSE 0 END AS times
    FROM p LEFT JOIN c USING (src) LEFT JOIN l USING (src)
),
y AS (SELECT *, unnest(range(0, times))::BIGINT AS mix_epoch FROM x)
SELECT doc_id, source, n_tokens, mix_epoch,
    round(least(1.0, (mix_epoch + ({rank('mix_epoch')} + h / {1 << 48}.0::DOUBLE) / blocks) / greatest(1.0, target / greatest(n, 1))), 9)::DOUBLE AS mix_place, round(weight, 9)::DOUBLE AS mix_weight
FROM y
"""
