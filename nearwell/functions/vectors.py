"""Vector columns: validation, casting, cutting and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class VectorError(ValueError):
    """A vector table that no operator accepts: null or empty vectors, null or non-finite components or several lengths."""


def vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", *keep: str) -> DataFrame:
    """(id, v, *keep): ids as long, components as double (every distance is computed in double)."""
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), *keep)


def _unusable(v: Column) -> Column:
    """Is a vector null, empty, or with a component that is no finite number?"""
    return v.isNull() | (F.size(v) < 1) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | x.cast("double").isin(float("inf"), float("-inf")))


def checked(v: Column, dim: int | None = None) -> Column:
    """v itself; a row with an unusable vector, or one of another length than dim, fails the job with VectorError's text."""
    bad = _unusable(v) if dim is None else _unusable(v) | (F.size(v) != dim)
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("VectorError: null, empty, of another length or with components that are no finite numbers"))).otherwise(v)


def is_binary(df: DataFrame, vector: str = "v") -> bool:
    return dict(df.dtypes)[vector] == "binary"


def dimension(df: DataFrame, vector: str = "v") -> int:
    """The length of all vectors, checked in one aggregation; 0 for an empty table."""
    return profile(df, vector)[1]


def profile(df: DataFrame, vector: str = "v") -> tuple[int, int]:
    """(number of rows, length of all vectors), checked in one aggregation; the length is 0 for an empty table. BINARY counts by bytes."""
    return survey(df, vector)[:2]


def slim(v: Column, single: bool = True) -> Column:
    """v as floats if single, which takes half the room where nothing is lost by it; else v itself."""
    return v.cast("array<float>") if single else v


def survey(df: DataFrame, vector: str = "v", single: bool = False) -> tuple[int, int, bool]:
    """profile() and, if asked for, whether every component is the same number in single precision, in the same aggregation."""
    v = F.col(vector)
    size, bad = (F.octet_length(v), v.isNull() | (F.octet_length(v) < 1)) if is_binary(df, vector) else (F.size(v), _unusable(v))
    exact = F.lit(False)
    if single and not is_binary(df, vector):
        exact = F.every(F.forall(v, lambda x: x.cast("float").cast("double") == x.cast("double")))
    r = df.agg(F.min(size).alias("low"), F.max(size).alias("high"), F.count(F.when(bad, 1)).alias("bad"), F.count("*").alias("n"), exact.alias("exact")).first()
    if r["bad"]:
        raise VectorError(f"{r['bad']} rows hold a null or empty vector or a component that is no finite number")
    if r["low"] != r["high"]:
        raise VectorError(f"vectors of {r['low']} to {r['high']} components")
    return r["n"], r["high"] or 0, bool(r["exact"])


def head(v: Column, n: int) -> Column:
    """The first n components."""
    return F.slice(v, 1, n)


def with_dimension(v: Column) -> Column:
    """The vector's length as its first component, then the vector."""
    return F.concat(F.array(F.size(v).cast("double")), v)


def pack_signs(v: Column, groups: int, bits: int = 8) -> Column:
    """groups longs of bits sign bits each: bit i of group g is set where component g * bits + i isn't negative."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(groups - 1)),
        lambda g: F.aggregate(
            F.sequence(F.lit(0), F.lit(bits - 1)),
            F.lit(0).cast("long"),
            lambda s, i: s + F.when(F.get(v, g * bits + i) >= 0, F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")),
        ),
    )


def sampled_key(code: Column, positions: list[int], bits: int = 8) -> Column:
    """A bucket key of the given bit positions of a packed vector: position p is bit p % bits of group p // bits."""
    out = F.lit(0).cast("long")
    for j, p in enumerate(positions):
        out = out + F.shiftleft(F.getbit(F.get(code, F.lit(p // bits)), F.lit(p % bits)).cast("long"), j)
    return out


def highest_bit(x: Column) -> Column:
    """floor(log2(x)) of a positive whole number."""
    return (F.length(F.bin(x)) - 1).cast("int")
