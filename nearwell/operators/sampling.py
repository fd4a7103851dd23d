"""Samples, permutations and splits that depend on ids and a seed only, so a task that runs again draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def order_key(seed: int, key: str = "id") -> Column:
    """60 bits of the md5 of key and seed as text: any SQL engine draws the same sample."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")


def random_sample(df: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(order_key(seed, key), key).limit(n)


def split(df: DataFrame, n: int, seed: int = 0, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(a sample of n rows, the rest)."""
    taken = random_sample(df, n, seed, key)
    return taken, df.join(taken.select(key), key, "left_anti")


def share(df: DataFrame, percent: int, seed: int = 0, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(about percent of the rows, the rest), decided row by row: no shuffle."""
    inside = F.pmod(order_key(seed, key), F.lit(100)) < percent
    return df.where(inside), df.where(~inside)


def permutation(df: DataFrame, seed: int = 0, key: str = "id") -> DataFrame:
    """df in a random order, as a column `order` (a key to sort by, equal for equal ids)."""
    return df.withColumn("order", order_key(seed, key))


def first_rows(df: DataFrame, n: int, key: str = "id") -> DataFrame:
    return df.orderBy(key).limit(n)


def uniform(spark: SparkSession, n: int, dim: int, seed: int = 0, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(id, v): n vectors of uniform components, a function of id, component and seed alone."""
    unit = lambda i: (F.shiftrightunsigned(F.xxhash64("id", i, F.lit(seed)), 11).cast("double")) / F.lit(float(1 << 53))
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.lit(low) + unit(i) * F.lit(high - low)).alias("v"))
