"""Statistics of vector tables (id, v) and of measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def components(base: DataFrame, *keep: str) -> DataFrame:
    """(dim, x): a row per component."""
    return base.select(*keep, F.posexplode("v").alias("dim", "x"))


def mean_variance(base: DataFrame, sample: int = 0) -> DataFrame:
    """(dim, mean, variance): the variance is the sum of squared deviations, not divided; sample > 0 takes the first ids only."""
    if sample > 0:
        base = base.orderBy("id").limit(sample)
    return components(base).groupBy("dim").agg(F.avg("x").alias("mean"), (F.var_pop("x") * F.count("x")).alias("variance"))


def bounding_box(base: DataFrame) -> DataFrame:
    """(dim, low, high)."""
    return components(base).groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def extent(base: DataFrame, dim: int) -> DataFrame:
    """One row (low, high) of one component."""
    x = F.get("v", F.lit(dim))
    return base.agg(F.min(x).alias("low"), F.max(x).alias("high"))


def widest(base: DataFrame, n: int = 1) -> DataFrame:
    """(dim, variance): the n components of highest variance, ties to the lower one. There are as many rows as components to choose from."""
    return mean_variance(base).select("dim", "variance").orderBy(F.desc(F.round("variance", 9)), "dim").limit(n)


def median(base: DataFrame, dim: int) -> DataFrame:
    """One row (median): the value at place n / 2 in order, at which a node of a k-d tree splits.

    Approximate percentiles bracket it, so that only the values between them are ranked; the place is exact, as are the counts around it.
    """
    rows = base.select(F.get("v", F.lit(dim)).alias("x")).where("x is not null")
    low, high = rows.agg(F.percentile_approx("x", [0.4975, 0.5025], 10_000).alias("p")).first()["p"] or (None, None)
    between = F.lit(True) if low is None else F.col("x").between(low, high)
    r = rows.agg(F.count("*").alias("n"), F.count(F.when(between, 1)).alias("inside"), F.count(F.when(F.lit(False) if low is None else F.col("x") < low, 1)).alias("below")).first()
    place, below = (r["n"] + 1) // 2, r["below"]
    if not below < place <= below + r["inside"]:  # the bracket missed it
        between, below = F.lit(True), 0
    values = rows.where(between).groupBy("x").agg(F.count("*").alias("n"))
    upto = values.withColumn("upto", F.sum("n").over(Window.orderBy("x")))  # of the bracket's different values
    return upto.where(F.col("upto") >= place - below).agg(F.min("x").alias("median"))


def plane_split(base: DataFrame, dim: int, value: float) -> DataFrame:
    """One row (below, at, above) of counts on both sides of a plane."""
    x = F.get("v", F.lit(dim))
    return base.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in (("below", x < value), ("at", x == value), ("above", x > value))])


def reduce_elements(base: DataFrame, how: str) -> DataFrame:
    """(dim, x): elementwise max, min, sum or prod over all vectors."""
    return components(base).groupBy("dim").agg({"max": F.max, "min": F.min, "sum": F.sum, "prod": F.product}[how]("x").alias("x"))


def benchmark_summary(runs: DataFrame, *by: str, value: str = "elapsed") -> DataFrame:
    """(by, mean, std, error): the standard error is the population's deviation over the root of n."""
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("error"))


def speedup(mean: Column, error: Column, base_mean: Column, base_error: Column) -> tuple[Column, Column]:
    """(speed-up of mean over base_mean, its propagated error)."""
    s = base_mean / mean
    return s, s * F.sqrt(F.pow(error / mean, 2) + F.pow(base_error / base_mean, 2))


def bucket_stats(buckets: DataFrame) -> DataFrame:
    """Per table_no of (table_no, key, id): n_buckets, mean (whole), median, smallest and largest size."""
    sizes = buckets.groupBy("table_no", "key").agg(F.count("*").alias("size"))
    return sizes.groupBy("table_no").agg(F.count("*").alias("n_buckets"), F.floor(F.avg("size")).cast("long").alias("mean"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY size)").cast("long").alias("median"), F.min("size").alias("smallest"), F.max("size").alias("largest"))


def bucket_histogram(buckets: DataFrame, width: int = 20) -> DataFrame:
    """(table_no, bin, n): numbers of buckets by size in bins of width."""
    sizes = buckets.groupBy("table_no", "key").agg(F.count("*").alias("size"))
    return sizes.groupBy("table_no", (F.floor(F.col("size") / width)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def rank_within(df: DataFrame, by: str, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
