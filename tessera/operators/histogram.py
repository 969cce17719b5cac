"""Order statistics of whole-number samples by counting: what is shuffled is bounded by the number of codes, not of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_at(samples: DataFrame, by: list[str], value: str, place: Column, out: str) -> DataFrame:
    """by and the sample at place (from 0, an expression over n_, the number of samples) in the order of each group."""
    codes = samples.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c_"))
    w = Window.partitionBy(*by)
    run = codes.withColumn("up_to_", F.sum("c_").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n_", F.sum("c_").over(w))
    return run.where(F.col("up_to_") > place).groupBy(*by).agg(F.min(value).alias(out))


def weighted_middle(samples: DataFrame, by: list[str], value: str, weight: str, out: str) -> DataFrame:
    """by and the first value at which the weights come to half of their sum."""
    codes = samples.groupBy(*by, value).agg(F.sum(weight).alias("c_"))
    w = Window.partitionBy(*by)
    run = codes.withColumn("up_to_", F.sum("c_").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n_", F.sum("c_").over(w))
    return run.where("2 * up_to_ >= n_").groupBy(*by).agg(F.min(value).alias(out))


def at(codes: Column, place: Column) -> Column:
    """The value at place (from 0) of samples told by codes, an array of (v, n) in the order of v."""
    step = lambda a, e: F.struct(F.when(a["left"] >= 0, e["v"]).otherwise(a["v"]).alias("v"), (a["left"] - e["n"]).alias("left"))
    return F.aggregate(codes, F.struct(F.get(codes, F.lit(0))["v"].alias("v"), place.cast("long").alias("left")), step)["v"]


def trimmed_mean(codes: Column, n: Column, share: float) -> Column:
    """The mean of what is left when so large a share goes at either end."""
    gone = F.floor(n * share)
    used = lambda a, e: F.greatest(F.lit(0), F.least(a["up"] + e["n"], n - gone) - F.greatest(a["up"], gone))
    step = lambda a, e: F.struct((a["up"] + e["n"]).alias("up"), (a["s"] + e["v"] * used(a, e)).alias("s"))
    return F.aggregate(codes, F.struct(F.lit(0).cast("long").alias("up"), F.lit(0.0).alias("s")), step)["s"] / (n - 2 * gone)
