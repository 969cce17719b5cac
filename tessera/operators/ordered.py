"""Operators that need an order within a key: firsts, neighbours, running totals, strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("rank_ = 1").drop("rank_")


def overlaps(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Spans that run into the next one of their key."""
    w = Window.partitionBy(key).orderBy(start, end)
    return spans.withColumn("next_start", F.lead(start).over(w)).where(F.col("next_start") < F.col(end))


def trapezoid(samples: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """The integral of value over at for each key, between neighbouring samples."""
    w = Window.partitionBy(*key).orderBy(at, value)
    step = (F.col(value) + F.lag(value).over(w)) / 2.0 * (F.col(at) - F.lag(at).over(w))
    return samples.withColumn("step_", step).groupBy(*key).agg(F.coalesce(F.sum("step_"), F.lit(0.0)).alias("integral"), F.count(F.lit(1)).alias("samples"))


def high_pass(values: DataFrame, key: list[str], at: str, value: str, radius: int, step: int = 2) -> DataFrame:
    """key, at and high: value less the median of the radius lines on either side at distances of step, reflected at the borders.

    at counts a key's lines from 0 without gaps; a key is an image, whose lines fit in an array.
    """
    lines = values.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).cast("double").alias("v")))).alias("l"))
    place = f"transform(filter(sequence(-{radius}, {radius}), d -> d <> 0), d -> pmod(i + d * {step}, greatest(2 * size(l) - 2, 1)))"
    near = f"array_sort(transform({place}, p -> l[least(p, abs(2 * size(l) - 2 - p))].v))"
    high = F.expr(f"transform(l, (e, i) -> named_struct('at', e.at, 'high', transform(array({near}), n -> e.v - (n[{radius} - 1] + n[{radius}]) / 2)[0]))")
    return lines.select(*key, F.inline(high)).withColumnRenamed("at", at)


def strata(rows: DataFrame, key: str, *order: Column, count: int) -> DataFrame:
    """count rows of each key, evenly spread over its order, both ends included: ranks index * (n - 1) / (count - 1)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    ranked = rows.withColumn("rank_", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).withColumn("n_", n)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (F.col("n_") - 1) / (count - 1)).cast("int"))
    return ranked.where(F.array_contains(wanted, F.col("rank_"))).drop("rank_", "n_")


def stride(rows: DataFrame, key: str, *order: Column, most: int) -> DataFrame:
    """Every ceil(n / most)-th row of each key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    ranked = rows.withColumn("rank_", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)
    return ranked.withColumn("n_", n).where(F.col("rank_") % F.ceil(F.col("n_") / most) == 0).drop("rank_", "n_")


def newest_within(entries: DataFrame, key: str, size: str, limit: int, *order: Column) -> DataFrame:
    """Entries of each key, newest first, while their sizes sum to the limit at most: what an eviction leaves."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("total", F.sum(size).over(w)).where(F.col("total") <= limit)


def running(rows: DataFrame, key: list[str], value: str, out: str, *order: Column) -> DataFrame:
    """rows with out: the sum of value up to each row of its key."""
    return rows.withColumn(out, F.sum(value).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
