"""Lookups in calibration tables: bracketing, bands, corners of a grid, first good record, nearest node, pairs.

Calibration tables have a bounded number of nodes, whatever the number of captures; what is looked up in them need not be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(nodes: DataFrame, key: str, value: str) -> DataFrame:
    """Sorted nodes as intervals lo, hi, v_lo, v_hi, open at both ends of the table (a null bound), where the end value holds."""
    n = nodes.select(F.col(key).cast("double").alias("lo"), F.col(value).cast("double").alias("v_lo"))
    order = Window.orderBy("lo")  # a table of bounded size
    n = n.select("lo", F.lead("lo").over(order).alias("hi"), "v_lo", F.coalesce(F.lead("v_lo").over(order), "v_lo").alias("v_hi"))
    first = n.groupBy().agg(F.min("lo").alias("hi"), F.min_by("v_lo", "lo").alias("v")).select(F.lit(None).cast("double").alias("lo"), "hi", F.col("v").alias("v_lo"), F.col("v").alias("v_hi"))
    return first.unionByName(n)


def bracketed(rows: DataFrame, nodes: DataFrame, at: str, key: str, value: str, out: str) -> DataFrame:
    """rows with out: value between the nodes around at, by straight lines, held at the ends."""
    i = intervals(nodes, key, value)
    inside = (F.col("lo").isNull() | (F.col(at) >= F.col("lo"))) & (F.col("hi").isNull() | (F.col(at) < F.col("hi")))
    share = F.when(F.col("lo").isNull() | F.col("hi").isNull(), 0.0).otherwise((F.col(at) - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return rows.join(F.broadcast(i), inside).withColumn(out, F.col("v_lo") + share * (F.col("v_hi") - F.col("v_lo"))).drop("lo", "hi", "v_lo", "v_hi")


def banded(rows: DataFrame, bands: DataFrame, at: str) -> DataFrame:
    """rows with the band lo <= at < hi they fall in; bands are few."""
    return rows.join(F.broadcast(bands), (F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi")))


def grid_position(at: Column, grid: int, size: int) -> Column:
    """Where a pixel lies on a grid of cell centres, held within it."""
    return F.greatest(F.lit(0.0), F.least(F.lit(float(grid - 1)), (at + 0.5) * grid / size - 0.5))


def four_corners(grid: Column, columns: int, px: Column, py: Column, rows: int) -> Column:
    """Bilinear value of a row-major grid, held in one array, at position px, py."""
    x0, y0 = F.floor(px).cast("int"), F.floor(py).cast("int")
    x1, y1 = F.least(x0 + 1, F.lit(columns - 1)), F.least(y0 + 1, F.lit(rows - 1))
    fx, fy = px - x0, py - y0
    g = lambda y, x: F.get(grid, y * columns + x)
    return (g(y0, x0) * (1 - fx) + g(y0, x1) * fx) * (1 - fy) + (g(y1, x0) * (1 - fx) + g(y1, x1) * fx) * fy


def first_good(records: DataFrame, by: str, priority: str, columns: list[str]) -> DataFrame:
    """Of each by and column the value of the foremost record that has one."""
    return records.groupBy(by).agg(*(F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(priority))).alias(c) for c in columns))


def pairs(rows: DataFrame, within: str, member: str, value: str) -> DataFrame:
    """Mean absolute difference of value over the pairs of members (one below the other) of each group.

    From sorted values: the i-th of n stands in i differences as the larger and n - 1 - i as the smaller, so no pairs are made.
    """
    n = Window.partitionBy(within)
    i = F.row_number().over(n.orderBy(value, member)) - 1
    return (
        rows.select(within, value, i.alias("i"), F.count(F.lit(1)).over(n).alias("n"))
        .groupBy(within)
        .agg((F.sum(F.col(value) * (2 * F.col("i") - F.col("n") + 1)) / (F.max("n") * (F.max("n") - 1) / 2)).alias("mean_difference"), F.max("n").alias("members"))
        .where("members > 1")
    )


def extrapolated(rows: DataFrame, nodes: DataFrame, at: str, key: str, value: str, out: str) -> DataFrame:
    """rows with out: value between the nodes around at, the first and last segments going on beyond the ends; one node holds everywhere."""
    order = Window.orderBy("lo")  # a table of bounded size
    n = nodes.select(F.col(key).cast("double").alias("lo"), F.col(value).cast("double").alias("v_lo"))
    n = n.select("lo", F.lead("lo").over(order).alias("hi"), "v_lo", F.lead("v_lo").over(order).alias("v_hi"), F.row_number().over(order).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    s = n.where("i < n OR n = 1")
    inside = ((F.col("i") == 1) | (F.col(at) >= F.col("lo"))) & ((F.col("i") >= F.col("n") - 1) | (F.col(at) < F.col("hi")))
    slope = F.coalesce((F.col("v_hi") - F.col("v_lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0))
    return rows.join(F.broadcast(s), inside).withColumn(out, F.col("v_lo") + slope * (F.col(at) - F.col("lo"))).drop("lo", "hi", "v_lo", "v_hi", "i", "n")


def excess_at(frames: DataFrame, nodes: DataFrame) -> DataFrame:
    """m, lo, hi, excess: each severity band's excess at the frame's temperature t, held at the ends of the nodes (lo, hi, node, excess)."""
    w = Window.partitionBy("lo", "hi").orderBy("node")
    i = nodes.select("lo", "hi", F.col("node").alias("a"), F.lead("node").over(w).alias("z"), F.col("excess").alias("ea"), F.lead("excess").over(w).alias("ez"), F.row_number().over(w).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("lo", "hi")).alias("n")).where("i < n OR n = 1")
    inside = ((F.col("i") == 1) | (F.col("t") >= F.col("a"))) & ((F.col("i") >= F.col("n") - 1) | (F.col("t") < F.col("z")))
    share = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("t") - F.col("a")) / (F.col("z") - F.col("a")))), F.lit(0.0))
    return frames.join(F.broadcast(i), inside).select("m", "lo", "hi", (F.col("ea") + share * (F.coalesce("ez", "ea") - F.col("ea"))).alias("excess"))


def active(samples: DataFrame, bands: DataFrame, gain: float, threshold: float) -> DataFrame:
    """Samples in a band whose excess times gain comes to the threshold."""
    hot = bands.where(F.col("excess") * gain >= threshold)
    return samples.join(hot, (samples["m"] == hot["m"]) & (samples["sev"] >= hot["lo"]) & (samples["sev"] < hot["hi"])).select(samples["*"])


def warped(grids: list[Column], columns: int, rows: int, step: int, x: Column, y: Column) -> list[Column]:
    """u, v, sure and magnified: a warp tabulated every step pixels (grids of u, v and sureness) at x, y. Off the grid's first row or column, or where a node is null, it is not defined."""
    inside = (x >= 0) & (y >= 0)
    held = lambda p, n: F.least(F.floor(p / step).cast("int"), F.lit(n - 1))

    def at(grid: Column, px: Column, py: Column) -> Column:
        c0, r0 = held(px, columns), held(py, rows)
        c1, r1, tx, ty = F.least(c0 + 1, F.lit(columns - 1)), F.least(r0 + 1, F.lit(rows - 1)), px / step - c0, py / step - r0
        g = lambda r, c: F.get(grid, r * columns + c)
        return (g(r0, c0) * (1 - tx) + g(r0, c1) * tx) * (1 - ty) + (g(r1, c0) * (1 - tx) + g(r1, c1) * tx) * ty

    u, v = at(grids[0], x, y), at(grids[1], x, y)
    span = lambda px, py: F.hypot(at(grids[0], px, py) - u, at(grids[1], px, py) - v) / step
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), at(grids[2], x, y)))
    magnified = F.greatest(F.lit(1e-6), F.sqrt(span(x + step, y) * span(x, y + step)))
    return [F.when(inside, u), F.when(inside, v), F.when(inside, sure).otherwise(0.0), F.when(inside, magnified)]
