"""Raster kernels over sensor rows: a row is one record with its samples in an array, so a stencil joins a few rows, not pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stacked(rows: DataFrame, offsets: list[int], height: int, phase: int = 1, reflect: bool = True) -> DataFrame:
    """Each row with near: the rows at offsets (in rows of its phase), by offset, reflected at the borders or left out there."""
    place, size = F.expr(f"y div {phase}") + F.col("d"), height // phase
    inside = F.when(place < 0, -place).when(place >= size, 2 * size - 2 - place).otherwise(place) if reflect else place
    asked = rows.select("m", "y", F.explode(F.array(*map(F.lit, offsets))).alias("d")).select(
        "m", F.col("y").alias("own"), "d", (F.expr(f"y % {phase}") + phase * inside).cast("int").alias("y")
    )
    near = asked.join(rows.select("m", "y", "raw"), ["m", "y"]).groupBy("m", "own").agg(F.array_sort(F.collect_list(F.struct("d", "raw"))).alias("near"))
    return rows.join(near.withColumnRenamed("own", "y"), ["m", "y"])


def halved(rows: DataFrame) -> DataFrame:
    """m, y, x, luma: ln(1 + 1000 L) of the mean of each 2 x 2 cell of the half plane, L being the mean over 1023."""
    pairs = F.expr("transform(sequence(0, size(raw) div 2 - 1), i -> raw[2 * i] + raw[2 * i + 1])")
    return (
        rows.select("m", F.expr("y div 2").alias("y"), F.posexplode(pairs).alias("x", "s"))
        .groupBy("m", "y", "x")
        .agg((F.sum("s") / 4.0).alias("mean"))
        .select("m", F.col("y").cast("int").alias("y"), "x", F.log1p(1000.0 * F.col("mean") / 1023.0).alias("luma"))
    )


def laplacian(rows: DataFrame, height: int, width: int) -> DataFrame:
    """energy by module: the mean squared Laplacian on the odd lattice."""
    sites = f"filter(sequence(1, {width} - 2), x -> x % 2 = 1)"
    value = "near[0].raw[x] + near[2].raw[x] + near[1].raw[x - 1] + near[1].raw[x + 1] - 4 * near[1].raw[x]"
    return (
        stacked(rows, [-1, 0, 1], height, reflect=False)
        .where(f"y % 2 = 1 AND y < {height} - 1 AND size(near) = 3")
        .select("m", F.explode(F.expr(f"transform({sites}, x -> CAST({value} AS BIGINT))")).alias("v"))
        .groupBy("m")
        .agg((F.sum(F.col("v") * F.col("v")) / F.count(F.lit(1))).alias("energy"))
    )


def without_glow(rows: DataFrame, grid: np.ndarray, height: int, scale: int = 64, white: int = 65535) -> DataFrame:
    """rows (m, y, samples, corrected) with scale times the bilinear value of a grid of cell centres taken away, rounded half away from zero, held between 0 and white; a null sample becomes white."""

    def axis(at: np.ndarray, cells: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = np.clip((at + 0.5) * cells / size - 0.5, 0, cells - 1)
        first = np.floor(p).astype(int)
        return first, np.minimum(first + 1, cells - 1), p - first

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            v = np.stack(part["samples"].to_numpy())
            lost = np.isnan(v)
            v = np.where(lost, 0, v).astype(np.int64)
            y0, y1, fy = (a[:, None] for a in axis(part["y"].to_numpy(), grid.shape[0], height))
            x0, x1, fx = axis(np.arange(v.shape[1]), grid.shape[1], v.shape[1])
            glow = scale * ((grid[y0, x0] * (1 - fx) + grid[y0, x1] * fx) * (1 - fy) + (grid[y1, x0] * (1 - fx) + grid[y1, x1] * fx) * fy)
            gone = np.where(glow < 0, -np.floor(0.5 - glow), np.floor(glow + 0.5)).astype(np.int64)
            yield part[["m", "y", "corrected"]].assign(samples=list(np.where(lost, white, np.clip(v - gone, 0, white)).astype(np.int32)))

    return rows.select("m", "y", "samples", "corrected").mapInPandas(run, "m int, y int, corrected int, samples array<int>")
