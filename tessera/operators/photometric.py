"""Photometric fits between views, depth between labels, and what merges and searches rest on."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import optics


def _upper(a: str) -> Column:
    s = F.sort_array(a)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def match(pairs: DataFrame, by: list[str], target: str, reference: str, order: str, least: int = 64) -> DataFrame:
    """by, slope, offset: target less offset, times slope, is like reference. Under so few pairs 1 and 0.

    Pairs are sampled on a coarse grid, a bounded number for each pair of views, so a key's pairs are sorted in one place.
    """
    w = Window.partitionBy(*by)
    good = pairs.where(" AND ".join(f"{c} > 0.005 AND {c} < 0.9" for c in (target, reference)))
    ranked = good.withColumn("i_", F.row_number().over(w.orderBy(target, order)) - 1).withColumn("n_", F.count(F.lit(1)).over(w)).withColumn("high_", F.expr("i_ >= n_ div 2"))
    half = lambda c, high: F.collect_list(F.when(F.col("high_") == high, F.col(c)))
    m = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(half(c, h).alias(k) for k, c, h in (("tl", target, False), ("rl", reference, False), ("th", target, True), ("rh", reference, True))))
    m = m.select(*by, "n", *(_upper(k).alias(k) for k in ("tl", "rl", "th", "rh")))
    flat = F.expr("th - tl < 0.01")
    slope = optics.clamp(F.when(flat, F.expr("(rl + rh) / greatest(tl + th, 1e-4D)")).otherwise(F.expr("try_divide(rh - rl, th - tl)")), 0.2, 5.0)
    m = m.withColumn("slope", slope)
    offset = optics.clamp(F.expr("(tl + th) / 2 - (rl + rh) / 2 / slope"), -0.2, 0.2)
    return m.select(*by, F.when(F.col("n") < least, 1.0).otherwise(F.col("slope")).alias("slope"), F.when((F.col("n") < least) | flat, 0.0).otherwise(offset).alias("offset"))


def gain(pairs: DataFrame, by: list[str], ratio: Column) -> tuple[DataFrame, DataFrame]:
    """by and gain, the upper median of ratios held between a quarter and four; by and p90, the ratio at place 9 n div 10."""
    s = pairs.groupBy(*by).agg(F.sort_array(F.collect_list(ratio)).alias("a"))  # a bounded number of sampled pairs
    middle = F.get("a", F.floor(F.size("a") / 2).cast("int"))
    high = F.get("a", F.least(F.floor(9 * F.size("a") / 10), F.size("a") - 1).cast("int"))
    return s.select(*by, optics.clamp(middle, 0.25, 4.0).alias("gain")), s.select(*by, high.alias("p90"))


def sublabel(costs: Column, inverse: Column) -> tuple[Column, Column]:
    """The label of least cost (the first of equals), and the depth at the foot of the parabola through it and its neighbours.

    Ends, the label after the first, and costs that do not bend upwards keep their label's own depth.
    """
    best = (F.array_position(costs, F.array_min(costs)) - 1).cast("int")
    left, middle, right = (F.get(costs, best + d) for d in (-1, 0, 1))
    bend = left - 2 * middle + right
    offset = optics.clamp(F.try_divide(0.5 * (left - right), bend), -0.75, 0.75)
    own, step = F.get(inverse, best), (F.get(inverse, best + 1) - F.get(inverse, best - 1)) * 0.5
    plain = (best <= 1) | (best + 1 >= F.size(costs)) | (bend <= 1e-6)
    return best, F.when(plain, 1.0 / own).otherwise(1.0 / (own + offset * step))


def led(rows: DataFrame, by: list[str], shares: tuple[str, str], score: str, order: str, apart: float) -> DataFrame:
    """by, best, lead: the least score of a key, and how far it is below the least of those whose three shares differ by so much in all."""
    a, b = shares
    best = rows.groupBy(*by).agg(F.min_by(F.struct(F.col(a).alias("a_"), F.col(b).alias("b_"), F.col(score).alias("best")), F.struct(score, order)).alias("f")).select(*by, "f.*")
    da, db = F.col(a) - F.col("a_"), F.col(b) - F.col("b_")
    far = F.abs(da) + F.abs(db) + F.abs(da + db) >= apart
    other = rows.join(best, by).where(far).groupBy(*by).agg(F.min(score).alias("second"))
    return best.join(other, by, "left").select(*by, "best", (F.col("second") - F.col("best")).alias("lead"))


def merge_weight(residual: Column, variance: Column, sigma: float = 4.0) -> Column:
    """The weight of a frame's sample by how far it is from the reference's: 1 at none, 0 from sigma deviations on."""
    return F.pow(optics.clamp(1.0 - residual * residual / F.greatest(sigma * sigma * variance, F.lit(1e-9)), 0.0, 1.0), F.lit(2.0))


def support(weights: list[Column]) -> Column:
    """The reference and these weights together, at most four, in 16384ths, as 16 bits hold them."""
    return F.least(F.lit(65535), F.round(optics.clamp(sum(weights, F.lit(1.0)), 0.0, 4.0) * 16384)).cast("long")


def balanced_loss(rows: DataFrame, by: list[str], cell: str, error: str, knee: float, penalty: float) -> DataFrame:
    """by, loss, rmse, cells: Huber's loss averaged in each cell, cells weighing alike, with a penalty added."""
    cells = rows.groupBy(*by, cell).agg(F.avg(optics.huber(F.col(error), knee)).alias("l"), F.avg(F.col(error) * F.col(error)).alias("q"))
    return cells.groupBy(*by).agg((F.avg("l") + penalty).alias("loss"), F.sqrt(F.avg("q")).alias("rmse"), F.count(F.lit(1)).alias("cells"))


def merged(rows: DataFrame, others: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], variance: Callable[[np.ndarray], np.ndarray], sigma: float = 4.0) -> DataFrame:
    """m, y, n, merged, weight: sums over each row of samples merged with those of other frames, and of the weights they rest on.

    A sample's frames lie in its row, so rows are merged where they are, in batches. others gives the other frames' rows from the
    rows' numbers and samples, variance that of a difference.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            raw = np.stack(part["raw"].to_numpy()).astype(float)
            total, weight = raw.copy(), np.ones_like(raw)
            for frame in others(part["y"].to_numpy()[:, None], raw):
                w = np.clip(1 - (frame - raw) ** 2 / np.maximum(sigma * sigma * variance(raw), 1e-9), 0, 1) ** 2
                total, weight = total + w * frame, weight + w
            yield pd.DataFrame({"m": part["m"], "y": part["y"], "n": raw.shape[1], "merged": (total / weight).sum(1), "weight": weight.sum(1)})

    return rows.select("m", "y", "raw").mapInPandas(run, "m int, y int, n int, merged double, weight double")
