"""Queries on whole frames, by Arrow; SQL cannot express them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessera.operators import frames
from tessera.plans.registry import query
from tessera.sources.standins import sensor_rows, table


@query(None)
def advanced_demosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of each channel of each frame by each method."""

    def run(raw: np.ndarray) -> pd.DataFrame:
        rgb = {k: frames.demosaic(raw << 6, k) for k in frames.RADIUS}
        return pd.DataFrame([(k, c, int(v[..., c].sum())) for k, v in rgb.items() for c in range(3)], columns=["method", "channel", "total"])

    return frames.by_frame(sensor_rows(spark, sf_dir), run, "method string, channel int, total long")


@query(None)
def depth_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of least regularised cost: each row of a frame holds 8 nodes of 8 labels' costs."""

    def run(raw: np.ndarray) -> pd.DataFrame:
        costs = raw.reshape(len(raw), 8, 8) / 1023
        label = frames.semi_global(costs, costs.mean(2)).argmin(2)
        y, x = np.indices(label.shape)
        return pd.DataFrame({"y": y.ravel(), "x": x.ravel(), "label": label.ravel()})

    return frames.by_frame(sensor_rows(spark, sf_dir), run, "y int, x int, label int")


@query(None)
def robust_homography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand a map between its points and where a known map puts them, one in five being elsewhere."""
    known = np.array([[1.02, 0.03, 5.0], [-0.02, 0.98, -7.0], [1e-5, 2e-5, 1.0]])

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("p_partkey")
        a = np.stack([part["p_partkey"] * 37 % 1009, part["p_partkey"] * 91 % 757], 1).astype(float)
        b = frames.moved_points(known, a) + np.where(part["p_partkey"].to_numpy()[:, None] // 25 % 5 == 0, 40.0 + a % 90, 0.0)
        found = frames.robust_homography(a, b)
        return pd.DataFrame([(key[0], len(a), 0 if found is None else int(found[1].sum()))], columns=["p_brand", "points", "inliers"])

    return table(spark, sf_dir, "part").select("p_brand", "p_partkey").groupBy("p_brand").applyInPandas(run, "p_brand string, points long, inliers long")
