"""Least squares by sums: one pass of partial aggregation, then a closed form for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quadratic(rows: DataFrame, by: list[str], t: Column, y: Column) -> DataFrame:
    """by, base, slope, curvature of y = base + slope t + curvature t^2; null where t has under three values."""
    s = {f"t{k}": F.sum(F.pow(t, F.lit(float(k)))) for k in range(5)} | {f"y{k}": F.sum(y * F.pow(t, F.lit(float(k)))) for k in range(3)}
    sums = rows.groupBy(*by).agg(*(c.alias(n) for n, c in s.items()))
    det = lambda m: " + ".join(f"({m[0][i]}) * (({m[1][(i + 1) % 3]}) * ({m[2][(i + 2) % 3]}) - ({m[1][(i + 2) % 3]}) * ({m[2][(i + 1) % 3]}))" for i in range(3))
    m = [[f"t{i + j}" for j in range(3)] for i in range(3)]
    part = lambda k: [[f"y{i}" if j == k else m[i][j] for j in range(3)] for i in range(3)]
    return sums.withColumn("det_", F.expr(det(m))).select(*by, *(F.expr(f"CASE WHEN abs(det_) > 1e-9 THEN ({det(part(k))}) / det_ END").alias(n) for k, n in enumerate(("base", "slope", "curvature"))))


def left_out(rows: DataFrame, by: list[str], t: str, y: str) -> DataFrame:
    """by and error: the root mean square of each row's distance from the line through all others of its key.

    The residual of a row against a line that was fitted without it is its residual over one less its leverage, so no fold is
    fitted by itself: the sums of a key are enough.
    """
    n, st, sy = F.count(F.lit(1)), F.sum(t), F.sum(y)
    sums = rows.groupBy(*by).agg(n.alias("n_"), (st / n).alias("mt_"), (sy / n).alias("my_"), F.covar_pop(t, y).alias("c_"), F.var_pop(t).alias("v_"))
    d = F.col(t) - F.col("mt_")
    held = rows.join(sums, by).where("v_ > 0 AND n_ > 2")
    miss = (F.col(y) - F.col("my_") - F.col("c_") / F.col("v_") * d) / (1.0 - 1.0 / F.col("n_") - d * d / (F.col("n_") * F.col("v_")))
    return held.groupBy(*by).agg(F.sqrt(F.avg(miss * miss)).alias("error"))


def line_offsets(rows: DataFrame, image: str, y: str, x: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Means of rows, and of columns after the rows' are taken away: (image, y, row_mean) and (image, x, column_mean)."""
    by_row = rows.groupBy(image, y).agg(F.avg(value).alias("row_mean"))
    rest = rows.join(by_row, [image, y]).groupBy(image, x).agg(F.avg(F.col(value) - F.col("row_mean")).alias("column_mean"))
    return by_row, rest
