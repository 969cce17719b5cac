"""Views over the deterministic tables that play a capture's parts: sensor rows, frames of a burst, motion packets, a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODULE_ROWS, WIDTH = 100, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of 10-bit samples and factory severities for each sensor row: m, y, raw and sev (arrays by x)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.expr(f"CAST(vec_id div {MODULE_ROWS} AS INT)").alias("m"),
        F.expr(f"CAST(vec_id % {MODULE_ROWS} AS INT)").alias("y"),
        F.expr("transform(embedding, v -> CAST(greatest(0D, least(1023D, round(512 + 1024 * CAST(v AS DOUBLE)))) AS INT))").alias("raw"),
        F.expr("transform(embedding, (v, x) -> CAST((131 * vec_id + 17 * x) % 256 AS INT))").alias("sev"),
    )


def pixels(rows: DataFrame) -> DataFrame:
    """Rows of samples as m, y, x, raw, sev."""
    return rows.select("m", "y", F.posexplode(F.arrays_zip("raw", "sev")).alias("x", "p")).select("m", "y", "x", "p.raw", "p.sev")


#: The same in SQL, as common table expressions px and their base.
PX_SQL = f"""base AS (SELECT vec_id vid, generate_subscripts(embedding, 1) - 1 AS x, unnest(embedding)::DOUBLE AS v FROM embeddings),
px AS (SELECT CAST(vid // {MODULE_ROWS} AS INT) m, CAST(vid % {MODULE_ROWS} AS INT) y, CAST(x AS INT) x,
  CAST(greatest(0, least(1023, round(512 + 1024 * v))) AS INT) raw, CAST((131 * vid + 17 * x) % 256 AS INT) sev FROM base)"""
