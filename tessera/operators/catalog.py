"""The catalogue of captures and exports as tables: upserts, histories, sizes and identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """One row of each key, the latest version of either table; a new row wins a tie. Summed up before the shuffle, with no sort."""
    rows = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)))
    own = [c for c in old.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*own), F.struct(version, "new_")).alias("row_")).select(key, "row_.*")


def pending(captures: DataFrame, exports: DataFrame, key: str) -> DataFrame:
    """Captures that no export has."""
    return captures.join(exports.select(key).distinct(), key, "left_anti")


def usage(entries: DataFrame, size: str) -> DataFrame:
    return entries.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.count(F.lit(1)).alias("entries"))


def export_bytes(width: Column, height: Column, mono: Column) -> Column:
    """6 bytes a pixel in colour, 2 in monochrome; ten frames of the sensor's size where dimensions are missing."""
    known = width * height * F.when(mono, 2).otherwise(6)
    return F.coalesce(known, F.lit(10 * 4160 * 3120)).cast("long")


def identity(*parts: Column) -> Column:
    """A hash that names a capture, over its parts and their order."""
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def safe_stem(name: Column) -> Column:
    """A name with what a file name may not hold replaced."""
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")
