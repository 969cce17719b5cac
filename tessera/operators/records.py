"""Records of frames and catalogues: whether a profile holds, edits by key, ids of devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def state(frames: DataFrame, profile: dict) -> DataFrame:
    """frames with refused (why the profile does not hold, or null), the temperature applied, whether it was clamped, and the scale of its levels."""
    right = (F.col("width") == profile["width"]) & (F.col("height") == profile["height"])
    lit = (F.col("exposure_ns") > 0) & (F.col("analog_gain") > 0) & (F.col("digital_gain") > 0)
    refused = F.when(~right, "dimensions").when(~lit | F.lit(min(profile["exposure_ns"], profile["analog_gain"], profile["digital_gain"]) <= 0), "exposure or gain").when(F.col("temperature_c").isNull(), "temperature")
    asked = F.col("temperature_c").cast("double")
    applied = F.greatest(F.lit(float(profile["temperature_min_c"])), F.least(F.lit(float(profile["temperature_max_c"])), asked))
    scale = F.col("exposure_ns") / profile["exposure_ns"] * (F.col("analog_gain") / profile["analog_gain"]) * (F.col("digital_gain") / profile["digital_gain"])
    good = F.col("refused").isNull()
    held = F.when(good, applied)
    return frames.withColumn("refused", refused).withColumn("applied", held).withColumn("clamped", F.when(good, held != asked)).withColumn("scale", F.when(good, scale))


def defect_level(reference: Column, slope: Column, curvature: Column, delta: Column, scale: float) -> Column:
    """A defect's excess, delta degrees from its reference temperature."""
    return (reference + slope * delta + curvature * delta * delta) * scale


def touched(rows: DataFrame, keys: DataFrame, key: str, column: str, now: Column) -> DataFrame:
    """rows with column set to now at these keys; keys that are not there change nothing."""
    hit = keys.select(key).distinct().withColumn("hit_", F.lit(True))
    return rows.join(hit, key, "left").withColumn(column, F.when(F.col("hit_"), now).otherwise(F.col(column))).drop("hit_")


def linked(rows: DataFrame, links: DataFrame, key: str, column: str) -> DataFrame:
    """rows with column from links (one row a key) where they have one."""
    return rows.join(links.select(key, F.col(column).alias("new_")), key, "left").withColumn(column, F.coalesce("new_", column)).drop("new_")


def removed(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return rows.join(keys.select(key), key, "left_anti")


def between(rows: DataFrame, place: str, first: Column, last: Column) -> DataFrame:
    """rows from one place to another, both with it, whichever comes first."""
    return rows.where((F.col(place) >= F.least(first, last)) & (F.col(place) <= F.greatest(first, last)))


def device_id(low: Column, high: Column) -> Column:
    """Both halves of a device's id as 32 hex digits."""
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def with_gold(own: DataFrame, gold: DataFrame) -> DataFrame:
    """Records of modules, then gold records, told apart by origin."""
    return own.withColumn("origin", F.lit("module")).unionByName(gold.withColumn("origin", F.lit("gold")))
