"""Set operations and state of a catalogue: masks, merges of profiles, generations, changes, tiers of detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged_masks(masks: list[DataFrame], key: list[str], flag: str) -> DataFrame:
    """A place is forced if any mask forces it."""
    rows = masks[0]
    for m in masks[1:]:
        rows = rows.unionByName(m)
    return rows.groupBy(*key).agg(F.bool_or(flag).alias(flag))


def missing_added(profile: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """profile with the rows of other at keys that it lacks."""
    return profile.unionByName(other.join(profile.select(*key).distinct(), key, "left_anti").select(*profile.columns))


def newest_generation(results: DataFrame, by: list[str], generation: str) -> DataFrame:
    """Results of the latest generation of their key; those that came too late go. The latest are summed up before they are joined."""
    latest = results.groupBy(*by).agg(F.max(generation).alias(generation))
    return results.join(latest, [*by, generation], "left_semi")


def changes(states: DataFrame, by: list[str], state: str, *order: Column) -> DataFrame:
    """States that are not what came before them."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(*order))
    return states.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col(state)))


def _smooth(x: str) -> str:
    t = f"greatest(0D, least(1D, {x}))"
    return f"({t} * {t} * (3 - 2 * {t}))"


def tiered(samples: DataFrame, by: list[str], order: str, step: float = 1.2) -> DataFrame:
    """by, detail, cameras, spread, confidence, tier: what samples (tier, value, weight, px, py) of the finest tier say together.

    In order, a sample of a tier over step times the present one starts anew, one under a step-th of it is left out, and so is one
    of next to no weight, which still starts anew. The mean is drawn to the strongest sample where signs agree; confidence comes
    from agreement of signs, size, and, under a tier of 1.35, from two or more cameras in different phases. Keys of too little
    support have no row. The result hangs on the order, so a key's samples (one per module, of which there are few) are sorted
    into an array and folded.
    """
    none = "named_struct('t', 0D, 'v', 0D, 'a', 0D, 'w', 0D, 'x', 0D, 'y', 0D, 'q', 0D, 'n', 0, 'best', 0D, 'score', 0D)"
    added = """named_struct('t', greatest(z.t, e.t), 'v', z.v + e.w * e.v, 'a', z.a + e.w * abs(e.v), 'w', z.w + e.w, 'x', z.x + e.w * e.px, 'y', z.y + e.w * e.py,
      'q', z.q + e.w * (e.px * e.px + e.py * e.py), 'n', z.n + 1, 'best', if(abs(e.v) * sqrt(e.w) > z.score, e.v, z.best), 'score', greatest(z.score, abs(e.v) * sqrt(e.w)))"""
    folded = f"""aggregate(s, {none}, (a, e) -> CASE WHEN a.n > 0 AND e.t * {step} < a.t THEN a
      ELSE transform(array(if(a.n > 0 AND e.t > a.t * {step}, {none}, a)), z -> if(e.w <= 1e-8, z, {added}))[0] END)"""
    s = F.struct(F.col(order).alias("o"), *(F.col(c).cast("double").alias(n) for c, n in (("tier", "t"), ("value", "v"), ("weight", "w"), ("px", "px"), ("py", "py"))))
    sure = _smooth("(n - 1) / 2D") + " * " + _smooth("(spread - 0.04D) / 0.24D")
    return (
        samples.groupBy(*by)
        .agg(F.array_sort(F.collect_list(s)).alias("s"))
        .select(*by, F.expr(folded).alias("f"))
        .select(*by, "f.*")
        .where("w > 1e-8 AND (n >= 2 OR t > 1.35)")
        .withColumn("spread", F.expr("sqrt(greatest(0D, q / w - pow(x / w, 2) - pow(y / w, 2)))"))
        .withColumn("agree", F.expr("abs(v) / greatest(a, 1e-8)"))
        .withColumn("detail", F.expr(f"v / w + if(v * best > 0, 0.55D * {_smooth('(agree - 0.45D) / 0.45D')} * (best - v / w), 0D)"))
        .withColumn("phase", F.expr(f"if(n < 2, 0D, {sure})"))
        .withColumn("confidence", F.expr(f"if(t > 1.35, 0.72D + 0.28D * phase, phase) * {_smooth('(agree - 0.08D) / 0.52D')} * {_smooth('(abs(detail) - 0.00025D) / 0.0025D')}"))
        .select(*by, "detail", F.col("n").alias("cameras"), "spread", "confidence", F.col("t").alias("tier"))
    )
