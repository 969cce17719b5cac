"""Scalar functions against published or hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import optics, robust
from tessera.operators import catalog, lookup, ordered


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# Pairs from the published CIEDE2000 test data.
@pytest.mark.parametrize(
    "pair, want",
    [((50, 2.6772, -79.7751, 50, 0, -82.7485), 2.0425), ((50, -1.3802, -84.2814, 50, 0, -82.7485), 1.0), ((50, 0, 0, 50, -1, 2), 2.3669), ((50, 2.5, 0, 50, 0, -2.5), 4.3065), ((2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514), 0.9082)],
)
def test_delta_e00(spark, pair, want):
    assert one(spark, optics.delta_e00(*(F.lit(float(x)) for x in pair))) == pytest.approx(want, abs=5e-5)


def test_order_statistics_differ(spark):
    a = F.array(*(F.lit(x) for x in (9, 1, 5, 3)))
    assert one(spark, robust.upper_median(a)) == 5 and one(spark, robust.averaged_median(a)) == 4.0
    assert one(spark, robust.at_share(a, 0.995)) == 5 and one(spark, robust.at_thousandths(a, 995)) == 9 and one(spark, robust.at_rank(a, 0.9)) == 9
    assert one(spark, robust.trimmed_mean(a, 0.25)) == 4.0 and one(spark, robust.deviation(a, F.lit(5))) == 4


def test_weights(spark):
    assert one(spark, optics.smoothstep(F.lit(0.5))) == 0.5 and one(spark, optics.bisquare(F.lit(4.0), F.lit(1.0))) == 0
    assert one(spark, optics.srgb(F.lit(1.0))) == pytest.approx(1) and one(spark, optics.srgb(F.lit(0.001))) == pytest.approx(0.01292)
    assert one(spark, optics.huber(F.lit(3.0), 1.0)) == 2.5 and math.isclose(one(spark, optics.distort(F.lit(2.0), 0.1, 0.0, 0.0)), 2.8)


def test_bracket_holds_at_the_ends(spark):
    nodes = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0)], "g double, v double")
    rows = spark.createDataFrame([(5.0,), (10.0,), (15.0,), (20.0,), (99.0,)], "q double")
    assert [r.noise for r in lookup.bracketed(rows, nodes, "q", "g", "v", "noise").orderBy("q").collect()] == [1, 1, 2, 3, 3]


def test_upsert_takes_the_new_row_of_a_tie(spark):
    old, new = spark.createDataFrame([(1, 5, "old"), (2, 9, "old")], "k int, t int, v string"), spark.createDataFrame([(1, 5, "new"), (2, 3, "new")], "k int, t int, v string")
    assert {r.k: r.v for r in catalog.upserted(old, new, "k", "t").collect()} == {1: "new", 2: "old"}
    kept = ordered.newest_within(spark.createDataFrame([("a", i, 10) for i in range(5)], "k string, t int, size int"), "k", "size", 30, F.col("t").desc())
    assert {r.t for r in kept.collect()} == {4, 3, 2}


def test_tiers_start_anew(spark):
    from tessera.operators import state

    # key, order, tier, value, weight, phase x, phase y
    rows = [("a", 1, 1.0, 0.1, 1.0, 0.0, 0.0), ("a", 2, 1.1, 0.3, 3.0, 0.4, 0.0), ("b", 1, 1.0, 0.2, 1.0, 0.0, 0.0), ("b", 2, 2.0, 0.05, 2.0, 0.0, 0.0), ("b", 3, 1.0, 9.0, 9.0, 0.0, 0.0)]
    rows += [("c", 1, 1.0, 0.2, 1.0, 0.0, 0.0), ("d", 1, 0.0, 1.0, 0.0, 0.0, 0.0), ("e", 1, 1.0, 0.2, 1.0, 0.0, 0.0), ("e", 2, 1.0, -0.2, 1.0, 0.5, 0.0)]
    got = {r.k: r for r in state.tiered(spark.createDataFrame(rows, "k string, o int, tier double, value double, weight double, px double, py double"), ["k"], "o").collect()}
    assert set(got) == {"a", "b", "e"}  # c has one sample of a low tier, d no weight
    assert got["a"].cameras == 2 and got["a"].detail == pytest.approx(0.25 + 0.55 * (0.3 - 0.25)) and got["a"].spread == pytest.approx((0.12 - 0.09) ** 0.5)
    assert (got["b"].cameras, got["b"].tier, got["b"].detail, got["b"].confidence) == (1, 2.0, pytest.approx(0.05), pytest.approx(0.72))
    assert got["e"].confidence == 0 and got["e"].detail == 0
