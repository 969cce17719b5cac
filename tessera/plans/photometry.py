"""Queries on tone, colour, noise, calibration and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import colour, optics
from tessera.operators import fits, histogram, lookup
from tessera.plans.registry import query
from tessera.sources.standins import MODULE_ROWS, WIDTH, pixels, sensor_rows, table


def _px(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(sensor_rows(spark, sf_dir))


def _rounded(columns: dict) -> list:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


@query(
    """+ p AS (SELECT m, list_sort(list(raw))[CAST(floor((count(*) - 1) * 0.995) AS INT) + 1] AS top FROM px GROUP BY m),
v AS (SELECT m, top, greatest(0.0, least(1.0, raw * 0.92 / top)) AS v FROM px JOIN p USING (m)),
s AS (SELECT m, top, CAST(round(255 * (CASE WHEN v <= 0.0031308 THEN 12.92 * v ELSE 1.055 * pow(v, 1 / 2.4) - 0.055 END)) AS INT) AS s FROM v)
SELECT m, top, CAST(sum(s) AS BIGINT) AS total, max(s) AS most FROM s GROUP BY m, top""",
    px=True,
)
def tone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _px(spark, sf_dir)
    top = histogram.value_at(p, ["m"], "raw", F.floor((F.col("n_") - 1) * 0.995), "top")
    shade = F.round(255 * optics.srgb(F.col("raw") * 0.92 / F.col("top"))).cast("int")
    return p.join(top, "m").groupBy("m", "top").agg(F.sum(shade).cast("long").alias("total"), F.max(shade).alias("most"))


@query(
    """+ o AS (SELECT unnest(range(0, 8)) AS o), t AS (SELECT o, m, raw, CASE WHEN o = 0 THEN x WHEN o = 1 THEN 99 - y WHEN o = 2 THEN y WHEN o = 3 THEN 99 - y WHEN o = 4 THEN y WHEN o = 5 THEN x ELSE 63 - x END AS dx,
  CASE WHEN o = 1 THEN x WHEN o IN (2, 3) THEN 63 - x WHEN o = 4 THEN x WHEN o IN (5, 7) THEN 99 - y ELSE y END AS dy FROM px, o)
SELECT CAST(o AS INT) AS o, m, CAST(sum(raw * (dx + 101 * dy)) AS BIGINT) AS placed FROM t GROUP BY o, m""",
    px=True,
)
def orientation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _px(spark, sf_dir).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(7))))
    dx, dy = optics.oriented(F.col("o"), F.col("x"), F.col("y"), WIDTH, MODULE_ROWS)
    return p.groupBy("o", "m").agg(F.sum(F.col("raw") * (dx + 101 * dy)).cast("long").alias("placed"))


_XYZ = "SELECT p_partkey, 0.02 + p_size / 60.0 AS x, 0.01 + p_size / 55.0 AS y, 0.03 + (p_partkey % 50) / 70.0 AS z FROM part"


@query(
    f"""WITH s AS ({_XYZ}), f AS (SELECT p_partkey, [CASE WHEN v > pow(6/29, 3) THEN cbrt(v) ELSE v / (3 * pow(6/29, 2)) + 4/29 END FOR v IN [x / 0.95047, y, z / 1.08883]] AS f FROM s)
SELECT p_partkey, round(116 * f[2] - 16, 6) AS l, round(500 * (f[1] - f[2]), 6) AS a, round(200 * (f[2] - f[3]), 6) AS b FROM f"""
)
def lab_of_xyz(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = colour.xyz_to_lab(*(F.col(c) for c in "xyz"))
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "0.02D + p_size / 60D AS x", "0.01D + p_size / 55D AS y", "0.03D + (p_partkey % 50) / 70D AS z").select("p_partkey", *_rounded(dict(zip("lab", lab, strict=True))))


@query(
    f"""WITH s AS ({_XYZ}), w AS (SELECT p_partkey, least(x * 1.9, 1.0) AS r, least(y * 1.0, 1.0) AS g, least(z * 1.6, 1.0) AS b FROM s),
t AS (SELECT *, greatest(0.0, least(1.0, (greatest(r, g, b) - 0.94) / 0.06)) AS t, list_sort([r, g, b])[2] AS mid FROM w),
c AS (SELECT p_partkey, r + t*t*(3-2*t) * (mid - r) AS r, g + t*t*(3-2*t) * (mid - g) AS g, b + t*t*(3-2*t) * (mid - b) AS b FROM t)
SELECT p_partkey, round(3.2406*r - 1.5372*g - 0.4986*b, 6) AS red, round(-0.9689*r + 1.8758*g + 0.0415*b, 6) AS green, round(0.0557*r - 0.2040*g + 1.0570*b, 6) AS blue FROM c"""
)
def balanced_shoulder(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").selectExpr("p_partkey", "0.02D + p_size / 60D AS x", "0.01D + p_size / 55D AS y", "0.03D + (p_partkey % 50) / 70D AS z")
    one = [F.lit(1.0)] * 3
    rgb = colour.shoulder(colour.balanced([F.col(c) for c in "xyz"], [F.lit(g) for g in (1.9, 1.0, 1.6)], 1.0), one)
    return s.select("p_partkey", *_rounded(dict(zip(("red", "green", "blue"), colour.product(colour.XYZ_TO_SRGB, tuple(rgb)), strict=True))))


@query(
    """SELECT l_orderkey, l_linenumber, round(greatest(0.0002 * l_quantity + 0.001, pow(2 / 255.0, 2)), 8) AS single, round(greatest(0.0002 * l_quantity + 0.001, pow(2 / 255.0, 2)) + 4 * greatest(0.0002 * 2 * l_quantity + 0.001, pow(2 / 255.0, 2)), 8) AS pair,
  round(greatest(0.05, CASE WHEN l_discount * 10 <= 0.45 THEN 0 WHEN l_discount * 10 >= 0.7 THEN 1 ELSE pow((l_discount * 10 - 0.45) / 0.25, 2) * (3 - 2 * (l_discount * 10 - 0.45) / 0.25) END), 6) AS sure,
  round(greatest(0.1, least(4.0, l_quantity / 10)), 6) AS noise FROM lineitem"""
)
def noise_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, a, b = F.col("l_quantity"), F.lit(0.0002), F.lit(0.001)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(colour.single_variance(q, a, b, 2 / 255), 8).alias("single"),
        F.round(colour.pair_variance(q, 2 * q, a, b, F.lit(2.0), 2 / 255), 8).alias("pair"),
        F.round(colour.correspondence_confidence(F.col("l_discount") * 10, 0.45), 6).alias("sure"),
        F.round(colour.noise_confidence(q, F.lit(10.0)), 6).alias("noise"),
    )


@query(
    """+ b AS (SELECT m, y, x, (raw << 6) - CAST(round(64 * (0.5 * (y % 7 - 3) + 0.02 * (m % 5) * (y % 3) + 0.25 * (x % 5 - 2))) AS INT) AS q FROM px)
SELECT m, CAST(sum(greatest(0, least(65535, q))) AS BIGINT) AS total, count(*) FILTER (q < 0) AS below FROM b GROUP BY m""",
    px=True,
)
def cleanup_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's and column's bias at the frame's temperature, taken from the promoted samples."""
    p = _px(spark, sf_dir)
    bias = 0.5 * (F.col("y") % 7 - 3) + 0.02 * (F.col("m") % 5) * (F.col("y") % 3) + 0.25 * (F.col("x") % 5 - 2)
    q = F.shiftleft("raw", 6) - F.round(64 * bias).cast("int")
    return p.groupBy("m").agg(F.sum(F.greatest(F.lit(0), F.least(F.lit(65535), q))).cast("long").alias("total"), F.count_if(q < 0).alias("below"))


@query(
    """+ b(lo, hi, node, excess) AS (VALUES (1, 64, 25, 0.1), (1, 64, 35, 0.3), (1, 64, 45, 1.1), (64, 128, 25, 0.5), (64, 128, 35, 2.0), (64, 128, 45, 6.0), (128, 255, 25, 2.0), (128, 255, 35, 9.0), (128, 255, 45, 30.0)),
t AS (SELECT m, 22 + 5.5 * (m % 6) AS t FROM (SELECT DISTINCT m FROM px)), c AS (SELECT m, greatest(25.0, least(45.0, t)) AS t FROM t),
i AS (SELECT lo, hi, node AS a, lead(node) OVER w AS z, excess AS ea, lead(excess) OVER w AS ez FROM b WINDOW w AS (PARTITION BY lo ORDER BY node)),
e AS (SELECT m, lo, hi, ea + (t - a) / (z - a) * (ez - ea) AS e FROM c JOIN i ON z IS NOT NULL AND t >= a AND (t < z OR z = 45))
SELECT m, count(*) AS active FROM px JOIN e USING (m) WHERE sev >= lo AND sev < hi AND e * 1.5 >= 4 GROUP BY m""",
    px=True,
)
def universal_active_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of a severity whose excess, by the frame's temperature, exposure and gain, comes to the threshold; 0 and 255 never."""
    profile = [(1, 64, (0.1, 0.3, 1.1)), (64, 128, (0.5, 2.0, 6.0)), (128, 255, (2.0, 9.0, 30.0))]
    nodes = spark.createDataFrame([(lo, hi, float(n), e) for lo, hi, es in profile for n, e in zip((25, 35, 45), es, strict=True)], "lo int, hi int, node double, excess double")
    frames = sensor_rows(spark, sf_dir).select("m").distinct().select("m", (22 + 5.5 * (F.col("m") % 6)).alias("t"))
    return lookup.active(_px(spark, sf_dir), lookup.excess_at(frames, nodes), 1.5, 4.0).groupBy("m").agg(F.count(F.lit(1)).alias("active"))


@query(
    """+ g AS (SELECT i, 90.0 * ((37 * i) % 23 - 11) AS l, 300.0 * ((17 * i) % 13 - 6) AS s FROM (SELECT unnest(range(0, 20)) AS i)),
q AS (SELECT m, raw, greatest(0.0, least(4.0, (x + 0.5) * 5 / 64 - 0.5)) AS px, greatest(0.0, least(3.0, (y + 0.5) * 4 / 100 - 0.5)) AS py FROM px),
k AS (SELECT *, CAST(floor(px) AS INT) AS x0, CAST(floor(py) AS INT) AS y0, least(CAST(floor(px) AS INT) + 1, 4) AS x1, least(CAST(floor(py) AS INT) + 1, 3) AS y1, px - floor(px) AS fx, py - floor(py) AS fy FROM q),
v AS (SELECT m, raw, (1-fy) * ((1-fx) * (a.l/256 + 6.0*a.s/4096) + fx * (b.l/256 + 6.0*b.s/4096)) + fy * ((1-fx) * (c.l/256 + 6.0*c.s/4096) + fx * (d.l/256 + 6.0*d.s/4096)) AS glow
  FROM k JOIN g a ON a.i = y0*5+x0 JOIN g b ON b.i = y0*5+x1 JOIN g c ON c.i = y1*5+x0 JOIN g d ON d.i = y1*5+x1)
SELECT m, CAST(sum(greatest(0, least(65535, (raw << 6) - CAST(round(64 * glow) AS INT)))) AS BIGINT) AS total FROM v GROUP BY m""",
    px=True,
)
def glow_subtraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.expr("transform(sequence(0, 19), i -> 90D * ((37 * i) % 23 - 11) / 256 + 6D * 300 * ((17 * i) % 13 - 6) / 4096)")
    glow = lookup.four_corners(grid, 5, lookup.grid_position(F.col("x"), 5, WIDTH), lookup.grid_position(F.col("y"), 4, MODULE_ROWS), 4)
    left = F.shiftleft("raw", 6) - F.round(64 * glow).cast("int")
    return _px(spark, sf_dir).groupBy("m").agg(F.sum(F.greatest(F.lit(0), F.least(F.lit(65535), left))).cast("long").alias("total"))


@query("+ l AS (SELECT m, y // 4 AS y, x // 4 AS x, avg(raw) AS v FROM px GROUP BY ALL) SELECT m, count(*) AS cells, round(sum(v * (x + 1)), 4) AS weighted FROM l GROUP BY m", px=True)
def pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second level of halves: a level of whole cells is a mean of means, so any level is one aggregation."""
    cells = _px(spark, sf_dir).groupBy("m", F.expr("y div 4").alias("y"), F.expr("x div 4").alias("x")).agg(F.avg("raw").alias("v"))
    return cells.groupBy("m").agg(F.count(F.lit(1)).alias("cells"), F.round(F.sum(F.col("v") * (F.col("x") + 1)), 4).alias("weighted"))


@query(
    """+ u AS (SELECT * FROM px WHERE sev < 200), r AS (SELECT m, y, avg(raw) AS a FROM u GROUP BY ALL), c AS (SELECT m, x, avg(raw - a) AS b FROM u JOIN r USING (m, y) GROUP BY ALL)
SELECT m, x, round(b, 6) AS column_mean FROM c""",
    px=True,
)
def line_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's mean is taken in the row; residuals are summed up by column before they are shuffled."""
    used = F.filter(F.arrays_zip("raw", "sev"), lambda e: e["sev"] < 200)
    rows = sensor_rows(spark, sf_dir).withColumn("mean", F.aggregate(used, F.lit(0.0), lambda a, e: a + e["raw"]) / F.size(used))
    left = rows.select("m", F.inline(F.filter(F.transform(F.arrays_zip("raw", "sev"), lambda e, x: F.struct(x.alias("x"), (e["raw"] - F.col("mean")).alias("d"), e["sev"].alias("sev"))), lambda e: e["sev"] < 200)))
    return left.groupBy("m", "x").agg(F.round(F.avg("d"), 6).alias("column_mean"))


@query(
    """WITH s AS (SELECT c_nationkey AS k, CAST(c_custkey % 7 - 3 AS DOUBLE) AS t, c_acctbal AS y FROM customer),
g AS (SELECT k, count(*) AS t0, sum(t) AS t1, sum(t*t) AS t2, sum(t*t*t) AS t3, sum(t*t*t*t) AS t4, sum(y) AS y0, sum(y*t) AS y1, sum(y*t*t) AS y2 FROM s GROUP BY k),
d AS (SELECT *, t0*(t2*t4-t3*t3) - t1*(t1*t4-t3*t2) + t2*(t1*t3-t2*t2) AS det FROM g)
SELECT k, CASE WHEN abs(det) > 1e-9 THEN round((t0*(y1*t4-t3*y2) - y0*(t1*t4-t3*t2) + t2*(t1*y2-y1*t2)) / det, 6) END AS slope, CASE WHEN abs(det) > 1e-9 THEN round((t0*(t2*y2-y1*t3) - t1*(t1*y2-y1*t2) + y0*(t1*t3-t2*t2)) / det, 6) END AS curvature FROM d"""
)
def quadratic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "customer").selectExpr("c_nationkey AS k", "CAST(c_custkey % 7 - 3 AS DOUBLE) AS t", "c_acctbal AS y")
    return fits.quadratic(s, ["k"], F.col("t"), F.col("y")).select("k", F.round("slope", 6).alias("slope"), F.round("curvature", 6).alias("curvature"))


@query(
    """WITH s AS (SELECT p_brand AS k, p_partkey, CAST(p_size AS DOUBLE) AS t, p_retailprice AS y FROM part),
f AS (SELECT a.k, a.p_partkey, a.t, a.y, avg(b.t) AS mt, avg(b.y) AS my, covar_pop(b.t, b.y) / var_pop(b.t) AS s FROM s a JOIN s b ON a.k = b.k AND a.p_partkey <> b.p_partkey GROUP BY ALL)
SELECT k, round(sqrt(avg(pow(y - my - s * (t - mt), 2))), 4) AS error FROM f GROUP BY k"""
)
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").selectExpr("p_brand AS k", "CAST(p_size AS DOUBLE) AS t", "p_retailprice AS y")
    return fits.left_out(s, ["k"], "t", "y").select("k", F.round("error", 4).alias("error"))


@query(
    """WITH s AS (SELECT p_brand AS k, abs(p_retailprice - 20 * p_size) AS e FROM part), g AS (SELECT k, list_sort(list(e)) AS a, count(*) AS n, avg(e) AS mean FROM s GROUP BY k)
SELECT k, round(mean, 4) AS mean, round((a[(n - 1) // 2 + 1] + a[n // 2 + 1]) / 2, 4) AS median, round(a[CAST(ceil(n * 0.9) AS INT)], 4) AS p90, round(a[n], 4) AS most FROM g"""
)
def error_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), F.abs(F.col("p_retailprice") - 20 * F.col("p_size")).alias("e"))
    columns = {"mean": F.avg("e"), "median": F.median("e"), "p90": F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY e)"), "most": F.max("e")}
    return e.groupBy("k").agg(*(F.round(c, 4).alias(n) for n, c in columns.items()))


@query(
    """+ b AS (SELECT a.m, a.y // 10 AS row_, a.x // 8 AS column_, corr(a.raw, b.raw) AS r FROM px a JOIN px b ON b.m = a.m AND b.y = a.y AND b.x = a.x + 2 GROUP BY ALL)
SELECT m, CAST(row_ AS INT) AS row_, CAST(column_ AS INT) AS column_, round(r, 6) AS r FROM b""",
    px=True,
)
def patch_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised correlation of each patch with itself two samples on; both come from one row's array, so nothing is joined."""
    both = F.expr(f"transform(sequence(0, {WIDTH - 3}), x -> named_struct('x', x, 'a', raw[x], 'b', raw[x + 2]))")
    p = sensor_rows(spark, sf_dir).select("m", F.expr("CAST(y div 10 AS INT)").alias("row_"), F.inline(both))
    return p.groupBy("m", "row_", F.expr("CAST(x div 8 AS INT)").alias("column_")).agg(F.round(F.corr(F.col("a").cast("double"), F.col("b").cast("double")), 6).alias("r"))


@query(
    """WITH o AS (SELECT i / 20.0 AS a, j / 20.0 AS b, (20 - i - j) / 20.0 AS c FROM (SELECT unnest(range(0, 21)) AS i), (SELECT unnest(range(0, 21)) AS j) WHERE i + j <= 20),
p AS (SELECT p_brand AS k, p_size / 50.0 AS u, (p_partkey % 31) / 31.0 AS v, (p_partkey % 17) / 17.0 AS w, p_retailprice / 2000.0 AS y FROM part),
s AS (SELECT k, a, b, avg(least(0.12, abs(a*u + b*v + c*w - y))) + 2e-4 * ((a-1.0/3)*(a-1.0/3) + (b-1.0/3)*(b-1.0/3) + (c-1.0/3)*(c-1.0/3)) AS score FROM p, o GROUP BY k, a, b, c),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(score, 9), a, b) AS r FROM s) SELECT k, a, b, round(score, 6) AS score FROM r WHERE r = 1"""
)
def blend_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 231 blends of three profiles for each group, by capped distance and a weak prior. The blends are a constant."""
    blends = F.array(*(F.struct(F.lit(i / 20).alias("a"), F.lit(j / 20).alias("b"), F.lit((20 - i - j) / 20).alias("c")) for i in range(21) for j in range(21 - i)))
    p = table(spark, sf_dir, "part").selectExpr("p_brand AS k", "p_size / 50D AS u", "(p_partkey % 31) / 31D AS v", "(p_partkey % 17) / 17D AS w", "p_retailprice / 2000D AS y")
    prior = sum((F.pow(F.col(c) - 1 / 3, F.lit(2.0)) for c in "abc"), F.lit(0.0))
    miss = F.least(F.lit(0.12), F.abs(F.col("a") * F.col("u") + F.col("b") * F.col("v") + F.col("c") * F.col("w") - F.col("y")))
    s = p.select("*", F.inline(blends)).groupBy("k", "a", "b", "c").agg(F.avg(miss).alias("d")).withColumn("score", F.col("d") + 2e-4 * prior)
    best = s.groupBy("k").agg(F.min_by(F.struct("a", "b", "score"), F.struct(F.round("score", 9), "a", "b")).alias("s"))
    return best.select("k", "s.a", "s.b", F.round("s.score", 6).alias("score"))


@query(
    """WITH s AS (SELECT c_custkey, -600 + 40 * (c_custkey % 61) AS hall FROM customer), n(h, v) AS (VALUES (0.0, 1.0), (400.0, 3.0), (1000.0, 4.5))
SELECT c_custkey, round(CASE WHEN hall < 400 THEN 1 + hall / 400.0 * 2 ELSE 3 + (hall - 400) / 600.0 * 1.5 END, 6) AS beyond, round(CASE WHEN hall <= 0 THEN 1 WHEN hall >= 1000 THEN 4.5 WHEN hall < 400 THEN 1 + hall / 400.0 * 2 ELSE 3 + (hall - 400) / 600.0 * 1.5 END, 6) AS held FROM s"""
)
def hall_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibration by lens position: one that goes on along its last segments, and one that holds at its ends."""
    nodes = spark.createDataFrame([(0.0, 1.0), (400.0, 3.0), (1000.0, 4.5)], "h double, v double")
    s = table(spark, sf_dir, "customer").select("c_custkey", (-600.0 + 40 * (F.col("c_custkey") % 61)).alias("hall"))
    both = lookup.bracketed(lookup.extrapolated(s, nodes, "hall", "h", "v", "beyond"), nodes, "hall", "h", "v", "held")
    return both.select("c_custkey", F.round("beyond", 6).alias("beyond"), F.round("held", 6).alias("held"))


@query(
    """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS c FROM embeddings),
b AS (SELECT vec_id, arg_min(i, c) AS best, min(c) AS low FROM e GROUP BY vec_id)
SELECT b.vec_id, CAST(b.best AS INT) AS best, round((min(c) FILTER (abs(i - best) > 2) - low) / 8, 6) AS margin FROM b JOIN e USING (vec_id) GROUP BY b.vec_id, best, low"""
)
def depth_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label of least cost, and its margin over the best label that is no neighbour of it."""
    costs = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("c"))
    b = costs.withColumn("low", F.array_min("c")).withColumn("best", (F.array_position("c", F.col("low")) - 1).cast("int"))
    other = F.array_min(F.filter("c", lambda _, i: F.abs(i - F.col("best")) > 2))
    return b.select("vec_id", "best", F.round((other - F.col("low")) / 8, 6).alias("margin"))


@query(
    """WITH r AS (SELECT o_custkey AS k, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
SELECT k, round(avg(v), 4) AS score, count(*) AS support FROM r WHERE r <= 3 GROUP BY k HAVING count(*) >= 2"""
)
def best_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each key's three best scores, where two support it."""
    w = Window.partitionBy("k").orderBy(F.col("v").desc(), "o_orderkey")
    r = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderkey").withColumn("r", F.row_number().over(w)).where("r <= 3")
    return r.groupBy("k").agg(F.round(F.avg("v"), 4).alias("score"), F.count(F.lit(1)).alias("support")).where("support >= 2")
