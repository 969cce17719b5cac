"""All registered queries with the SQL that must give the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import optics
from tessera.operators import bands, catalog, histogram, lookup, ordered, photometric, raster
from tessera.plans import capture, multiview, photometry, views  # noqa: F401 (they register their queries)
from tessera.plans.registry import oracle_sql, queries  # noqa: F401
from tessera.plans.registry import query as _query
from tessera.sources import container
from tessera.sources.standins import MODULE_ROWS, WIDTH, pixels, sensor_rows, table

# Raster


@_query(
    """+ o AS (SELECT unnest(range(-2, 3)) AS d), c AS (SELECT * FROM px WHERE sev >= 16),
a AS (SELECT c.m, c.y, c.x, c.raw, c.sev, c.y % 2 + 2 * (CASE WHEN c.y // 2 + p.d < 0 THEN -(c.y // 2 + p.d) WHEN c.y // 2 + p.d >= 50 THEN 98 - (c.y // 2 + p.d) ELSE c.y // 2 + p.d END) AS ny,
  c.x % 2 + 2 * (CASE WHEN c.x // 2 + q.d < 0 THEN -(c.x // 2 + q.d) WHEN c.x // 2 + q.d >= 32 THEN 62 - (c.x // 2 + q.d) ELSE c.x // 2 + q.d END) AS nx FROM c, o p, o q),
s AS (SELECT a.m, a.y, a.x, a.raw, a.sev, list_sort(list(px.raw)) AS s FROM a JOIN px ON px.m = a.m AND px.y = a.ny AND px.x = a.nx GROUP BY ALL),
p AS (SELECT m, raw, sev, s[13] AS pred, list_sort(list_transform(s, lambda v: abs(v - s[13])))[13] AS mad FROM s),
r AS (SELECT *, (CASE WHEN sev = 255 THEN abs(raw - pred) ELSE raw - pred END) > greatest(6.0 * greatest(mad, 1), 4) AS gone FROM p)
SELECT m, count(*) AS candidates, count(*) FILTER (gone) AS corrected, CAST(coalesce(sum(abs(raw - pred)) FILTER (gone), 0) AS BIGINT) AS total_delta,
  CAST(coalesce(max(abs(raw - pred)) FILTER (gone), 0) AS BIGINT) AS max_delta, CAST(sum(pred) AS BIGINT) AS sum_pred, CAST(sum(mad) AS BIGINT) AS sum_mad FROM r GROUP BY m""",
    px=True,
)
def hotpixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bands.corrected(sensor_rows(spark, sf_dir), MODULE_ROWS).groupBy("m").agg(
        *(F.sum(c).cast("long").alias(c) for c in ("candidates", "corrected", "total_delta", "sum_pred", "sum_mad")), F.max("max_delta").alias("max_delta")
    )


@_query(
    """+ k AS (SELECT *, CASE WHEN y % 2 = x % 2 THEN CASE WHEN y % 2 = 0 THEN 0 ELSE 2 END ELSE 1 END AS c FROM px), o AS (SELECT unnest(range(-1, 2)) AS d),
n AS (SELECT a.m, a.y, a.x, a.raw, a.c AS own, b.c, sum(b.raw) AS s, count(*) AS n FROM k a, o p, o q, k b WHERE b.m = a.m AND b.y = a.y + p.d AND b.x = a.x + q.d GROUP BY ALL),
v AS (SELECT m, y, x, c, CASE WHEN own = c THEN raw ELSE (s + n // 2) // n END AS v FROM n)
SELECT m, CAST(c AS INT) AS c, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (y * 64 + x + 1)) AS BIGINT) AS weighted FROM v GROUP BY m, c""",
    px=True,
)
def simple_demosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v)
    sums = lambda k, c: F.struct(F.lit(k).alias("c"), total(F.col(c)).alias("t"), total(F.transform(c, lambda v, x: v * (x + 1))).alias("w"))
    v = bands.demosaiced(sensor_rows(spark, sf_dir), MODULE_ROWS)
    v = v.select("m", "y", F.inline(F.array(*(sums(k, c) for k, c in enumerate(("red", "green", "blue"))))))
    return v.groupBy("m", "c").agg(F.sum("t").alias("total"), F.sum(F.col("w") + F.col("t") * F.col("y") * WIDTH).alias("weighted"))


@_query("SELECT m, CAST(sum(raw << 6) AS BIGINT) AS q6, CAST(sum(((raw << 6) + 1) // 2) AS BIGINT) AS reserved, round(avg(greatest(0, (raw - 42) / 981.0)), 6) AS normal FROM px GROUP BY m", px=True)
def q6_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(sensor_rows(spark, sf_dir)).withColumn("q6", F.shiftleft("raw", 6))
    return p.groupBy("m").agg(
        F.sum("q6").cast("long").alias("q6"), F.sum(F.expr("(q6 + 1) div 2")).cast("long").alias("reserved"), F.round(F.avg(F.greatest(F.lit(0.0), (F.col("raw") - 42) / 981.0)), 6).alias("normal")
    )


@_query("SELECT m, CAST(sum(CASE WHEN y % 2 = x % 2 THEN raw END) AS BIGINT) AS colour, CAST(sum((99 - y) * 64 + 63 - x) FILTER (raw = 512) AS BIGINT) AS turned FROM px GROUP BY m", px=True)
def cfa_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(sensor_rows(spark, sf_dir))
    turned = (MODULE_ROWS - 1 - F.col("y")) * WIDTH + WIDTH - 1 - F.col("x")
    return p.groupBy("m").agg(F.sum(F.when(F.expr("y % 2 = x % 2"), F.col("raw"))).cast("long").alias("colour"), F.sum(F.when(F.col("raw") == 512, turned)).cast("long").alias("turned"))


@_query("+ h AS (SELECT m, y // 2 AS y, x // 2 AS x, sum(raw) / 4.0 AS mean FROM px GROUP BY ALL) SELECT m, round(avg(ln(1 + 1000 * mean / 1023.0)), 6) AS luma, count(*) AS cells FROM h GROUP BY m", px=True)
def log_luma_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.halved(sensor_rows(spark, sf_dir)).groupBy("m").agg(F.round(F.avg("luma"), 6).alias("luma"), F.count(F.lit(1)).alias("cells"))


@_query(
    """+ l AS (SELECT m, y, x, CAST(lag(raw) OVER v + lead(raw) OVER v + lag(raw) OVER h + lead(raw) OVER h - 4 * raw AS BIGINT) AS v FROM px
  WINDOW v AS (PARTITION BY m, x ORDER BY y), h AS (PARTITION BY m, y ORDER BY x))
SELECT m, round(sum(v * v) / count(*), 6) AS energy FROM l WHERE y % 2 = 1 AND x % 2 = 1 AND v IS NOT NULL GROUP BY m""",
    px=True,
)
def laplacian_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.laplacian(sensor_rows(spark, sf_dir), MODULE_ROWS, WIDTH).select("m", F.round("energy", 6).alias("energy"))


@_query(
    """+ k AS (SELECT m, raw, CASE WHEN y % 2 = x % 2 THEN CASE WHEN y % 2 = 0 THEN 'R' ELSE 'B' END ELSE 'G' END AS channel FROM px)
SELECT m, channel, count(*) AS samples, count(*) FILTER (raw >= 800) AS clipped, count(*) FILTER (raw >= 700 AND raw < 800) AS feathered,
  CAST(sum(CAST(round(255 * greatest(0, least(1, (800 - raw) / 100.0))) AS INT)) AS BIGINT) AS confidence FROM k GROUP BY m, channel""",
    px=True,
)
def channel_clip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(sensor_rows(spark, sf_dir)).withColumn("channel", F.expr("CASE WHEN y % 2 = x % 2 THEN CASE WHEN y % 2 = 0 THEN 'R' ELSE 'B' END ELSE 'G' END"))
    sure = F.round(255 * optics.clamp((800 - F.col("raw")) / 100.0, 0.0, 1.0)).cast("int")
    return p.groupBy("m", "channel").agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("raw") >= 800).alias("clipped"), F.count_if(F.expr("raw >= 700 AND raw < 800")).alias("feathered"), F.sum(sure).cast("long").alias("confidence")
    )


@_query(
    """+ f AS (SELECT m, y, x, raw + ((13 * k + 7 * y + 3 * x) % 41) - 20 + CASE WHEN (y + x + k) % 97 = 0 THEN 400 ELSE 0 END AS v, raw, k FROM px, (SELECT unnest(range(1, 4)) AS k)),
w AS (SELECT *, greatest(0.0, 1.0 - (v - raw) * (v - raw) / (16.0 * (0.2 * raw + 4.0))) AS r FROM f),
s AS (SELECT m, y, x, (any_value(raw) + sum(r * r * v)) / (1 + sum(r * r)) AS merged, 1 + sum(r * r) AS weight FROM w GROUP BY ALL)
SELECT m, round(avg(merged), 6) AS merged, round(avg(weight), 6) AS weight FROM s GROUP BY m""",
    px=True,
)
def burst_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = np.arange(WIDTH)
    others = lambda y, raw: [raw + (13 * k + 7 * y + 3 * x) % 41 - 20 + 400 * ((y + x + k) % 97 == 0) for k in (1, 2, 3)]
    rows = photometric.merged(sensor_rows(spark, sf_dir), others, lambda v: 0.2 * v + 4.0)
    return rows.groupBy("m").agg(*(F.round(F.sum(c) / F.sum("n"), 6).alias(c) for c in ("merged", "weight")))


@_query("SELECT m, y, CAST(sum(raw * (x + 1)) AS BIGINT) AS weighted, count(*) AS samples FROM px GROUP BY m, y", px=True)
def raw10_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = sensor_rows(spark, sf_dir).select("m", "y", F.pandas_udf(lambda rows: rows.map(container.pack10), "binary")("raw").alias("p"))
    unpack = F.pandas_udf(lambda rows: rows.map(lambda b: container.unpack10(b).astype("int32")), "array<int>")
    read = packed.select("m", "y", unpack("p").alias("v"))
    weighted = F.aggregate(F.transform("v", lambda v, x: v * (x + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return read.groupBy("m", "y").agg(F.sum(weighted).alias("weighted"), F.sum(F.size("v")).cast("long").alias("samples"))


# Order statistics


@_query(
    """+ s AS (SELECT m, list_sort(list(raw)) AS a, len(list(raw)) AS n FROM px GROUP BY m)
SELECT m, a[CAST(floor((n - 1) * 0.995) AS INT) + 1] AS floor_share, a[CAST(n * 995 // 1000 AS INT) + 1] AS thousandths, a[CAST(ceil(n * 0.9) AS INT)] AS nearest_rank,
  a[n // 2 + 1] AS upper_median, (a[(n - 1) // 2 + 1] + a[n // 2 + 1]) / 2.0 AS averaged_median,
  list_sort(list_transform(a, lambda v: abs(v - a[n // 2 + 1])))[n // 2 + 1] AS deviation,
  round(list_sum(list_transform(a[CAST(floor(n * 0.1) AS INT) + 1:n - CAST(floor(n * 0.1) AS INT)], lambda v: CAST(v AS DOUBLE))) / (n - 2 * CAST(floor(n * 0.1) AS INT)), 6) AS trimmed FROM s""",
    px=True,
)
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read off counts by code: a module's samples are counted where they are, and its codes, of which there are 1024, meet."""
    counts = pixels(sensor_rows(spark, sf_dir)).groupBy("m", "raw").agg(F.count(F.lit(1)).alias("n"))
    h = counts.groupBy("m").agg(F.array_sort(F.collect_list(F.struct(F.col("raw").alias("v"), "n"))).alias("h"), F.sum("n").alias("n"))
    n = F.col("n")
    at = lambda place: histogram.at(F.col("h"), place)
    h = h.withColumn("middle", at(F.floor(n / 2)))
    return h.select(
        "m",
        at(F.floor((n - 1) * 0.995)).alias("floor_share"),
        at(F.floor(n * 995 / 1000)).alias("thousandths"),
        at(F.ceil(n * 0.9) - 1).alias("nearest_rank"),
        F.col("middle").alias("upper_median"),
        ((at(F.floor((n - 1) / 2)) + F.col("middle")) / 2.0).alias("averaged_median"),
        histogram.at(F.array_sort(F.transform("h", lambda e: F.struct(F.abs(e["v"] - F.col("middle")).alias("v"), e["n"].alias("n")))), F.floor(n / 2)).alias("deviation"),
        F.round(histogram.trimmed_mean(F.col("h"), n, 0.1), 6).alias("trimmed"),
    )


@_query("SELECT m, round(quantile_cont(raw, 0.1), 6) AS p10, round(quantile_cont(raw, 0.5), 6) AS p50, round(quantile_cont(raw, 0.9), 6) AS p90, CAST(sum(raw) AS BIGINT) AS total, count(*) AS n FROM px GROUP BY m", px=True)
def five_number_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels(sensor_rows(spark, sf_dir))
    q = lambda x: F.round(F.percentile("raw", F.lit(x)), 6)
    return p.groupBy("m").agg(q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.sum("raw").cast("long").alias("total"), F.count(F.lit(1)).alias("n"))


@_query(
    """WITH r AS (SELECT p_brand, p_retailprice AS v, p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey ROWS UNBOUNDED PRECEDING) AS run, sum(p_size) OVER (PARTITION BY p_brand) AS total FROM part)
SELECT p_brand, min(v) AS weighted_median FROM r WHERE 2 * run >= total GROUP BY p_brand"""
)
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.weighted_middle(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", "p_size", "weighted_median")


@_query(
    """WITH s AS (SELECT l_returnflag, l_quantity AS t, l_extendedprice AS y FROM lineitem)
SELECT l_returnflag, round((count(*) * sum(t * y) - sum(t) * sum(y)) / (count(*) * sum(t * t) - sum(t) * sum(t)), 4) AS slope, count(*) AS n FROM s GROUP BY l_returnflag"""
)
def temperature_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").alias("t"), F.col("l_extendedprice").alias("y"))
    n, t, y, ty, tt = F.count(F.lit(1)), F.sum("t"), F.sum("y"), F.sum(F.col("t") * F.col("y")), F.sum(F.col("t") * F.col("t"))
    return s.groupBy("l_returnflag").agg(F.round((n * ty - t * y) / (n * tt - t * t), 4).alias("slope"), n.alias("n"))


# Scalars


@_query(
    """SELECT p_partkey, round(CASE WHEN v <= 0.0031308 THEN 12.92 * v ELSE 1.055 * pow(v, 1 / 2.4) - 0.055 END, 6) AS srgb, round(v * v * (3 - 2 * v), 6) AS smooth,
  round(CASE WHEN abs(v - 0.5) <= 0.2 THEN 0.5 * (v - 0.5) * (v - 0.5) ELSE 0.2 * (abs(v - 0.5) - 0.1) END, 6) AS huber, round(v * (1 + v * v * (0.1 + v * v * (-0.02 + v * v * 0.003))), 6) AS bent
FROM (SELECT p_partkey, greatest(0.0, least(1.0, p_retailprice / 2000.0)) AS v FROM part)"""
)
def transfer_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    return table(spark, sf_dir, "part").select("p_partkey", optics.clamp(F.col("p_retailprice") / 2000.0, 0.0, 1.0).alias("v")).select(
        "p_partkey", F.round(optics.srgb(v), 6).alias("srgb"), F.round(optics.smoothstep(v), 6).alias("smooth"), F.round(optics.huber(v - 0.5, 0.2), 6).alias("huber"), F.round(optics.distort(v, 0.1, -0.02, 0.003), 6).alias("bent")
    )


_LAB = "SELECT p_partkey, CAST(p_size AS DOUBLE) + 20 AS l1, CAST(p_partkey % 61 - 30 AS DOUBLE) AS a1, CAST(p_partkey % 47 - 20 AS DOUBLE) AS b1, CAST(p_size AS DOUBLE) + 22 AS l2, CAST(p_partkey % 59 - 25 AS DOUBLE) AS a2, CAST(p_partkey % 43 - 22 AS DOUBLE) AS b2 FROM part"


@_query(
    f"""WITH s AS ({_LAB}), g AS (SELECT *, 0.5 * (1 - sqrt(pow((sqrt(a1*a1+b1*b1) + sqrt(a2*a2+b2*b2)) / 2, 7) / (pow((sqrt(a1*a1+b1*b1) + sqrt(a2*a2+b2*b2)) / 2, 7) + pow(25.0, 7)))) AS g FROM s),
p AS (SELECT *, a1 * (1 + g) AS p1, a2 * (1 + g) AS p2 FROM g),
c AS (SELECT *, sqrt(p1*p1+b1*b1) AS c1, sqrt(p2*p2+b2*b2) AS c2, CASE WHEN b1 = 0 AND p1 = 0 THEN 0 ELSE fmod(degrees(atan2(b1, p1)) + 360, 360) END AS h1, CASE WHEN b2 = 0 AND p2 = 0 THEN 0 ELSE fmod(degrees(atan2(b2, p2)) + 360, 360) END AS h2 FROM p),
d AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, (l1 + l2) / 2 AS lm, (c1 + c2) / 2 AS cm,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm FROM c),
t AS (SELECT *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)) AS t FROM d),
q AS (SELECT p_partkey, (l2 - l1) / (1 + 0.015 * (lm - 50) * (lm - 50) / sqrt(20 + (lm - 50) * (lm - 50))) AS x, (c2 - c1) / (1 + 0.045 * cm) AS y, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * cm * t) AS z,
  -sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) * 2 * sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0, 7))) AS rt FROM t)
SELECT p_partkey, round(sqrt(x*x + y*y + z*z + rt*y*z), 6) AS delta FROM q"""
)
def delta_e00(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    lab = part.selectExpr(
        "p_partkey", "CAST(p_size AS DOUBLE) + 20 AS l1", "CAST(p_partkey % 61 - 30 AS DOUBLE) AS a1", "CAST(p_partkey % 47 - 20 AS DOUBLE) AS b1", "CAST(p_size AS DOUBLE) + 22 AS l2", "CAST(p_partkey % 59 - 25 AS DOUBLE) AS a2", "CAST(p_partkey % 43 - 22 AS DOUBLE) AS b2"
    )
    return lab.select("p_partkey", F.round(optics.delta_e00(*(F.col(c) for c in ("l1", "a1", "b1", "l2", "a2", "b2"))), 6).alias("delta"))


@_query(
    """SELECT p_partkey, regexp_replace(p_name || '/' || p_type, '[^A-Za-z0-9._-]', '_', 'g') AS stem, sha256(p_name || chr(31) || p_brand || chr(31) || CAST(p_size AS VARCHAR)) AS identity,
  CASE WHEN p_size % 3 = 0 THEN 10 * 4160 * 3120 ELSE CAST(p_size * 64 * 48 * (CASE WHEN p_size % 2 = 0 THEN 2 ELSE 6 END) AS BIGINT) END AS bytes FROM part"""
)
def capture_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    width = F.when(F.col("p_size") % 3 != 0, F.col("p_size") * 64)
    return p.select(
        "p_partkey",
        catalog.safe_stem(F.concat_ws("/", "p_name", "p_type")).alias("stem"),
        catalog.identity(F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")).alias("identity"),
        catalog.export_bytes(width, F.lit(48), F.col("p_size") % 2 == 0).alias("bytes"),
    )


# Lookups


@_query(
    """WITH n AS (SELECT CAST(p_size AS DOUBLE) AS g, avg(p_retailprice) AS v FROM part WHERE p_size % 5 = 0 GROUP BY 1),
r AS (SELECT DISTINCT l_quantity AS q FROM lineitem), b AS (SELECT q, max(g) FILTER (g <= q) AS lo, min(g) FILTER (g > q) AS hi, arg_max(v, g) FILTER (g <= q) AS vl, arg_min(v, g) FILTER (g > q) AS vh FROM r, n GROUP BY q)
SELECT q, round(CASE WHEN lo IS NULL THEN vh WHEN hi IS NULL THEN vl ELSE vl + (q - lo) / (hi - lo) * (vh - vl) END, 4) AS noise FROM b"""
)
def noise_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").where("p_size % 5 = 0").groupBy(F.col("p_size").cast("double").alias("g")).agg(F.avg("p_retailprice").alias("v"))
    asked = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("q")).distinct()
    return lookup.bracketed(asked, nodes, "q", "g", "v", "noise").select("q", F.round("noise", 4).alias("noise"))


@_query("+ b(lo, hi, excess) AS (VALUES (16, 64, 1), (64, 128, 3), (128, 255, 9)) SELECT m, excess, count(*) AS n, CAST(sum(raw) AS BIGINT) AS total FROM px JOIN b ON sev >= lo AND sev < hi GROUP BY m, excess", px=True)
def severity_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([(16, 64, 1), (64, 128, 3), (128, 255, 9)], "lo int, hi int, excess int")
    return lookup.banded(pixels(sensor_rows(spark, sf_dir)), bands, "sev").groupBy("m", "excess").agg(F.count(F.lit(1)).alias("n"), F.sum("raw").cast("long").alias("total"))


@_query(
    """+ g AS (SELECT i, CAST((37 * i) % 101 AS DOUBLE) AS v FROM (SELECT unnest(range(0, 48)) AS i)),
q AS (SELECT m, y, x, greatest(0.0, least(7.0, (x + 0.5) * 8 / 64 - 0.5)) AS px, greatest(0.0, least(5.0, (y + 0.5) * 6 / 100 - 0.5)) AS py FROM px),
k AS (SELECT *, CAST(floor(px) AS INT) AS x0, CAST(floor(py) AS INT) AS y0, least(CAST(floor(px) AS INT) + 1, 7) AS x1, least(CAST(floor(py) AS INT) + 1, 5) AS y1, px - floor(px) AS fx, py - floor(py) AS fy FROM q)
SELECT m, round(avg((a.v * (1 - fx) + b.v * fx) * (1 - fy) + (c.v * (1 - fx) + d.v * fx) * fy), 6) AS glow FROM k JOIN g a ON a.i = y0 * 8 + x0 JOIN g b ON b.i = y0 * 8 + x1 JOIN g c ON c.i = y1 * 8 + x0 JOIN g d ON d.i = y1 * 8 + x1 GROUP BY m""",
    px=True,
)
def grid4_glow(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = F.expr("transform(sequence(0, 47), i -> CAST((37 * i) % 101 AS DOUBLE))")
    value = lookup.four_corners(grid, 8, lookup.grid_position(F.col("x"), 8, WIDTH), lookup.grid_position(F.col("y"), 6, MODULE_ROWS), 6)
    return pixels(sensor_rows(spark, sf_dir)).groupBy("m").agg(F.round(F.avg(value), 6).alias("glow"))


@_query(
    """WITH r AS (SELECT s_nationkey AS k, s_suppkey AS prio, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS pose, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS mirror FROM supplier)
SELECT k, arg_min(pose, prio) FILTER (pose IS NOT NULL) AS pose, arg_min(mirror, prio) FILTER (mirror IS NOT NULL) AS mirror FROM r GROUP BY k"""
)
def first_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS k", "s_suppkey AS prio", "CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS pose", "CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS mirror")
    return lookup.first_good(r, "k", "prio", ["pose", "mirror"])


@_query("SELECT a.m, CAST(sum(b.raw) AS BIGINT) AS nearest FROM px a JOIN px b ON b.m = a.m AND b.y = least(96, 8 * CAST(round(a.y / 8.0) AS INT)) AND b.x = least(56, 8 * CAST(round(a.x / 8.0) AS INT)) GROUP BY a.m", px=True)
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes are every eighth sample of every eighth row: such a row knows how often each of its nodes is asked for, so nothing is joined."""
    node = lambda at, most: F.least(F.lit(most), 8 * F.round(at / 8.0).cast("int"))
    near = lambda most, size: F.transform(F.sequence(F.lit(0), F.lit(most), F.lit(8)), lambda k: F.size(F.filter(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: node(i, most) == k)))
    rows = sensor_rows(spark, sf_dir).where("y % 8 = 0 AND y <= 96")
    per_row = F.aggregate(F.transform(near(56, WIDTH), lambda n, i: n * F.get("raw", i * 8)), F.lit(0).cast("long"), lambda a, v: a + v)
    return rows.groupBy("m").agg(F.sum(per_row * F.get(near(96, MODULE_ROWS), F.expr("CAST(y div 8 AS INT)"))).alias("nearest"))


@_query("SELECT a.c_nationkey, round(avg(abs(a.c_acctbal - b.c_acctbal)), 4) AS mean_difference, count(DISTINCT a.c_custkey) + 1 AS members FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey GROUP BY a.c_nationkey")
def pair_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.pairs(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_acctbal").select("c_nationkey", F.round("mean_difference", 4).alias("mean_difference"), "members")


# Order within a key


@_query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.first_per_key(table(spark, sf_dir, "events"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type")


@_query(
    """WITH s AS (SELECT l_orderkey AS k, CAST(l_partkey AS BIGINT) AS a, CAST(l_partkey + l_quantity * 3 AS BIGINT) AS b FROM lineitem), n AS (SELECT *, lead(a) OVER (PARTITION BY k ORDER BY a, b) AS next_start FROM s)
SELECT k, a, b, next_start FROM n WHERE next_start < b"""
)
def overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "CAST(l_partkey AS BIGINT) AS a", "CAST(l_partkey + l_quantity * 3 AS BIGINT) AS b")
    return ordered.overlaps(s, "k", "a", "b").select("k", "a", "b", "next_start")


@_query(
    """WITH s AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, value AS v FROM events), d AS (SELECT user_id, (v + lag(v) OVER w) / 2 * (t - lag(t) OVER w) AS step FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t, v))
SELECT user_id, round(coalesce(sum(step), 0), 1) AS integral, count(*) AS samples FROM d GROUP BY user_id"""
)
def gyro_trapezoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value")
    return ordered.trapezoid(s, ["user_id"], "t", "value").select("user_id", F.round("integral", 1).alias("integral"), "samples")


@_query(
    """+ r AS (SELECT m, y, avg(raw) AS v, count(*) OVER (PARTITION BY m) AS n FROM px GROUP BY m, y), d AS (SELECT unnest([-4, -3, -2, -1, 1, 2, 3, 4]) AS d),
p AS (SELECT m, y, v, CASE WHEN y + 2 * d < 0 THEN -(y + 2 * d) WHEN y + 2 * d >= n THEN 2 * n - 2 - (y + 2 * d) ELSE y + 2 * d END AS q FROM r, d)
SELECT p.m, p.y, round(p.v - quantile_cont(r.v, 0.5), 6) AS high FROM p JOIN r ON r.m = p.m AND r.y = p.q GROUP BY p.m, p.y, p.v""",
    px=True,
)
def high_pass_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = sensor_rows(spark, sf_dir).select("m", "y", (F.aggregate("raw", F.lit(0), lambda a, v: a + v) / F.size("raw")).alias("v"))
    return ordered.high_pass(means, ["m"], "y", "v", 4).select("m", "y", F.round("high", 6).alias("high"))


@_query(
    """WITH n AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) - 1 AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT c_mktsegment, c_custkey FROM n WHERE r IN (SELECT CAST(floor(i * (n.n - 1) / 6.0) AS BIGINT) FROM (SELECT unnest(range(0, 7)) AS i))"""
)
def stratified_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.strata(table(spark, sf_dir, "customer"), "c_mktsegment", F.col("c_acctbal"), F.col("c_custkey"), count=7).select("c_mktsegment", "c_custkey")


@_query(
    """WITH n AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, event_id FROM n WHERE r % CAST(ceil(n / 64.0) AS BIGINT) = 0"""
)
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.stride(table(spark, sf_dir, "events"), "event_type", F.col("ts"), F.col("event_id"), most=64).select("event_type", "event_id")


@_query(
    """WITH r AS (SELECT o_custkey, o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS size, sum(CAST(round(o_totalprice) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS total FROM orders)
SELECT o_custkey, o_orderkey, CAST(total AS BIGINT) AS total FROM r WHERE total <= 1000000"""
)
def lru_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.round("o_totalprice").cast("long").alias("size"))
    return ordered.newest_within(o, "o_custkey", "size", 1_000_000, F.col("o_orderdate").desc(), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "total")


# Catalogue


@_query(
    """WITH u AS (SELECT o_custkey AS k, o_orderkey, o_orderdate, 0 AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey, o_orderkey, o_orderdate, 1 FROM orders WHERE o_orderkey % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY o_orderdate DESC, n DESC, o_orderkey DESC) AS r FROM u) SELECT k, o_orderkey FROM r WHERE r = 1"""
)
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey AS k", "o_orderkey", "struct(o_orderdate, o_orderkey % 2 AS side, o_orderkey AS seq) AS version")
    return catalog.upserted(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "k", "version").select("k", "o_orderkey")


@_query("SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def distinct_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority").distinct()


@_query("SELECT CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS bytes, count(*) AS entries FROM documents")
def cache_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.usage(table(spark, sf_dir, "documents"), "n_chars")


@_query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def pending_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.pending(table(spark, sf_dir, "customer"), done, "c_custkey").select("c_custkey", "c_mktsegment")


@_query(
    """WITH a AS (SELECT lower(split_part(c_name, '#', 2)) AS stem, c_custkey FROM customer), b AS (SELECT lower(split_part(s_name, '#', 2)) AS stem, s_suppkey FROM supplier)
SELECT coalesce(a.stem, b.stem) AS stem, c_custkey, s_suppkey FROM a FULL JOIN b ON a.stem = b.stem"""
)
def stem_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = lambda t, c, k: table(spark, sf_dir, t).select(F.lower(F.split_part(c, F.lit("#"), F.lit(2))).alias("stem"), k)
    return stem("customer", F.col("c_name"), "c_custkey").join(stem("supplier", F.col("s_name"), "s_suppkey"), "stem", "full")


@_query("SELECT o_custkey, count(*) AS frames, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY o_custkey HAVING count(*) >= 2")
def burst_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("o_orderpriority").alias("kinds")).where("frames >= 2")
