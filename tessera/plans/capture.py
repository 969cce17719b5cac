"""Queries from capture files to corrected planes, on records and names of a catalogue, and on geometry and photometry of views."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import colour, geometry, text
from tessera.operators import bands, lookup, photometric, raster, records, recovery
from tessera.plans.registry import query
from tessera.sources import archives, container, metadata, mock
from tessera.sources.standins import MODULE_ROWS, WIDTH, pixels, sensor_rows, table

# From files to planes


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up capture file (path, content) for every two modules of the sensor rows: a plane each for the first two cameras."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["m", "y"])
        planes = {int(m) % 2: np.stack(own["raw"].to_numpy()) for m, own in part.groupby("m")}
        return pd.DataFrame({"path": [f"c{key[0]}.lri"], "content": [mock.capture(planes, reference=min(planes), focal_length=35 + int(key[0]))]})

    rows = sensor_rows(spark, sf_dir).select("m", "y", "raw", F.expr("m div 2").alias("c"))
    return rows.groupBy("c").applyInPandas(run, "path string, content binary")


@query("+ r AS (SELECT 'c' || (m // 2) || '.lri' AS path, CASE WHEN m % 2 = 0 THEN 'A1' ELSE 'A2' END AS camera, y, x, raw FROM px) SELECT path, camera, CAST(sum(raw * (y * 64 + x + 1)) AS BIGINT) AS placed, count(*) AS samples FROM r GROUP BY path, camera", px=True)
def capture_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capture files through blocks, messages and layout to planes of samples."""
    files = _captures(spark, sf_dir)
    spans = metadata.raw_layout(metadata.modules(container.parsed(files)))
    placed = F.aggregate(F.transform("raw", lambda v, x: v * (F.col("y") * WIDTH + x + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    return metadata.plane_rows(files, spans).groupBy("path", "camera").agg(F.sum(placed).alias("placed"), F.sum(F.size("raw")).cast("long").alias("samples"))


@query(
    """+ m AS (SELECT m // 2 AS c, m, count(DISTINCT y) AS h FROM px GROUP BY m), s AS (SELECT c, min(m) AS m FROM m GROUP BY c)
SELECT 'c' || c || '.lri' AS path, CAST(32 AS BIGINT) AS begin_, CAST(32 + h * 80 AS BIGINT) AS end_, 'payload' AS what, CAST(35 + c AS INT) AS focal FROM s JOIN m USING (c, m)""",
    px=True,
)
def payload_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes that a preview of each capture's reference camera reads."""
    parsed = container.parsed(_captures(spark, sf_dir))
    captures = metadata.captures(parsed)
    reads = metadata.payload_reads(metadata.modules(parsed), captures).where("wrong IS NULL")
    return reads.join(captures.select("path", F.col("focal_length_mm").alias("focal")), "path").select("path", F.col("begin").alias("begin_"), F.col("end").alias("end_"), "what", "focal")


@query("+ s AS (SELECT m, y, x, raw FROM px WHERE x = (7 * y + m) % 64) SELECT m, y, x, raw FROM s", px=True)
def raw10_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample of each packed row, by its place, without the others."""
    packed = sensor_rows(spark, sf_dir).select("m", "y", F.pandas_udf(lambda rows: rows.map(container.pack10), "binary")("raw").alias("p")).withColumn("x", ((7 * F.col("y") + F.col("m")) % WIDTH).cast("int"))
    return packed.select("m", "y", "x", container.sample10(F.col("p"), F.col("x")).alias("raw"))


@query("+ h AS (SELECT m, max(y) AS last FROM px GROUP BY m) SELECT m, CAST(sum(sev * ((last - y) * 64 + 64 - x)) AS BIGINT) AS placed, count(*) FILTER (sev >= 16) AS listed FROM px JOIN h USING (m) GROUP BY m", px=True)
def severity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record file of each module's severities, read back: maps come half a turn from how the factory wrote them."""

    def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [str(key[0])], "content": [archives.record_file([np.stack(part.sort_values("y")["sev"].to_numpy())])]})

    files = sensor_rows(spark, sf_dir).select("m", "y", "sev").groupBy("m").applyInPandas(write, "path string, content binary")
    total = F.aggregate(F.transform("severity", lambda s, x: s * (F.col("y") * WIDTH + x + 1)), F.lit(0).cast("long"), lambda a, v: a + v)
    rows = archives.severities(files).select(F.col("path").cast("int").alias("m"), total.alias("t"), F.size(F.filter("severity", lambda s: s >= 16)).alias("n"))
    return rows.groupBy("m").agg(F.sum("t").alias("placed"), F.sum("n").cast("long").alias("listed"))


def _neighbours(source: str, radius: int, step: int, least: int, value: str) -> str:
    """SQL of s: candidates of source with the sorted values of their phase's neighbours, reflected; frames are of 100 x 64."""
    h, w = 100 // step, 64 // step
    place = lambda c, d, n: f"{c} % {step} + {step} * (CASE WHEN {c} // {step} + {d} < 0 THEN -({c} // {step} + {d}) WHEN {c} // {step} + {d} >= {n} THEN {2 * n - 2} - ({c} // {step} + {d}) ELSE {c} // {step} + {d} END)"
    return f"""o AS (SELECT unnest(range({-radius}, {radius + 1})) AS d), c AS (SELECT * FROM {source} WHERE sev >= {least}),
a AS (SELECT c.*, {place("c.y", "p.d", h)} AS ny, {place("c.x", "q.d", w)} AS nx FROM c, o p, o q),
s AS (SELECT a.m, a.y, a.x, a.{value}, a.sev, a.forced, list_sort(list(n.{value})) AS s FROM a JOIN {source} n ON n.m = a.m AND n.y = a.ny AND n.x = a.nx GROUP BY ALL)"""


@query(
    f"""+ f AS (SELECT *, raw > 560 AND y % 5 = 0 AS forced FROM px), {_neighbours("f", 1, 1, 16, "raw")},
p AS (SELECT *, s[5] AS pred, list_sort(list_transform(s, lambda v: abs(v - s[5])))[5] AS mad FROM s),
r AS (SELECT *, forced OR (CASE WHEN sev = 255 THEN abs(raw - pred) ELSE raw - pred END) > greatest(4.0 * greatest(mad, 1), 8) AS gone FROM p),
k AS (SELECT px.m, sum(CASE WHEN gone THEN pred ELSE px.raw END * (px.x + 1)) AS placed FROM px LEFT JOIN r USING (m, y, x) GROUP BY px.m)
SELECT m, count(*) AS candidates, count(*) FILTER (gone) AS corrected, count(*) FILTER (gone AND raw > pred) AS positive, count(*) FILTER (gone AND raw < pred) AS negative,
  count(*) FILTER (gone AND forced) AS forced, CAST(any_value(placed) AS BIGINT) AS placed FROM r JOIN k USING (m) GROUP BY m""",
    px=True,
)
def hotpixel_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction of a monochrome frame with 3 x 3 neighbours and a map of forced places: counts by sign, and the corrected plane."""
    rows = sensor_rows(spark, sf_dir).withColumn("forced", F.transform("raw", lambda v: ((v > 560) & (F.col("y") % 5 == 0)).cast("int")))
    done = bands.corrected(rows, MODULE_ROWS, kernel=3, mono=True, sigma=4.0, absolute=8, forced="forced")
    placed = F.aggregate(F.transform("samples", lambda v, x: v * (x + 1)), F.lit(0).cast("long"), lambda a, v: a + F.coalesce(v, F.lit(0)))
    return done.groupBy("m").agg(*(F.sum(c).cast("long").alias(c) for c in ("candidates", "corrected", "positive", "negative", "forced")), F.sum(placed).alias("placed"))


_EXCESS = """b(lo, hi, node, excess) AS (VALUES (1, 64, 25, 0.1), (1, 64, 35, 0.3), (1, 64, 45, 1.1), (64, 128, 25, 0.5), (64, 128, 35, 2.0), (64, 128, 45, 6.0), (128, 255, 25, 2.0), (128, 255, 35, 9.0), (128, 255, 45, 30.0)),
t AS (SELECT m, greatest(25.0, least(45.0, 22 + 5.5 * (m % 6))) AS t FROM (SELECT DISTINCT m FROM px)),
i AS (SELECT lo, hi, node AS a, lead(node) OVER w AS z, excess AS ea, lead(excess) OVER w AS ez FROM b WINDOW w AS (PARTITION BY lo ORDER BY node)),
e AS (SELECT m, lo, hi, ea + (t - a) / (z - a) * (ez - ea) AS e FROM t JOIN i ON z IS NOT NULL AND t >= a AND (t < z OR z = 45))"""


@query(
    f"""+ {_EXCESS},
w AS (SELECT m, y, x, sev, greatest(0, least(65535, (raw << 6) - CAST(round(64 * (0.5 * (y % 7 - 3) + 0.02 * (m % 5) * (y % 3) + 0.25 * (x % 5 - 2))) AS INT))) AS q, EXISTS (SELECT 1 FROM e WHERE e.m = px.m AND sev >= lo AND sev < hi AND e.e * 1.5 >= 4) AS forced FROM px),
{_neighbours("w", 2, 2, 16, "q")},
p AS (SELECT *, s[13] AS pred, list_sort(list_transform(s, lambda v: abs(v - s[13])))[13] AS mad FROM s),
r AS (SELECT *, forced OR (CASE WHEN sev = 255 THEN abs(q - pred) ELSE q - pred END) > greatest(6.0 * greatest(mad, 1), 256) AS gone FROM p),
v AS (SELECT w.m, w.y, w.x, CASE WHEN gone THEN pred ELSE w.q END AS v FROM w LEFT JOIN r USING (m, y, x)),
g AS (SELECT i, 90.0 * ((37 * i) % 23 - 11) / 256 + 6.0 * 300 * ((17 * i) % 13 - 6) / 4096 AS g FROM (SELECT unnest(range(0, 20)) AS i)),
n AS (SELECT *, greatest(0.0, least(4.0, (x + 0.5) * 5 / 64 - 0.5)) AS px_, greatest(0.0, least(3.0, (y + 0.5) * 4 / 100 - 0.5)) AS py_ FROM v),
k AS (SELECT *, CAST(floor(px_) AS INT) AS x0, CAST(floor(py_) AS INT) AS y0, least(CAST(floor(px_) AS INT) + 1, 4) AS x1, least(CAST(floor(py_) AS INT) + 1, 3) AS y1, px_ - floor(px_) AS fx, py_ - floor(py_) AS fy FROM n),
l AS (SELECT m, y, x, greatest(0, least(65535, v - CAST(round(64 * ((1-fy) * ((1-fx) * a.g + fx * b.g) + fy * ((1-fx) * c.g + fx * d.g))) AS INT))) AS v FROM k JOIN g a ON a.i = y0*5+x0 JOIN g b ON b.i = y0*5+x1 JOIN g c ON c.i = y1*5+x0 JOIN g d ON d.i = y1*5+x1)
SELECT l.m, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * (x + 1)) AS BIGINT) AS weighted, any_value(n) AS corrected FROM l JOIN (SELECT m, count(*) FILTER (gone) AS n FROM r GROUP BY m) c USING (m) GROUP BY l.m""",
    px=True,
)
def frame_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's whole correction: forced places by temperature, row and column bias in finer codes, defects, then corner glow.

    Everything but the defects' neighbours is in the row, so a frame is shuffled once.
    """
    profile = [(1, 64, (0.1, 0.3, 1.1)), (64, 128, (0.5, 2.0, 6.0)), (128, 255, (2.0, 9.0, 30.0))]
    nodes = spark.createDataFrame([(lo, hi, float(n), e) for lo, hi, es in profile for n, e in zip((25, 35, 45), es, strict=True)], "lo int, hi int, node double, excess double")
    rows = sensor_rows(spark, sf_dir)
    frames_ = rows.select("m").distinct().select("m", (22 + 5.5 * (F.col("m") % 6)).alias("t"))
    hot = lookup.excess_at(frames_, nodes).where(F.col("excess") * 1.5 >= 4).groupBy("m").agg(F.collect_list(F.struct("lo", "hi")).alias("hot"))  # bands of a profile
    y, m = F.col("y"), F.col("m")
    bias = lambda x: 0.5 * (y % 7 - 3) + 0.02 * (m % 5) * (y % 3) + 0.25 * (x % 5 - 2)
    q = F.transform("raw", lambda v, x: F.greatest(F.lit(0), F.least(F.lit(65535), F.shiftleft(v, 6) - F.round(64 * bias(x)).cast("int"))))
    forced = F.transform("sev", lambda s: F.coalesce(F.exists("hot", lambda b: (s >= b["lo"]) & (s < b["hi"])), F.lit(False)).cast("int"))
    ready = rows.join(hot, "m", "left").select("m", "y", "sev", q.alias("q"), forced.alias("forced"))
    done = bands.corrected(ready, MODULE_ROWS, absolute=4 * 64, samples="q", forced="forced")
    i = np.arange(20)
    left = raster.without_glow(done, (90.0 * ((37 * i) % 23 - 11) / 256 + 6.0 * 300 * ((17 * i) % 13 - 6) / 4096).reshape(4, 5), MODULE_ROWS)
    total = lambda a: F.sum(F.aggregate(a, F.lit(0).cast("long"), lambda s, v: s + v))
    return left.groupBy("m").agg(total("samples").alias("total"), total(F.transform("samples", lambda v, x: v * (x + 1))).alias("weighted"), F.sum("corrected").cast("long").alias("corrected"))


@query(
    """WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN 60 ELSE 64 END AS width, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 20 + s_suppkey % 40 END AS t, CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE 1000 * (1 + s_suppkey % 3) END AS ns FROM supplier)
SELECT k, CASE WHEN width <> 64 THEN 'dimensions' WHEN ns = 0 THEN 'exposure or gain' WHEN t IS NULL THEN 'temperature' END AS refused, CASE WHEN width = 64 AND ns > 0 AND t IS NOT NULL THEN CAST(greatest(25, least(45, t)) AS DOUBLE) END AS applied,
  CASE WHEN width = 64 AND ns > 0 AND t IS NOT NULL THEN t < 25 OR t > 45 END AS clamped, CASE WHEN width = 64 AND ns > 0 AND t IS NOT NULL THEN round(ns / 2000.0 * 2.0 / 1.5, 6) END AS scale FROM s"""
)
def cleanup_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a profile holds for a frame, and if so at which temperature and scale."""
    s = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS k", "if(s_suppkey % 7 = 0, 60, 64) AS width", "48 AS height", "if(s_suppkey % 5 = 0, NULL, 20 + s_suppkey % 40) AS temperature_c", "if(s_suppkey % 11 = 0, 0, 1000 * (1 + s_suppkey % 3)) AS exposure_ns", "2D AS analog_gain", "1D AS digital_gain"
    )
    profile = {"width": 64, "height": 48, "temperature_min_c": 25, "temperature_max_c": 45, "exposure_ns": 2000, "analog_gain": 1.5, "digital_gain": 1.0}
    return records.state(s, profile).select("k", "refused", "applied", "clamped", F.round("scale", 6).alias("scale"))


@query(
    """+ d AS (SELECT m, y * 64 + x AS i, 2.0 + raw / 400.0 AS reference, sev / 900.0 AS slope, CASE WHEN sev % 3 = 0 THEN 'hot' ELSE 'other' END AS class FROM px WHERE sev >= 200)
SELECT m, count(*) FILTER (class = 'hot' AND (reference + slope * (m % 4 - 1) + 0.001 * (m % 4 - 1) * (m % 4 - 1)) * 1.25 >= 4) AS active FROM d GROUP BY m""",
    px=True,
)
def cleanup_active_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects of the hot-only class that come to the threshold at the frame's temperature."""
    d = pixels(sensor_rows(spark, sf_dir)).where("sev >= 200").selectExpr("m", "2D + raw / 400D AS reference", "sev / 900D AS slope", "0.001D AS curvature", "if(sev % 3 = 0, 'hot', 'other') AS class", "CAST(m % 4 - 1 AS DOUBLE) AS delta")
    return d.groupBy("m").agg(F.count_if((F.col("class") == "hot") & (records.defect_level(F.col("reference"), F.col("slope"), F.col("curvature"), F.col("delta"), 1.25) >= 4)).alias("active"))


# Records and names


@query(
    r"""WITH s AS (SELECT o_orderkey AS k, '/root/' || o_orderpriority || '/or der' || o_custkey || '.v' || (o_orderkey % 3) || '.LRI' AS path, o_orderkey % 9 AS i, o_orderdate AS d FROM orders)
SELECT k, regexp_replace(o[1], '[^A-Za-z0-9._-]', '_', 'g') || '__' || regexp_replace(regexp_replace(o[2], '\.[^.]*$', ''), '[^A-Za-z0-9._-]', '_', 'g') AS key, lower(regexp_extract(path, '\.([^./]*)$', 1)) = 'lri' AS container,
  CASE i WHEN 0 THEN 'A' WHEN 1 THEN 'D50' WHEN 2 THEN 'D65' WHEN 3 THEN 'D75' WHEN 4 THEN 'F2' WHEN 5 THEN 'F7' WHEN 6 THEN 'F11' WHEN 7 THEN 'TL84' ELSE 'UNRECOGNIZED' END AS light,
  CAST(epoch(CAST(d AS TIMESTAMP) + INTERVAL 5400 SECOND) AS BIGINT) AS seconds, lower(hex(path)) AS hex FROM (SELECT s.*, string_split(substr(path, 7), '/') AS o FROM s)"""
)
def capture_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key from a path below a root, the test of its extension, names of lights, instants and hex digits."""
    s = table(spark, sf_dir, "orders").withColumn("path", F.concat(F.lit("/root/"), "o_orderpriority", F.lit("/or der"), F.col("o_custkey").cast("string"), F.lit(".v"), (F.col("o_orderkey") % 3).cast("string"), F.lit(".LRI")))
    when = F.unix_timestamp(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")) + 5400
    return s.select(
        F.col("o_orderkey").alias("k"), text.path_key(F.col("path"), "/root").alias("key"), text.has_extension(F.col("path"), "lri").alias("container"), text.illuminant((F.col("o_orderkey") % 9).cast("int")).alias("light"), when.alias("seconds"), F.lower(F.hex("path")).alias("hex")
    )


@query(
    """WITH s AS (SELECT l_orderkey AS k, l_linenumber AS l, CAST(round(pow(l_quantity, 6)) AS BIGINT) AS b, l_shipdate AS d, CAST(l_quantity AS INT) AS q, CASE WHEN l_linenumber = 1 THEN NULL ELSE (l_linenumber - 4) * 90 END AS z FROM lineitem)
SELECT k, l, CASE WHEN b < 1000 THEN b || ' B' WHEN b < 1000000 THEN CASE WHEN b / 1e3 >= 100 THEN format('{:.0f} KB', b / 1e3) ELSE format('{:.1f} KB', b / 1e3) END WHEN b < 1000000000 THEN CASE WHEN b / 1e6 >= 100 THEN format('{:.0f} MB', b / 1e6) ELSE format('{:.1f} MB', b / 1e6) END ELSE CASE WHEN b / 1e9 >= 100 THEN format('{:.0f} GB', b / 1e9) ELSE format('{:.1f} GB', b / 1e9) END END AS size,
  'ISO ' || (q * 100) || CASE WHEN q % 2 = 0 THEN '  |  ' || q || ' mm' ELSE '' END || '  |  ' || strftime(CAST(d AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') || CASE WHEN z IS NULL THEN '' ELSE ' ' || CASE WHEN z < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(z) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(abs(z) % 60 AS VARCHAR), 2, '0') END AS summary FROM s"""
)
def capture_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in decimal units, and the line that sums up a capture."""
    s = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_linenumber AS l", "CAST(round(pow(l_quantity, 6)) AS BIGINT) AS b", "CAST(l_shipdate AS TIMESTAMP) AS d", "CAST(l_quantity AS INT) AS q", "if(l_linenumber = 1, NULL, (l_linenumber - 4) * 90) AS z")
    focal = F.when(F.col("q") % 2 == 0, F.col("q"))
    return s.select("k", "l", text.decimal_size(F.col("b")).alias("size"), text.summary(F.col("q") * 100, F.lit(None).cast("long"), focal, text.moment(F.col("d"), F.col("z"))).alias("summary"))


@query("SELECT s_suppkey, upper(split_part(v, '=', 1)) AS camera, CASE WHEN upper(split_part(v, '=', 2)) IN ('RGGB', 'GRBG', 'GBRG', 'BGGR', 'MONO') THEN upper(split_part(v, '=', 2)) END AS pattern FROM (SELECT s_suppkey, 'a' || (s_suppkey % 5 + 1) || '=' || CASE s_suppkey % 4 WHEN 0 THEN 'mono' WHEN 1 THEN 'Rggb' WHEN 2 THEN 'GBRG' ELSE 'xyzw' END AS v FROM supplier)")
def pattern_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat(F.lit("a"), (F.col("s_suppkey") % 5 + 1).cast("string"), F.lit("="), F.element_at(F.array(*map(F.lit, ("mono", "Rggb", "GBRG", "xyzw"))), (F.col("s_suppkey") % 4 + 1).cast("int")))
    camera, pattern = text.override(v)
    return table(spark, sf_dir, "supplier").select("s_suppkey", camera.alias("camera"), pattern.alias("pattern"))


@query(
    """WITH t AS (SELECT o_custkey AS k, max(o_orderkey) AS content, max(epoch(CAST(o_orderdate AS TIMESTAMP))) AS used, CAST(sum(o_totalprice) AS BIGINT) AS bytes FROM orders GROUP BY o_custkey)
SELECT k, CASE WHEN k % 10 = 3 THEN content + 1 ELSE content END AS content, CAST(CASE WHEN k % 4 = 0 THEN 2000000000 ELSE used END AS BIGINT) AS used FROM t WHERE k % 7 <> 5"""
)
def thumbnail_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of thumbnails after touches (a later use), links (another content) and removals by key."""
    t = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("content"), F.max(F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))).alias("used"))
    touched = records.touched(t, t.where("k % 4 = 0").select("k"), "k", "used", F.lit(2_000_000_000))
    linked = records.linked(touched, t.where("k % 10 = 3").select("k", (F.col("content") + 1).alias("content")), "k", "content")
    return records.removed(linked, t.where("k % 7 = 5").select("k"), "k")


@query("WITH p AS (SELECT o_custkey AS k, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT k, item FROM p WHERE i BETWEEN least(2, n - 1) AND greatest(2, n - 1)")
def range_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each list the items between two that were picked, both with it, whichever comes first."""
    w = Window.partitionBy("k")
    p = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("item"), "o_orderdate").withColumn("i", F.row_number().over(w.orderBy("o_orderdate", "item"))).withColumn("n", F.count(F.lit(1)).over(w))
    return records.between(p, "i", F.lit(2), F.col("n") - 1).select("k", "item")


@query(
    """WITH c AS (SELECT c_custkey AS k, c_nationkey * 3 AS low, c_nationkey AS high FROM customer), d AS (SELECT s_nationkey AS high, min(s_suppkey) AS overlay, count(*) AS n FROM supplier GROUP BY s_nationkey)
SELECT k, overlay FROM c JOIN d USING (high) WHERE low = 3 * high"""
)
def device_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibration overlay holds for the captures whose device has both halves of its id."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), records.device_id(F.col("c_nationkey") * 3, F.col("c_nationkey")).alias("device"))
    d = table(spark, sf_dir, "supplier").select(records.device_id(F.col("s_nationkey") * 3, F.col("s_nationkey")).alias("device"), "s_suppkey").groupBy("device").agg(F.min("s_suppkey").alias("overlay"))
    return c.join(d, "device").select("k", "overlay")


@query("SELECT 'module' AS origin, s_suppkey AS id, s_nationkey AS light FROM supplier UNION ALL SELECT 'gold', c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def colour_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of modules and gold records as one table."""
    own = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("light"))
    gold = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("light"))
    return records.with_gold(own, gold)


# Geometry and photometry


@query(
    """WITH s AS (SELECT c_custkey AS k, (c_custkey % 41) * 0.05 - 1 AS x, (c_custkey % 23) * 0.08 - 0.9 AS y, (c_custkey % 17) - 3 AS z FROM customer),
c AS (SELECT k, 0.8 * x - 0.6 * z + 0.1 AS x, y - 0.2 AS y, 0.6 * x + 0.8 * z + 1.5 AS z FROM s), p AS (SELECT k, CASE WHEN z > 0 THEN 50 * x / z + 0.5 * y / z + 32 END AS u, CASE WHEN z > 0 THEN 48 * y / z + 24 END AS v FROM c),
g AS (SELECT k, u, v FROM p WHERE u BETWEEN -32 AND 96 AND v BETWEEN -24 AND 72), n AS (SELECT k, (u - 32) / 50 AS a, (v - 24) / 50 AS b FROM g), r AS (SELECT *, a * a + b * b AS q FROM n),
d AS (SELECT k, a * (1 + 0.05 * q - 0.01 * q * q) + 2 * 0.001 * a * b - 0.002 * (q + 2 * a * a) AS a, b * (1 + 0.05 * q - 0.01 * q * q) + 0.001 * (q + 2 * b * b) - 2 * 0.002 * a * b AS b FROM r)
SELECT s.k, round(32 + 50 * a, 6) AS u, round(24 + 50 * b, 6) AS v FROM s LEFT JOIN d USING (k)"""
)
def projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where points of the world fall on a sensor: not behind it, nor further than half a frame outside it."""
    s = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "(c_custkey % 41) * 0.05BD - 1 AS x", "(c_custkey % 23) * 0.08BD - 0.9BD AS y", "CAST((c_custkey % 17) - 3 AS DECIMAL(20, 0)) AS z")
    d = Decimal  # points lie on the bounds, to which floats would round from either side
    camera = geometry.Camera(k=((50, d("0.5"), 32), (0, 48, 24)), turn=((d("0.8"), 0, d("-0.6")), (0, 1, 0), (d("0.6"), 0, d("0.8"))), shift=(d("0.1"), d("-0.2"), d("1.5")), width=64, height=48, bend=(0.05, -0.01, 0.001, -0.002, 0.0), centre=(32, 24), scale=50)
    u, v = geometry.projected(camera, F.col("x"), F.col("y"), F.col("z"))
    return s.select("k", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query(
    """WITH s AS (SELECT p_partkey AS k, p_size / 50.0::DOUBLE AS x, p_size / 47.0::DOUBLE AS y, (p_partkey % 53) / 60.0::DOUBLE AS z FROM part),
d AS (SELECT k, 0.9555766 * x - 0.0230393 * y + 0.0631636 * z AS x, -0.0282895 * x + 1.0099416 * y + 0.0210077 * z AS y, 0.0122982 * x - 0.020483 * y + 1.3299098 * z AS z FROM s),
l AS (SELECT k, [3.2406*x - 1.5372*y - 0.4986*z, -0.9689*x + 1.8758*y + 0.0415*z, 0.0557*x - 0.2040*y + 1.0570*z] AS l FROM d),
t AS (SELECT k, list_transform(l, lambda v: greatest(0.0, least(1.0, v * 1.1))) AS a FROM l)
SELECT k, round(list_sum(a), 6) AS linear, round(list_sum(list_transform(a, lambda v: CASE WHEN v <= 0.0031308 THEN 12.92 * v ELSE 1.055 * pow(v, 1 / 2.4) - 0.055 END)), 6) AS shown, round(list_sum(list_transform(a, lambda v: pow(v, 1 / 2.2))), 6) AS gamma FROM t"""
)
def output_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XYZ under D50 through D65 to sRGB with an exposure: linear, for display, and by a plain gamma."""
    s = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "p_size / 50D AS x", "p_size / 47D AS y", "(p_partkey % 53) / 60D AS z")
    linear = colour.output((F.col("x"), F.col("y"), F.col("z")), 1.1)
    total = lambda f: F.round(sum((f(c) for c in linear[1:]), f(linear[0])), 6)
    return s.select("k", total(lambda c: c).alias("linear"), total(colour.displayed).alias("shown"), total(lambda c: F.pow(c, F.lit(1 / 2.2))).alias("gamma"))


@query(
    """WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, embedding AS c FROM embeddings), b AS (SELECT vec_id, any_value(c) AS c, list_position(any_value(c), list_min(any_value(c))) - 1 AS best FROM e GROUP BY vec_id),
k AS (SELECT vec_id, best, c[best]::DOUBLE AS l, c[best + 1]::DOUBLE AS m, c[best + 2]::DOUBLE AS r FROM b), d AS (SELECT *, 0.002 - best * (0.002 - 1e-7) / 63 AS inv FROM k)
SELECT vec_id, CAST(best AS INT) AS best, round(CASE WHEN best <= 1 OR best >= 63 OR l - 2 * m + r <= 1e-6 THEN 1 / inv ELSE 1 / (inv - greatest(-0.75, least(0.75, 0.5 * (l - r) / (l - 2 * m + r))) * (0.002 - 1e-7) / 63) END, 2) AS depth FROM d"""
)
def sublabel_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The depth between labels where a parabola through the least cost and its neighbours has its foot; labels are even in inverse depth."""
    c = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("c"))
    inverse = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: 0.002 - i * (0.002 - 1e-7) / 63)
    best, depth = photometric.sublabel(F.col("c"), inverse)
    return c.select("vec_id", best.alias("best"), F.round(depth, 2).alias("depth"))


@query(
    """WITH p AS (SELECT p_brand AS k, p_size / 60.0::DOUBLE AS t, p_size / 70.0::DOUBLE + (p_partkey % 13) / 200.0::DOUBLE AS r, p_partkey AS i FROM part),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, i) - 1 AS j, count(*) OVER (PARTITION BY k) AS n FROM p WHERE t > 0.005 AND r > 0.005 AND t < 0.9 AND r < 0.9),
h AS (SELECT k, n, j >= n // 2 AS high, list_sort(list(t)) AS ts, list_sort(list(r)) AS rs FROM o GROUP BY ALL), m AS (SELECT k, n, max(ts[len(ts) // 2 + 1]) FILTER (NOT high) AS tl, max(rs[len(rs) // 2 + 1]) FILTER (NOT high) AS rl, max(ts[len(ts) // 2 + 1]) FILTER (high) AS th, max(rs[len(rs) // 2 + 1]) FILTER (high) AS rh FROM h GROUP BY k, n),
f AS (SELECT *, greatest(0.2, least(5.0, CASE WHEN th - tl < 0.01 THEN (rl + rh) / greatest(tl + th, 1e-4) ELSE (rh - rl) / (th - tl) END)) AS slope FROM m)
SELECT k, round(CASE WHEN n < 6 THEN 1 ELSE slope END, 6) AS slope, round(CASE WHEN n < 6 OR th - tl < 0.01 THEN 0 ELSE greatest(-0.2, least(0.2, (tl + th) / 2 - (rl + rh) / 2 / slope)) END, 6) AS offset_ FROM f"""
)
def photometric_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slope and offset that bring a module's luminance to the reference's, from the medians of the darker and the brighter half."""
    p = table(spark, sf_dir, "part").selectExpr("p_brand AS k", "p_size / 60D AS t", "p_size / 70D + (p_partkey % 13) / 200D AS r", "p_partkey AS i")
    return photometric.match(p, ["k"], "t", "r", "i", least=6).select("k", F.round("slope", 6).alias("slope"), F.round("offset", 6).alias("offset_"))


@query(
    """WITH q AS (SELECT p_brand AS k, (p_size / 60.0::DOUBLE) / (p_size / 70.0::DOUBLE + (p_partkey % 13) / 200.0::DOUBLE) AS q FROM part WHERE p_size / 60.0 > 0.01 AND p_size / 60.0 < 0.95 AND p_size / 70.0 + (p_partkey % 13) / 200.0 < 0.95),
s AS (SELECT k, list_sort(list(q)) AS a, count(*) AS n FROM q GROUP BY k) SELECT k, round(greatest(0.25, least(4.0, a[n // 2 + 1])), 6) AS gain, round(a[least(9 * n // 10, n - 1) + 1], 6) AS p90 FROM s"""
)
def photometric_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median ratio of luminances, held in bounds, and the ratio nine tenths up."""
    p = table(spark, sf_dir, "part").selectExpr("p_brand AS k", "p_size / 60D AS r", "p_size / 70D + (p_partkey % 13) / 200D AS t").where("r > 0.01 AND r < 0.95 AND t > 0.01 AND t < 0.95")
    gain, high = photometric.gain(p, ["k"], F.col("r") / F.col("t"))
    return gain.join(high, "k").select("k", F.round("gain", 6).alias("gain"), F.round("p90", 6).alias("p90"))


@query(
    """WITH b AS (SELECT o_custkey AS k, (o_orderkey % 21) / 20.0::DOUBLE AS a, (o_orderkey % 11) / 20.0::DOUBLE AS b, o_totalprice AS s, o_orderkey AS i FROM orders), f AS (SELECT k, arg_min({'a': a, 'b': b, 's': s}, {'s': s, 'i': i}) AS f FROM b GROUP BY k),
r AS (SELECT b.k, min(s) AS second FROM b JOIN f USING (k) WHERE abs(b.a - f.a) + abs(b.b - f.b) + abs((1 - b.a - b.b) - (1 - f.a - f.b)) >= 0.30 - 1e-9 GROUP BY b.k) SELECT k, f.s AS best, round(second - f.s, 4) AS lead FROM f LEFT JOIN r USING (k)"""
)
def runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best blend of each key, and how far it leads the best of those that are not close to it."""
    b = table(spark, sf_dir, "orders").selectExpr("o_custkey AS k", "(o_orderkey % 21) / 20D AS a", "(o_orderkey % 11) / 20D AS b", "o_totalprice AS s", "o_orderkey AS i")
    return photometric.led(b, ["k"], ("a", "b"), "s", "i", 0.30 - 1e-9).select("k", "best", F.round("lead", 4).alias("lead"))


@query(
    """+ f AS (SELECT m, y, x, raw + ((13 * k + 7 * y + 3 * x) % 41) - 20 + CASE WHEN (y + x + k) % 97 = 0 THEN 400 ELSE 0 END AS v, raw, k FROM px, (SELECT unnest(range(1, 6)) AS k)),
w AS (SELECT *, greatest(0.0, 1.0 - (v - raw) * (v - raw) / (16.0 * (0.2 * raw + 4.0))) AS r FROM f), s AS (SELECT m, y, x, 1 + sum(r * r) AS weight FROM w GROUP BY ALL), c AS (SELECT m, CAST(least(65535, round(least(weight, 4.0) * 16384)) AS BIGINT) AS c FROM s)
SELECT m, round(avg(c) / 16384, 6) AS frames, round(avg(CASE WHEN c < 18432 THEN 1.0 ELSE 0.0 END), 6) AS fallback FROM c GROUP BY m""",
    px=True,
)
def burst_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many frames each merged sample rests on, at most four, in fixed point, and the share that rests on the reference alone."""
    off = lambda k, x: (13 * k + 7 * F.col("y") + 3 * x) % 41 - 20 + F.when((F.col("y") + x + k) % 97 == 0, 400).otherwise(0)
    weight = lambda v, x: photometric.support([photometric.merge_weight(off(k, x).cast("double"), 0.2 * v + 4.0) for k in range(1, 6)])
    rows = sensor_rows(spark, sf_dir).withColumn("w", F.transform("raw", weight))
    sums = rows.select("m", F.size("w").alias("n"), F.aggregate("w", F.lit(0).cast("long"), lambda a, v: a + v).alias("c"), F.size(F.filter("w", lambda v: v < 18432)).alias("low"))
    return sums.groupBy("m").agg(F.round(F.sum("c") / F.sum("n") / 16384, 6).alias("frames"), F.round(F.sum("low") / F.sum("n"), 6).alias("fallback"))


@query(
    """WITH p AS (SELECT p_brand AS k, p_size % 6 AS cell, abs(p_retailprice / 1000.0 - p_size / 40.0) AS e FROM part), c AS (SELECT k, cell, avg(CASE WHEN e <= 0.2 THEN 0.5 * e * e ELSE 0.2 * (e - 0.1) END) AS l, sqrt(avg(e * e)) AS r FROM p GROUP BY ALL)
SELECT k, round(avg(l) + 0.02 * 1.5 * 1.5, 6) AS loss, round(sqrt(avg(r * r)), 6) AS rmse, count(*) AS cells FROM c GROUP BY k"""
)
def balanced_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robust loss in which every cell weighs alike, with a penalty on what is fitted."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), (F.col("p_size") % 6).alias("cell"), F.abs(F.col("p_retailprice") / 1000.0 - F.col("p_size") / 40.0).alias("e"))
    return photometric.balanced_loss(p, ["k"], "cell", "e", 0.2, 0.02 * 1.5 * 1.5).select("k", F.round("loss", 6).alias("loss"), F.round("rmse", 6).alias("rmse"), "cells")


@query(
    """+ z AS (SELECT m, y, x, raw / 1023.0 AS v, CASE WHEN y % 2 = x % 2 THEN CASE WHEN y % 2 = 0 THEN 'R' ELSE 'B' END ELSE 'G' END AS channel FROM px), t AS (SELECT *, greatest(0.0, least(1.0, (0.6 - v) / (0.6 - 0.52))) AS t FROM z)
SELECT m, channel, count(*) FILTER (v >= 0.6) AS clipped, count(*) FILTER (v < 0.6 AND v > 0.52) AS feathered, CAST(sum(CAST(round(255 * t) AS INT)) AS BIGINT) AS confidence, count(*) FILTER (round(255 * t) < 208) AS wanting FROM t GROUP BY m, channel""",
    px=True,
)
def highlight_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped and nearly clipped samples of each channel, how sure the others are, and how many ask for a donor."""
    clip, feather = 0.6, 0.52

    def codes(v: Column) -> Column:
        return F.round(255 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (clip - v) / (clip - feather)))).cast("int")

    tell = F.transform("raw", lambda r, x: F.struct(F.when(F.col("y") % 2 == x % 2, F.when(F.col("y") % 2 == 0, "R").otherwise("B")).otherwise("G").alias("channel"), (r / 1023.0).alias("v")))
    one = sensor_rows(spark, sf_dir).select("m", F.inline(tell))
    return one.groupBy("m", "channel").agg(
        F.count_if(F.col("v") >= clip).alias("clipped"), F.count_if((F.col("v") < clip) & (F.col("v") > feather)).alias("feathered"), F.sum(codes(F.col("v"))).cast("long").alias("confidence"), F.count_if(codes(F.col("v")) < 208).alias("wanting")
    )


def _sorted4(values: list[Column]) -> Column:
    return F.sort_array(F.array(*values))[2]


@query("SELECT l_orderkey, l_linenumber, list_sort([l_quantity, l_discount * 100, l_tax * 200, l_linenumber * 7.0])[3] AS of_four, list_sort([l_quantity, l_discount * 100, l_tax * 200, l_linenumber * 7.0, 11.0, l_extendedprice / 1000])[4] AS of_six FROM lineitem")
def network_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper medians of four and of six."""
    q = [F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 200, F.col("l_linenumber") * 7.0]
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _sorted4(q).alias("of_four"), F.sort_array(F.array(*q, F.lit(11.0), F.col("l_extendedprice") / 1000))[3].alias("of_six"))


@query(None)
def highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped samples of each module, rebuilt where there is enough around them. Tested against plain loops."""
    done = recovery.highlights(sensor_rows(spark, sf_dir), MODULE_ROWS, white=650.0)
    total = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda a, v: a + v))
    return done.groupBy("m").agg(F.sum("clipped").alias("clipped"), F.sum("recovered").alias("recovered"), total("samples").alias("total"), total("sure").alias("sure"))


@query(
    """+ n AS (SELECT m, y, x, CASE WHEN sev >= 64 THEN 0.0001 + raw / 1e6 END AS inv, (sev % 16) / 16.0 AS g, (raw % 4) / 4.0 AS s FROM px),
a AS (SELECT a.m, a.y, a.x, a.s, count(*) FILTER (abs(b.inv - a.inv) <= 0.0000205 AND abs(b.g - a.g) <= 0.6) AS n FROM n a JOIN n b ON b.m = a.m AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) WHERE a.inv IS NOT NULL GROUP BY ALL)
SELECT m, count(*) AS kept, CAST(sum(y * 64 + x) AS BIGINT) AS places FROM a WHERE n >= CASE WHEN s >= 0.75 THEN 1 ELSE 2 END GROUP BY m""",
    px=True,
)
def depth_supported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a depth grid that enough neighbours agree with."""
    whole = lambda c: F.round(c * recovery.SCALE).cast("long")
    nodes = sensor_rows(spark, sf_dir).select(
        "m", "y", F.zip_with("raw", "sev", lambda r, s: F.when(s >= 64, whole(0.0001 + r / 1e6)).otherwise(0)).alias("inverse"), F.transform("sev", lambda s: whole((s % 16) / 16.0)).alias("guide"), F.transform("raw", lambda r: whole((r % 4) / 4.0)).alias("sure")
    )
    kept = recovery.supported(nodes, MODULE_ROWS, 0.0000205)
    sums = F.aggregate(F.transform("kept", lambda k, x: k * (F.col("y") * WIDTH + x)), F.lit(0).cast("long"), lambda a, v: a + v)
    return kept.groupBy("m").agg(F.sum(F.size(F.filter("kept", lambda k: k == 1))).cast("long").alias("kept"), F.sum(sums).alias("places"))


@query(
    """WITH s AS (SELECT p_partkey AS k, ln(0.5 + p_size / 40.0) AS x, ln(0.4 + (p_partkey % 29) / 20.0) AS y FROM part),
a(i, m0, x0, y0, m1, x1, y1) AS (VALUES (0, 1e6 / 6504, ln(0.6), ln(0.9), 1e6 / 4000, ln(0.8), ln(0.6)), (1, 1e6 / 4000, ln(0.8), ln(0.6), 1e6 / 2856, ln(1.2), ln(0.4))),
p AS (SELECT *, greatest(0.0, least(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / (pow(x1 - x0, 2) + pow(y1 - y0, 2)))) AS w FROM s, a),
d AS (SELECT *, sqrt(pow(x - x0 - (x1 - x0) * w, 2) + pow(y - y0 - (y1 - y0) * w, 2)) AS d FROM p)
SELECT k, CAST(arg_min(i, d) AS INT) AS segment, round(arg_min(m0 + (m1 - m0) * w, d), 4) AS mired, round(1 / (1 + 4 * min(d)), 6) AS sure FROM d GROUP BY k"""
)
def illuminant_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The light that a white balance speaks for, between anchors of known lights."""
    anchors = [(1e6 / t, float(np.log(r)), float(np.log(b))) for t, r, b in ((6504, 0.6, 0.9), (4000, 0.8, 0.6), (2856, 1.2, 0.4))]
    s = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "ln(0.5D + p_size / 40D) AS x", "ln(0.4D + (p_partkey % 29) / 20D) AS y")
    return s.withColumn("p", recovery.light_prior(F.col("x"), F.col("y"), anchors)).select("k", "p.segment", F.round("p.mired", 4).alias("mired"), F.round("p.sure", 6).alias("sure"))


@query(
    """WITH p AS (SELECT p_partkey AS k, (p_partkey % 61) * 1.0471975512 AS x, (p_size % 47) * 1.0235987756 AS y FROM part), q AS (SELECT k, d, x + 8 * (d = 1)::INT AS x, y + 8 * (d = 2)::INT AS y FROM p, (SELECT unnest([0, 1, 2]) AS d)),
c AS (SELECT *, least(CAST(floor(x / 8) AS INT), 8) AS c0, least(CAST(floor(y / 8) AS INT), 6) AS r0 FROM q), e AS (SELECT *, least(c0 + 1, 8) AS c1, least(r0 + 1, 6) AS r1, x / 8 - c0 AS tx, y / 8 - r0 AS ty FROM c),
g AS (SELECT i % 9 AS c, i // 9 AS r, 8.2 * (i % 9) + 0.1 * (i // 9) * (i % 9) AS u, 7.9 * (i // 9) + ((i * 7) % 5) / 10.0 AS v, ((i * 3) % 11) / 10.0 AS s FROM (SELECT unnest(range(0, 63)) AS i)),
m AS (SELECT e.k, d, (a.u*(1-tx)+b.u*tx)*(1-ty)+(f.u*(1-tx)+h.u*tx)*ty AS u, (a.v*(1-tx)+b.v*tx)*(1-ty)+(f.v*(1-tx)+h.v*tx)*ty AS v, greatest(0, least(1, (a.s*(1-tx)+b.s*tx)*(1-ty)+(f.s*(1-tx)+h.s*tx)*ty)) AS s
  FROM e JOIN g a ON a.c=c0 AND a.r=r0 JOIN g b ON b.c=c1 AND b.r=r0 JOIN g f ON f.c=c0 AND f.r=r1 JOIN g h ON h.c=c1 AND h.r=r1)
SELECT o.k, round(o.u, 6) AS u, round(o.v, 6) AS v, round(o.s, 6) AS sure, round(greatest(1e-6, sqrt(sqrt(pow(x.u-o.u,2)+pow(x.v-o.v,2)) / 8 * sqrt(pow(y.u-o.u,2)+pow(y.v-o.v,2)) / 8)), 6) AS magnified
FROM m o JOIN m x ON x.k = o.k AND x.d = 1 JOIN m y ON y.k = o.k AND y.d = 2 WHERE o.d = 0"""
)
def warp_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a tabulated warp takes pixels, how sure it is there, and how it magnifies."""
    grids = [F.expr(f"transform(sequence(0, 62), i -> CAST({e} AS DOUBLE))") for e in ("8.2D * (i % 9) + 0.1D * (i div 9) * (i % 9)", "7.9D * (i div 9) + ((i * 7) % 5) / 10D", "((i * 3) % 11) / 10D")]
    s = table(spark, sf_dir, "part").selectExpr("p_partkey AS k", "(p_partkey % 61) * 1.0471975512D AS x", "(p_size % 47) * 1.0235987756D AS y")
    u, v, sure, magnified = lookup.warped(grids, 9, 7, 8, F.col("x"), F.col("y"))
    return s.select("k", F.round(u, 6).alias("u"), F.round(v, 6).alias("v"), F.round(sure, 6).alias("sure"), F.round(magnified, 6).alias("magnified"))


@query(
    """+ b AS (SELECT m, y // 10 AS r, x // 8 AS c, avg(raw / 1023.0) AS mean, stddev_pop(raw / 1023.0) AS deviation FROM px GROUP BY ALL) SELECT m, CAST(r AS INT) AS r, CAST(c AS INT) AS c, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM b""",
    px=True,
)
def local_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of each patch: sums of a row's part of it are made in the row, so a patch is ten rows to add up."""
    part = F.transform(F.sequence(F.lit(0), F.lit(WIDTH // 8 - 1)), lambda c: F.struct(c.alias("c"), F.transform(F.slice("raw", c * 8 + 1, F.lit(8)), lambda v: v / 1023.0).alias("v")))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    s = sensor_rows(spark, sf_dir).select("m", F.expr("CAST(y div 10 AS INT)").alias("r"), F.inline(part)).select("m", "r", "c", add("v").alias("s"), add(F.transform("v", lambda v: v * v)).alias("q"))
    s = s.groupBy("m", "r", "c").agg((F.sum("s") / (8 * F.count(F.lit(1)))).alias("mean"), (F.sum("q") / (8 * F.count(F.lit(1)))).alias("square"))
    return s.select("m", "r", "c", F.round("mean", 6).alias("mean"), F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))), 6).alias("deviation"))
