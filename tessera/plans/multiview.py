"""Queries on state, sets and text of a catalogue, and on several views of one scene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import ordered, state
from tessera.plans.registry import query
from tessera.sources.standins import sensor_rows, table


@query("SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def requested_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select("c_nationkey")
    return asked.intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey")))


@query("+ f AS (SELECT m, y, x, sev = 255 AS f FROM px UNION ALL SELECT m, y, x, raw > 900 FROM px), o AS (SELECT m, y, x, bool_or(f) AS f FROM f GROUP BY ALL) SELECT m, count(*) FILTER (f) AS forced FROM o GROUP BY m", px=True)
def forced_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both masks of a row are in the row."""
    both = F.zip_with(F.transform("sev", lambda s: s == 255), F.transform("raw", lambda v: v > 900), lambda a, b: a | b)
    return sensor_rows(spark, sf_dir).select("m", F.size(F.filter(both, lambda f: f)).alias("n")).groupBy("m").agg(F.sum("n").cast("long").alias("forced"))


@query("SELECT s_nationkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_nationkey, c_name FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def missing_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"))
    return state.missing_added(own, table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name")), ["k"])


@query("SELECT p_brand, p_size, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def records_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("p_partkey"))


@query("SELECT user_id, event_id FROM events e WHERE CAST(floor(epoch_us(ts) / 864e8) AS BIGINT) = (SELECT max(CAST(floor(epoch_us(ts) / 864e8) AS BIGINT)) FROM events f WHERE f.user_id = e.user_id)")
def newest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 864e8).cast("long")
    return state.newest_generation(table(spark, sf_dir, "events").select("user_id", "event_id", day.alias("day")), ["user_id"], "day").select("user_id", "event_id")


@query("WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT * FROM l WHERE event_type IS DISTINCT FROM before")
def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.changes(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.col("ts"), F.col("event_id")).select("user_id", "event_id", "event_type", "before")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 100")
def oldest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred oldest open entries: a report of the top, so the limit is its meaning."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(100).select("o_custkey", "o_orderkey", "o_orderdate")


@query(
    """SELECT p_partkey, CASE WHEN b >= 1048576 THEN format('{:.1f} MiB', b / 1048576.0) WHEN b >= 1024 THEN format('{:.1f} KiB', b / 1024.0) ELSE format('{:d} B', b) END AS size,
  CASE WHEN ns >= 1000000000 THEN format('{:.1f} s', ns / 1e9) WHEN ns > 0 THEN format('1/{:.0f} s', 1 / (ns / 1e9)) ELSE '-' END AS shutter,
  CASE WHEN length(p_name) <= 9 THEN p_name ELSE p_name[1:4] || '…' || right(p_name, 4) END AS short
FROM (SELECT *, CAST(pow(p_size, 5) + 1 AS BIGINT) AS b, CAST((p_size - 1) * 25000001 AS BIGINT) AS ns FROM part)"""
)
def catalogue_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("b", (F.pow("p_size", F.lit(5.0)) + 1).cast("long")).withColumn("ns", (F.col("p_size").cast("long") - 1) * 25_000_001)
    return p.select("p_partkey", text.bytes_text(F.col("b")).alias("size"), text.shutter_text(F.col("ns")).alias("shutter"), text.elided(F.col("p_name"), 9).alias("short"))


@query(
    """WITH d AS (SELECT o_custkey AS k, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS total FROM orders GROUP BY o_custkey)
SELECT k, done, total, round(least(1.0, (done + 0.5) / total), 6) AS fraction FROM d"""
)
def progress_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count(F.lit(1)).alias("total"))
    return d.select("k", "done", "total", F.round(F.least(F.lit(1.0), (F.col("done") + 0.5) / F.col("total")), 6).alias("fraction"))


@query(
    """+ e AS (SELECT m, y, CAST(sum(raw) AS BIGINT) AS e FROM px GROUP BY m, y), r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY e DESC, y DESC) AS r FROM e) SELECT m, y, e FROM r WHERE r = 1""",
    px=True,
)
def sharpest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of most energy in each module; of equals the last."""
    e = sensor_rows(spark, sf_dir).select("m", "y", F.aggregate("raw", F.lit(0).cast("long"), lambda a, v: a + v).alias("e"))
    return e.groupBy("m").agg(F.max_by(F.struct("y", "e"), F.struct("e", "y")).alias("s")).select("m", "s.y", "s.e")


@query(
    """WITH RECURSIVE s AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i, 1 + l_discount * 10 AS t, (l_partkey % 41 - 15) / 1000.0::DOUBLE AS d,
  CASE WHEN l_quantity < 5 THEN 0 ELSE l_quantity / 50 END AS w, (l_suppkey % 10) / 10.0::DOUBLE AS px, (l_partkey % 7) / 7.0::DOUBLE AS py FROM lineitem),
a AS (SELECT k, 0::BIGINT AS i, 0::DOUBLE AS t, 0::DOUBLE AS v, 0::DOUBLE AS va, 0::DOUBLE AS w, 0::DOUBLE AS x, 0::DOUBLE AS y, 0::DOUBLE AS q, 0 AS n, 0::DOUBLE AS best, 0::DOUBLE AS score FROM s WHERE i = 1
  UNION ALL SELECT k, i, CASE WHEN skip THEN t WHEN light THEN bt ELSE greatest(bt, et) END, CASE WHEN skip THEN v WHEN light THEN bv ELSE bv + ew * ed END, CASE WHEN skip THEN va WHEN light THEN ba ELSE ba + ew * abs(ed) END,
    CASE WHEN skip THEN w WHEN light THEN bw ELSE bw + ew END, CASE WHEN skip THEN x WHEN light THEN bx ELSE bx + ew * ex END, CASE WHEN skip THEN y WHEN light THEN by_ ELSE by_ + ew * ey END,
    CASE WHEN skip THEN q WHEN light THEN bq ELSE bq + ew * (ex * ex + ey * ey) END, CASE WHEN skip THEN n WHEN light THEN bn ELSE bn + 1 END,
    CASE WHEN skip THEN best WHEN light THEN bb WHEN abs(ed) * sqrt(ew) > bs THEN ed ELSE bb END, CASE WHEN skip THEN score WHEN light THEN bs ELSE greatest(bs, abs(ed) * sqrt(ew)) END
  FROM (SELECT a.*, s.i AS ni, s.t AS et, s.d AS ed, s.w AS ew, s.px AS ex, s.py AS ey, a.n > 0 AND s.t * 1.2 < a.t AS skip, s.w <= 1e-8 AS light, a.n > 0 AND s.t > a.t * 1.2 AS fresh,
    CASE WHEN fresh THEN 0 ELSE a.t END AS bt, CASE WHEN fresh THEN 0 ELSE a.v END AS bv, CASE WHEN fresh THEN 0 ELSE a.va END AS ba, CASE WHEN fresh THEN 0 ELSE a.w END AS bw, CASE WHEN fresh THEN 0 ELSE a.x END AS bx,
    CASE WHEN fresh THEN 0 ELSE a.y END AS by_, CASE WHEN fresh THEN 0 ELSE a.q END AS bq, CASE WHEN fresh THEN 0 ELSE a.n END AS bn, CASE WHEN fresh THEN 0 ELSE a.best END AS bb, CASE WHEN fresh THEN 0 ELSE a.score END AS bs
    FROM a JOIN s ON s.k = a.k AND s.i = a.i + 1) AS j(k, old, t, v, va, w, x, y, q, n, best, score, i, et, ed, ew, ex, ey, skip, light, fresh, bt, bv, ba, bw, bx, by_, bq, bn, bb, bs)),
f AS (SELECT *, sqrt(greatest(0, q / w - pow(x / w, 2) - pow(y / w, 2))) AS spread, abs(v) / greatest(va, 1e-8) AS agree, greatest(0, least(1, (abs(v) / greatest(va, 1e-8) - 0.45) / 0.45)) AS u
  FROM a WHERE i = (SELECT max(i) FROM s WHERE s.k = a.k) AND w > 1e-8 AND (n >= 2 OR t > 1.35)),
g AS (SELECT *, v / w + CASE WHEN v * best > 0 THEN 0.55 * u * u * (3 - 2 * u) * (best - v / w) ELSE 0 END AS detail, greatest(0, least(1, (n - 1) / 2.0)) AS c1, greatest(0, least(1, (spread - 0.04) / 0.24)) AS c2, greatest(0, least(1, (agree - 0.08) / 0.52)) AS c3 FROM f),
h AS (SELECT *, CASE WHEN n < 2 THEN 0 ELSE c1 * c1 * (3 - 2 * c1) * c2 * c2 * (3 - 2 * c2) END AS phase, greatest(0, least(1, (abs(detail) - 0.00025) / 0.0025)) AS c4 FROM g)
SELECT k, CAST(n AS INT) AS cameras, round(t, 6) AS tier, round(detail, 8) AS detail, round(spread, 6) AS spread, round(CASE WHEN t > 1.35 THEN 0.72 + 0.28 * phase ELSE phase END * c3 * c3 * (3 - 2 * c3) * c4 * c4 * (3 - 2 * c4), 6) AS confidence FROM h"""
)
def detail_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS k", "struct(l_linenumber, l_partkey) AS o", "1 + l_discount * 10 AS tier", "(l_partkey % 41 - 15) / 1000D AS value", "if(l_quantity < 5, 0D, l_quantity / 50) AS weight", "(l_suppkey % 10) / 10D AS px", "(l_partkey % 7) / 7D AS py"
    )
    t = state.tiered(s, ["k"], "o")
    return t.select("k", "cameras", F.round("tier", 6).alias("tier"), F.round("detail", 8).alias("detail"), F.round("spread", 6).alias("spread"), F.round("confidence", 6).alias("confidence"))


@query("SELECT user_id, event_id, epoch_us(ts) AS us, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS pose FROM events")
def cumulative_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    return ordered.running(e, ["user_id"], "value", "pose", F.col("us"), F.col("event_id")).select("user_id", "event_id", "us", F.round("pose", 4).alias("pose"))
