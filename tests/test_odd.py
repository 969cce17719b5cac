"""Queries on tables that are not of whole frames, and on keys at which floats once fell to the wrong side, against their SQL."""

import duckdb
import pytest

from tessera.plans import catalogue

DIR = "/root/testdata/sf0.001"


def both(spark, folder, name, tables):
    """Sorted rows by Spark and by SQL, of tables by name as SELECTs on those of DIR."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY (SELECT * FROM ({sql.format(f"'{DIR}/{t}.parquet'")})) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalogue.queries()[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert want
    return sorted(map(tuple, df.collect()), key=str), sorted(want, key=str)


@pytest.mark.parametrize("name", ["frame_pipeline", "hotpixel_forced", "hotpixel_stats"])
def test_frames_that_lack_rows(spark, tmp_path, name):
    """One cut at 56 of 100 rows, one at a band's end, one of a single row, one with holes."""
    cut = "SELECT * FROM {} WHERE NOT (vec_id // 100 = 1 AND vec_id % 100 >= 64 OR vec_id // 100 = 2 AND vec_id % 100 > 0 OR vec_id // 100 = 3 AND vec_id % 100 BETWEEN 10 AND 88) AND vec_id < 456"
    got, want = both(spark, tmp_path, name, {"embeddings": cut})
    assert got == want


def test_mirrored_and_opposite_hues(spark, tmp_path):
    """Colours of which (by SQL) hues are just over and just under half a turn apart, or mirrored."""
    got, want = both(spark, tmp_path, "delta_e00", {"part": "SELECT * REPLACE (x.k AS p_partkey, x.s AS p_size) FROM {} JOIN (VALUES (1, 9949, 6), (2, 14490, 41)) x(i, k, s) ON p_partkey = i"})
    assert got == want and len(got) == 2


def test_white_balances_nearest_to_an_anchor(spark, tmp_path):
    """Both segments end there; the SQL's arithmetic says which is nearer. Every pair of sizes and remainders."""
    got, want = both(spark, tmp_path, "illuminant_prior", {"part": "SELECT i AS p_partkey, i // 29 AS p_size FROM (SELECT unnest(range(29, 1479)) AS i)"})
    assert got == want and len(got) == 1450


def test_points_on_the_bound_of_a_sensor(spark, tmp_path):
    got, want = both(spark, tmp_path, "projection", {"customer": "SELECT * REPLACE (x.k AS c_custkey) FROM {} JOIN (VALUES (1, 869), (2, 4473), (3, 7023), (4, 9573)) x(i, k) ON c_custkey = i"})
    assert got == want and len(got) == 4
