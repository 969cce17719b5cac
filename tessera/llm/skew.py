"""Joins in which single keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which it may be split, and keys that are split at most: so few that a list of them is broadcast.
LEAST, MOST = 4096, 10_000
_SALT, _PARTS = "salt__", "parts__"


def join(left: DataFrame, right: DataFrame, keys: list[str], rows: str = "rows", how: str = "inner", counted: DataFrame | None = None, all_rows: int | None = None) -> DataFrame:
    """left joined with right, which has a row per key. counted (right, if not given) has, as rows, how many left has of each key.

    Keys of more than LEAST rows and of more than all rows over MOST are split: there are at most MOST of them, whatever the
    input. Their rows in left are dealt by a hash of the row, theirs in right are repeated for every part. Nulls match nothing.
    Without all_rows, counted is a written table that is asked first: where no key is so heavy, it is a plain join.
    """
    counted = right if counted is None else counted
    plain = left.join(right.hint("shuffle_hash"), keys, how)
    if all_rows is None:
        n, most = counted.agg(F.sum(rows), F.max(rows)).first()
        bound = max(LEAST, int(n or 0) // MOST)
        if (most or 0) <= bound:
            return plain
    else:
        bound = max(LEAST, all_rows // MOST)
        if all_rows <= bound:
            return plain
    heavy = F.broadcast(counted.where(F.col(rows) > bound).select(*keys, F.ceil(F.col(rows) / bound).cast("int").alias(_PARTS)))
    parts = F.coalesce(_PARTS, F.lit(1))
    dealt = left.join(heavy, keys, "left").withColumn(_SALT, F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop(_PARTS)
    repeated = right.join(heavy, keys, "left").withColumn(_SALT, F.explode(F.sequence(F.lit(0), parts - 1))).drop(_PARTS)
    return dealt.join(repeated.hint("shuffle_hash"), [*keys, _SALT], how).drop(_SALT)
