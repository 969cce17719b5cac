"""What both vector searches share: valid vectors, k-means on a bounded sample, blocks of bounded size, merging of best lists."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block of queries or of a list; rows of the data that queries meet at once.
BLOCK_ROWS, MANY_ROWS = 4096, 1 << 15


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of double) of the vectors that are not null or empty and hold only finite components."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def drawn(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The rows of the most least hashes of key. A bound on the hash, four times what that takes on average, goes first: so no task hands on more than its part."""
    share = min(1.0, 4 * (most + 100) / max(1, rows.count()))
    some = rows if share == 1 else rows.where(F.xxhash64(key) < int((share - 0.5) * 2**64))
    return some.orderBy(F.xxhash64(key), key).limit(most)


def sample(rows: DataFrame, most: int) -> np.ndarray:
    """At most so many vectors (of one length), drawn by a hash of the id."""
    return np.array([r.v for r in drawn(rows, "vec_id", most).collect()], float)


def by_length(rows: DataFrame, search: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """What search gives for the vectors of each length by themselves: tables mostly have one."""
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    found = [search(rows.where(F.size("v") == n)) for n in lengths]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], schema)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of equals."""
    return np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """At most k centres by Lloyd's rounds from distinct rows; a centre that loses its rows stays where it is."""
    start = np.unique(x, axis=0)
    centres = start[np.random.default_rng(seed).permutation(len(start))[:k]].astype(float)
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        for d in range(x.shape[1]):
            summed = np.bincount(own, x[:, d], len(centres))
            centres[n > 0, d] = summed[n > 0] / n[n > 0]
    return centres


def salts(counts: dict[int, int]) -> dict[int, int]:
    """Into how many blocks each group is dealt."""
    return {g: -(-n // BLOCK_ROWS) for g, n in counts.items()}


def literal_map(d: dict[int, int]) -> Column:
    """d as a map; for dictionaries of a fixed bound, such as one entry for each centre."""
    return F.create_map([F.lit(int(x)) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<int,int>")


def best(partial: DataFrame, k: int, sign: int) -> DataFrame:
    """query_id, rank, vec_id, score from rows (query_id, part, found: array of struct(order, vec_id)): the k least by order, vec_id; score is sign * order.

    Lists meet first by part, then by query, k entries of each going on.
    """
    cut = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k)
    by_part = partial.groupBy("query_id", "part").agg(cut("found").alias("found"))
    return (
        by_part.groupBy("query_id")
        .agg(cut("found").alias("found"))
        .select("query_id", F.posexplode("found").alias("at", "hit"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", (sign * F.col("hit.order")).alias("score"))
    )
