"""Exact top-k search by inner product: a Voronoi kNN join.

Queries and data are grouped by pivots. A query group's summary is its radius, a data group's its rows and radius.
From the summaries of all data groups comes, for each query group, a score that the k-th best hit of none of its queries can be
under. A row goes only to the query groups for which its own upper bound, q.v <= p.v + radius |v|, reaches that score. Each group
is solved locally. Groups of many queries, or with many rows to meet, such as those of equal vectors, are dealt into blocks of
bounded size on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import vectors as V
from tessera.llm.scratch import keep

SAMPLE = 8192
#: Groups of the data; most groups of the queries, which are as many as fill blocks.
PIVOTS, MOST_GROUPS = 64, 1024
#: Scores that a task has in memory at once.
SCORES = 1 << 22


def reach(centres: np.ndarray, far: np.ndarray, pivots: np.ndarray, rows: np.ndarray, radius: np.ndarray, k: int) -> np.ndarray:
    """For each query group a score that the k-th best other row of each of its queries reaches, by the summaries of groups.

    With q = c + a and v = p + b, q.v = c.p + a.p + c.b + a.b, and the last three are bounded by the lengths of their parts.
    """
    slack = far[:, None] * np.linalg.norm(pivots, axis=1) + np.linalg.norm(centres, axis=1)[:, None] * radius + far[:, None] * radius
    low = np.where(rows > 0, centres @ pivots.T - slack, -np.inf)
    order = np.argsort(-low, axis=1, kind="stable")
    # One row more than k, as the query's own may be among them.
    enough = np.cumsum(rows[order], axis=1) > k
    at = np.where(enough.any(axis=1), enough.argmax(axis=1), len(rows) - 1)
    floor = np.where(enough.any(axis=1), np.take_along_axis(low, order, 1)[np.arange(len(centres)), at], -np.inf)
    return floor - 1e-6 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))


def needed(v: np.ndarray, centres: np.ndarray, far: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """For each row and query group, whether the row may be one of the best of a query in the group."""
    return v @ centres.T + far * np.linalg.norm(v, axis=1)[:, None] * (1 + 1e-9) >= floor


def products(q: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors: in double precision while every sum stays exact there."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(data).max(initial=0)) * q.shape[1]
    return (q.astype(float) @ data.astype(float).T).astype(np.int64) if most < 2**53 else q @ data.T


def best_rows(score: np.ndarray, ids: np.ndarray, query: int, k: int) -> np.ndarray:
    """Places of the k highest scores of rows with other ids than the query's; ids are in order, so ties go to the smaller."""
    score = np.where(ids == query, np.iinfo(np.int64).min, score)
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    at = at[np.argsort(-score[at], kind="stable")]
    return at[ids[at] != query][:k]


def search(rows: DataFrame, every: int = 20, k: int = 20, scale: int = 64, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, its k highest scores with the other rows.

    Components are floor(scale * x), whole numbers of under 2 ** 62. Vectors that are null, empty or that hold nulls or components
    that are not finite take no part, nor do null ids; vectors of other lengths than the query's are no rows for it. Ties go to the
    smaller id. Fewer than k other rows: all of them. Repeated rows of an id are candidates each, but for queries of that id; a
    query row that is repeated is answered once. No rows give no rows; further columns, of whatever names, are ignored.
    """
    good = V.valid(rows, id_col, vector_col).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    return V.by_length(good, lambda own: _search(own, every, k, pivots), "query_id long, rank int, vec_id long, score long")


def _search(good: DataFrame, every: int, k: int, pivots: int) -> DataFrame:
    x, context = V.sample(good, SAMPLE), good.sparkSession.sparkContext
    centres = V.kmeans(x, pivots)
    n_queries = good.where(F.col("vec_id") % every == 0).count()
    groups = V.kmeans(x, max(1, min(MOST_GROUPS, n_queries // V.BLOCK_ROWS)))
    shared = context.broadcast((centres, groups))

    def group(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                v, (centres, groups) = np.stack(part["v"].to_numpy()), shared.value
                own, mine = V.nearest(v, centres), V.nearest(v, groups)
                yield pd.DataFrame(
                    {"pivot": own, "far": np.linalg.norm(v - centres[own], axis=1), "mine": mine, "off": np.linalg.norm(v - groups[mine], axis=1), "vec_id": part["vec_id"], "v": part["v"]}
                )

    grouped = keep(good.mapInPandas(group, "pivot int, far double, mine int, off double, vec_id long, v array<double>"), "voronoi")
    count, radius = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in grouped.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # a row for each pivot
        count[r.pivot], radius[r.pivot] = r.n, r.far
    asking = grouped.where(F.col("vec_id") % every == 0)
    asked, far = np.zeros(len(groups), np.int64), np.zeros(len(groups))
    for r in asking.groupBy("mine").agg(F.count(F.lit(1)).alias("n"), F.max("off").alias("off")).collect():  # a row for each group
        asked[r.mine], far[r.mine] = r.n, r.off
    floor = np.where(asked > 0, reach(groups, far, centres, count, radius, k), np.inf)
    bounds = context.broadcast((groups, far, floor))

    def send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                may = needed(np.stack(part["v"].to_numpy()), *bounds.value)
                yield pd.DataFrame({"vec_id": part["vec_id"], "v": part["v"], "to": [np.flatnonzero(m).astype(np.int32) for m in may]})

    blocks = V.literal_map(V.salts({i: int(n) for i, n in enumerate(asked) if n}))
    parts = max(1, -(-int(count.sum()) // V.MANY_ROWS))
    queries = (
        asking.dropDuplicates(["vec_id"])
        .select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.col("mine").alias("to"))
        .withColumn("block", F.pmod(F.xxhash64("query_id"), blocks[F.col("to")]).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    )
    data = (
        grouped.select("vec_id", "v")
        .mapInPandas(send, "vec_id long, v array<double>, to array<int>")
        .withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)).cast("int"))
        .select("vec_id", "v", "part", F.explode("to").alias("to"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("to")] - 1)))
    )

    def solve(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asked) and len(held):
            held = held.sort_values("vec_id", kind="stable")
            ids, data = held["vec_id"].to_numpy(), np.stack(held["v"].to_numpy()).astype(np.int64)
            step, part = max(1, SCORES // len(ids)), int(held["part"].iloc[0])
            for i in range(0, len(asked), step):
                some = asked.iloc[i : i + step]
                scores = products(np.stack(some["q"].to_numpy()).astype(np.int64), data)
                for query, score in zip(some["query_id"], scores, strict=True):
                    out.append((int(query), part, [{"order": -int(score[j]), "vec_id": int(ids[j])} for j in best_rows(score, ids, query, k)]))
        return pd.DataFrame(out, columns=["query_id", "part", "found"])

    keys = ["to", "block", "part"]
    partial = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, "query_id long, part int, found array<struct<order:long,vec_id:long>>")
    return V.best(partial, k, -1)
