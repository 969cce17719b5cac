"""Connected components by alternating large-star and small-star over a table of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import skew
from tessera.llm.scratch import keep

#: So many links (4 MB of them) are read and solved by the driver: a round's plans and tasks cost it far more memory than that.
FEW = 1 << 18


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(links: DataFrame, n: int) -> DataFrame:
    """The links (n at most) with m, the least of u and all it links to. The minimum is summed up before it is shuffled; hubs are split in the join."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows")).select("u", F.least("u", "m").alias("m"), "rows")
    return skew.join(links, least, ["u"], all_rows=n)


def large_star(links: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of u links to the least of u's neighbourhood instead."""
    return _least(_both(links), 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(links: DataFrame, n: int) -> DataFrame:
    """u and its smaller neighbours link to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    near = _least(down, n)
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and their components, on arrays: the roots of each link are joined to the lower one, and every id then names its root."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        new, low = root.copy(), np.minimum(root[a], root[b])
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new != (new := new[new])).any():
            pass
        if (new == root).all():
            return ids, ids[root]
        root = new


def components(links: DataFrame, most_rounds: int = 50, few: int = FEW) -> DataFrame:
    """id and component (the least id of its component), for every id of links (u, v); self-links and repeated links do no harm.

    Of more than few links, rounds go on till links are stars that no round changes; each is written to the shared folder, and
    only a count and a checksum come to the driver.
    """
    n = links.count()
    if n <= few:
        u, v = (c.to_numpy() for c in links.select("u", "v").where("u <> v").toArrow().columns)
        found = dict(zip(("id", "component"), _least_of(u, v), strict=True))
        return links.sparkSession.createDataFrame(pa.table(found), "id long, component long")
    links = keep(small_star(links, n), "links")
    last = None
    for _ in range(most_rounds):
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last or not now[0]:
            break
        last = now
        links = keep(small_star(large_star(links, now[0]), 2 * now[0]), "links")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
