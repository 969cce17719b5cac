"""Near-duplicates by MinHash: many universal hash minima in bands, links confirmed on full shingle sets, connected components.

Documents of equal sets are one class, and only a class's least id goes on. ROWS minima to a band and BANDS bands miss a pair
of similarity 0.8 with a chance of (1 - 0.8 ** ROWS) ** BANDS, under 1e-7. Every bucket of a band names a pivot, and its members
are tested against the pivot, so that a bucket of n costs n tests. What no pivot joins is then compared within its bucket
(each member outside the bucket's main component with all others) by whole signatures and sets, blocks of bounded size against
each other in the task, so that a bucket's pairs are never rows; what links there is confirmed like the rest. No pairs of one
component are compared, and none of different components are left out. A bucket that has over HOT members still apart, as where
many texts share a frame, is first split by rare shingles: with the bucket's shingles ordered by how many members have them, two
members can only be similar if they share one of their first (1 - similarity) * n + 1, so members meet under these alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import skew
from tessera.llm.components import components
from tessera.llm.quality import chunks
from tessera.llm.scratch import keep

ROWS, BANDS = 6, 54
#: Members of a bucket that are compared together, and from which on those of a bucket still apart meet under rare shingles only.
BLOCK, HOT = 512, 4096
#: Shares of equal minima under which a pair is not confirmed: over five deviations below a similarity of 0.8.
LEAST_EQUAL = 0.68

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_draw = np.random.default_rng(20240229)
_LETTER = _draw.integers(0, 1 << 64, 256, dtype=_U)
_A = _draw.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32) | np.uint32(1)
_B = _draw.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
_STEP = 0xD6E8FEB86659FD93
_UNSTEP = pow(_STEP, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes: words are runs of bytes that are not ASCII white space, A-Z in lower case.

    A text of fewer words is one shingle, a text of none has no shingles.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) + 1 for r in raw])
    data = np.frombuffer(b" ".join(raw).translate(_LOWER) + b" ", np.uint8)
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return [np.zeros(0, _U)] * len(texts)
    summed = np.concatenate([np.zeros(1, _U), np.cumsum(_LETTER[data] * _powers(_STEP, len(data)), dtype=_U)])
    word = _mix((summed[ends] - summed[starts]) * _powers(_UNSTEP, len(data))[starts] + (ends - starts).astype(_U))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    fold = np.zeros(len(word), _U)
    shifted = np.append(word, np.zeros(words, _U))
    for j in range(words):
        fold = _mix(fold * _U(0x9E3779B97F4A7C15) + shifted[j : j + len(word)] + _U(j + 1))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(fold[a : b - words + 1]))
        elif b > a:
            one = np.zeros(1, _U)
            for j in range(b - a):
                one = _mix(one * _U(0x9E3779B97F4A7C15) + word[a + j : a + j + 1] + _U(j + 1))
            out.append(one)
        else:
            out.append(np.zeros(0, _U))
    return out


def signature(own: np.ndarray) -> np.ndarray:
    """The least value of every hash a * x + b (mod 2 ** 32) over a set that is not empty."""
    x = (own >> _U(32)).astype(np.uint32)
    least = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        values = _A[:, None] * x[None, i : i + 1024]
        values += _B[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One key for each band; the band's number is part of it."""
    rows = least.reshape(BANDS, ROWS).astype(_U)
    key = _mix(np.arange(1, BANDS + 1, dtype=_U) << _U(40))
    for j in range(ROWS):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + rows[:, j])
    return key.view(np.int64)


def _signed(parts: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for part in parts:
        for s in chunks(part["text"]):
            own, rows = part.iloc[s], []
            for x in shingle_sets(own["text"].tolist(), words):
                if len(x):
                    least = signature(x)
                    first, second = np.bitwise_xor.reduce(_mix(x)), np.add.reduce(_mix(x ^ _U(0x5851F42D4C957F2D)))
                    rows.append((len(x), int(first.view(np.int64)), int(second.view(np.int64)), bands(least), least.astype(np.uint8).tobytes()))
                else:
                    rows.append((0, 0, 0, None, None))
            yield pd.concat([own[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_shingles", "d1", "d2", "bands", "least"])], axis=1)


def _sets(parts: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for part in parts:
        for s in chunks(part["text"]):
            own = part.iloc[s]
            sets = shingle_sets(own["text"].tolist(), words)
            small = [np.unique((x >> _U(32)).astype(np.uint32)).tobytes() for x in sets]
            yield pd.DataFrame({"id": own["doc_id"], "own": [x.view(np.int64) for x in sets], "small": small})


def _linked(block: dict[str, np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links in a block of a bucket, of each member outside the bucket's main component with members of other components.

    Sizes and signatures rule out most; the rest are counted on whole sets, of 32 bits a shingle, with two to spare for hashes
    that meet.
    """
    ids, comp, n = block["id"], block["component"], block["n"]
    least = np.frombuffer(b"".join(block["least"]), np.uint8).reshape(len(ids), -1)
    sets = [np.frombuffer(x, np.uint32) for x in block["small"]]
    here = np.flatnonzero(block["here"])
    found = []
    for i in np.flatnonzero(block["asks"]).tolist():
        other = here[comp[here] != comp[i]]
        other = other[100 * np.minimum(n[other], n[i]) >= percent * np.maximum(n[other], n[i])]
        other = other[np.count_nonzero(least[other] == least[i], axis=1) >= LEAST_EQUAL * least.shape[1]]
        if not len(other):
            continue
        theirs = np.concatenate([sets[j] for j in other])
        at = np.minimum(np.searchsorted(sets[i], theirs), len(sets[i]) - 1)
        sizes = np.array([len(sets[j]) for j in other])
        shared = np.add.reduceat((sets[i][at] == theirs).astype(np.int64), np.cumsum(sizes) - sizes)
        linked = other[100 * (shared + 2) >= percent * (sizes + len(sets[i]) - shared)]
        found += [(min(a, b), max(a, b)) for a, b in ((int(ids[i]), int(ids[j])) for j in linked)]
    return found


def _pairs(parts: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """The links of every block; rows come sorted by block. Blocks have few members as a rule, so they are cut out of a part's arrays.

    What a part ends with is handed on to the next: a block has at most about BLOCK members on either side. Only links leave the task.
    """
    rest: dict[str, np.ndarray] = {}
    for part in chain(parts, [None]):
        if part is not None:
            now = {c: part[c].to_numpy() for c in part.columns}
            rest = {c: np.concatenate([rest[c], x]) for c, x in now.items()} if rest else now
        if not rest or not len(rest["key"]):
            continue
        edge = np.logical_or.reduce([rest[c][1:] != rest[c][:-1] for c in ("key", "p", "q")])
        cuts = [0, *(np.flatnonzero(edge) + 1).tolist()]
        if part is None:
            cuts.append(len(rest["key"]))
        found = [x for a, b in pairwise(cuts) for x in _linked({c: v[a:b] for c, v in rest.items()}, percent)]
        rest = {c: v[cuts[-1] :] for c, v in rest.items()}
        yield pd.DataFrame(sorted(set(found)), columns=["u", "v"], dtype="int64")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have the similarity."""
    both = pairs = keep(pairs.distinct(), "pairs")
    for c in "uv":  # a pivot is in as many pairs as its bucket has members
        own = sets.select(F.col("id").alias(c), F.col("own").alias(f"own_{c}"))
        both = skew.join(both, own, [c], counted=pairs.groupBy(c).agg(F.count(F.lit(1)).alias("rows")))
    shared = F.size(F.array_intersect("own_u", "own_v"))
    return keep(both.where(100 * shared >= percent * (F.size("own_u") + F.size("own_v") - shared)).select("u", "v"), "confirmed")


def _shingles(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        sets = [np.frombuffer(x, np.int32) for x in part["small"]]
        sizes = [len(x) for x in sets]
        if sum(sizes):
            out = part[["key", "id", "n", "component"]].loc[part.index.repeat(sizes)].reset_index(drop=True)
            yield out.assign(shingle=np.concatenate(sets), size=np.repeat(sizes, sizes))


def _by_rare_shingles(hot: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Buckets (key, members, id, n, component) of the members of hot buckets that share one of their rarest shingles there.

    What one member alone has can be no link, so it only counts; a shingle that most members have is split in the join. Two
    places more than the bound asks for make up for shingles whose 32 bits meet.
    """
    own = hot.join(sets.select("id", "small").hint("shuffle_hash"), "id").select("key", "id", "n", "component", "small")
    every = keep(own.mapInPandas(_shingles, "key long, id long, n long, component long, shingle int, size int"), "shingles")
    shared = every.groupBy("key", "shingle").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1")
    ordered = (
        skew.join(every, shared, ["key", "shingle"], "seen")
        .groupBy("key", "id", "n", "component")
        .agg(F.array_sort(F.collect_list(F.struct("seen", "shingle"))).alias("common"), F.first("size").alias("size"))
    )
    places = F.col("size") - F.ceil(F.col("size") * percent / 100.0) + 3 - (F.col("size") - F.size("common"))
    first = ordered.withColumn("common", F.slice("common", F.lit(1), F.greatest(F.lit(0), places).cast("int")))
    member = keep(first.select(F.explode("common.shingle").alias("shingle"), "key", "id", "n", "component").select(F.xxhash64("key", "shingle").alias("key"), "id", "n", "component"), "rare")
    several = member.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key", "members")
    return skew.join(member, several, ["key"], "members").select("key", "members", "id", "n", "component")


def _compared(open_: DataFrame, reps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links of members outside their bucket's main component with members of other components.

    Those outside are dealt into blocks, all members too, and each block of the one meets each of the other.
    """
    sums = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"))
    main = sums.groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), (F.sum("rows") - F.max("rows")).alias("apart"))
    some = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / BLOCK)).cast("int")
    dealt = open_.join(main.hint("shuffle_hash"), "key").withColumn("p", F.pmod(F.xxhash64("id"), some("members")).cast("int")).withColumn("q", F.pmod(F.xxhash64("id", F.lit(1)), some("apart")).cast("int"))
    role = lambda asks, p, q: F.struct(F.lit(asks).alias("asks"), F.lit(not asks).alias("here"), p.alias("p"), q.alias("q"))
    as_member = F.transform(F.sequence(F.lit(0), some("apart") - 1), lambda q: role(False, F.col("p"), q))
    as_asking = F.when(F.col("component") != F.col("main"), F.transform(F.sequence(F.lit(0), some("members") - 1), lambda p: role(True, p, F.col("q"))))
    none = F.array().cast("array<struct<asks:boolean,here:boolean,p:int,q:int>>")
    placed = (
        dealt.select("key", "id", "n", "component", F.explode(F.concat(as_member, F.coalesce(as_asking, none))).alias("role"))
        .groupBy("key", "id", "n", "component", "role.p", "role.q")
        .agg(F.bool_or("role.asks").alias("asks"), F.bool_or("role.here").alias("here"))
        .join(reps.select(F.col("doc_id").alias("id"), "least").hint("shuffle_hash"), "id")
        .join(sets.select("id", "small").hint("shuffle_hash"), "id")
    )
    sorted_ = placed.select("key", "p", "q", "id", "n", "component", "asks", "here", "least", "small").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return sorted_.mapInPandas(lambda parts: _pairs(parts, percent), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for every row of docs.

    Documents are linked where 100 * |intersection| >= percent * |union| of their sets of shingles; component_id is the least
    id that links lead to. A null or empty text has no shingles and is linked with nothing; a text of any length is taken whole.
    Rows of an equal id count as one document if their sets are equal; if not, each may link. A row with a null id has a null
    component_id and is not kept (kept null). Equal sets are one component, and of ids that tie for the least all are kept. No
    rows give no rows; further columns, of whatever names, are ignored.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    signed = keep(docs.mapInPandas(lambda p: _signed(p, words), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, least binary"), "signed")
    some = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = keep(some.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "classes")
    reps = keep(some.join(classes.select(F.col("rep").alias("doc_id"), "d1", "d2"), ["doc_id", "d1", "d2"], "left_semi").dropDuplicates(["doc_id", "d1", "d2"]), "reps")
    member = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    # A key is a random number that its bucket shares: ids are ordered by what it makes of them, so bands have different pivots.
    buckets = (
        member.groupBy("key")
        .agg(F.count(F.lit(1)).alias("members"), F.min(F.col("id").bitwiseXOR(F.col("key"))).alias("low"))
        .where("members > 1")
        .select("key", "members", F.col("low").bitwiseXOR(F.col("key")).alias("pivot"))
    )
    bucketed = keep(member.join(keep(buckets, "buckets").hint("shuffle_hash"), "key"), "bucketed")
    # Only documents that share a bucket are made into sets again.
    ids = bucketed.select(F.col("id").alias("doc_id")).distinct().hint("shuffle_hash")
    sets = keep(docs.join(ids, "doc_id", "left_semi").mapInPandas(lambda p: _sets(p, words), "id long, own array<long>, small binary"), "sets")
    sizes = reps.select(F.col("doc_id").alias("pivot"), F.col("n_shingles").alias("n_pivot")).hint("shuffle_hash")
    stars = bucketed.where("id <> pivot").select("id", "n", "pivot").distinct().join(sizes, "pivot")
    fitting = stars.where(100 * F.least("n", "n_pivot") >= percent * F.greatest("n", "n_pivot"))
    links = _confirmed(fitting.select(F.least("id", "pivot").alias("u"), F.greatest("id", "pivot").alias("v")), sets, percent)
    found = keep(components(links), "found")

    with_component = bucketed.join(found.hint("shuffle_hash"), "id", "left").select("key", "members", "id", "n", F.coalesce("component", "id").alias("component"))
    with_component = keep(with_component, "with-component")
    sums = with_component.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"))
    split = sums.groupBy("key").agg((F.sum("rows") - F.max("rows")).alias("apart")).where("apart > 0")
    open_ = keep(with_component.join(split.hint("shuffle_hash"), "key"), "open")
    near = _compared(open_.where(F.col("apart") <= HOT).drop("apart"), reps, sets, percent)
    hot = open_.where(F.col("apart") > HOT)
    if not hot.isEmpty():
        near = near.unionByName(_compared(keep(_by_rare_shingles(hot, sets, percent), "rare-open"), reps, sets, percent))
    more = _confirmed(near, sets, percent)
    if not more.isEmpty():
        stars = found.select(F.col("id").alias("u"), F.col("component").alias("v"))
        found = keep(components(stars.unionByName(more)), "found")

    known = classes.join(found.withColumnRenamed("id", "rep").hint("shuffle_hash"), "rep", "left").select("d1", "d2", "n_shingles", "rows", F.coalesce("component", "rep").alias("component"))
    out = skew.join(signed.select("doc_id", "n_shingles", "d1", "d2"), keep(known, "known"), ["d1", "d2", "n_shingles"], "rows", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
