"""Exact substring dedup: every byte covered by a LENGTH-byte string that also starts earlier in the corpus is removed.

A string of LENGTH bytes has one anchor, the least of its GRAM-byte hashes (the first of equals), wherever the string stands;
strings that follow each other in a document and share their anchor make one snippet. Only snippets of anchors that occur
twice can hold repeats. Equal snippets are one class (pre-aggregated, by 128-bit digests), of which all but the earliest are
repeats throughout; what differs around a shared anchor, at the edges of copies, goes to run-length indexes (rindex), anchor by
anchor in blocks of bounded size, where matching statistics mark the strings that occur earlier. An anchor of more different
snippets than fit a block is split by a second key, the least of the strings' hashes under another order: its snippets are cut
again where that key changes, equal cuts are one class, and the rest is indexed by both keys. Only what is still too much for
a block then, thousands of different snippets of one pair of keys, is cut into single strings, which are classes by themselves.

A string is earlier by (doc_id, first byte); the same doc_id and first byte are not earlier, whatever row they stand in. Texts
are told apart by doc_id and a digest v, so repeated rows count once and different texts of one id have marks of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import rindex, skew
from tessera.llm.bpe import gather, stored_bytes
from tessera.llm.quality import chunks
from tessera.llm.scratch import keep

LENGTH, GRAM = 100, 24
#: Bytes that are cut into snippets together, and bytes of snippets that are indexed together.
CHUNK, BLOCK = 1 << 20, 1 << 20
#: Different snippets of a key that are indexed together at most, under a block's bytes; beyond, the key is split.
MANY = 4096
#: Bytes of kept snippets for a partition that indexes them.
PART_BYTES = 8 << 20

_U = np.uint64
_LETTER = np.random.default_rng(60221).integers(0, 1 << 64, 256, dtype=_U)
_PLACES = 26  # bits of a position in a chunk


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a * _U(0x9E3779B97F4A7C15) + b
    return z ^ (z >> _U(32))


def snippets(data: np.ndarray, sizes: np.ndarray, length: int = LENGTH, order: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that stand one after another in data: each snippet's anchor hash, its first byte, and its number of strings. Other orders give other anchors."""
    n = len(data)
    if n < length:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = [_LETTER[data]]
    for k in (1, 2, 4, 8):
        h.append(_two(h[-1][:-k], h[-1][k:]))
    gram = _mix(_two(h[4][: n - GRAM + 1], h[3][16 : 16 + n - GRAM + 1]) ^ _U(order))
    low = _U((1 << _PLACES) - 1)
    least = (gram & ~low) | np.arange(len(gram), dtype=_U)
    width, windows = 1, length - GRAM + 1
    while 2 * width <= windows:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < windows:
        least = np.minimum(least[: len(least) - (windows - width)], least[windows - width :])
    anchor = (least & low).astype(np.int64)  # of the string that begins at each byte
    each = np.maximum(0, sizes - length + 1)
    begins = np.cumsum(sizes) - sizes
    valid = gather(begins, each)
    if not len(valid):
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    own = anchor[valid]
    first = np.append(True, (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1))
    at = np.flatnonzero(first)
    return gram[own[at]], valid[at], np.diff(np.append(at, len(valid)))


def _pieces(raws: list[bytes], length: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents together up to CHUNK bytes, a longer one in pieces that share length - 1 bytes: bytes, sizes, document, offset in it."""
    held: list[tuple[bytes, int, int]] = []
    size = 0
    for i, raw in enumerate(raws):
        for start in range(0, max(1, len(raw) - length + 1), CHUNK):
            piece = raw[start : start + CHUNK + length - 1]
            if held and size + len(piece) > CHUNK:
                yield _joined(held)
                held, size = [], 0
            held.append((piece, i, start))
            size += len(piece)
    if held:
        yield _joined(held)


def _joined(held: list[tuple[bytes, int, int]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    return b"".join(h[0] for h in held), np.array([len(h[0]) for h in held]), np.array([h[1] for h in held]), np.array([h[2] for h in held])


def _digests(strings: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), "<i8").reshape(-1, 2)


_ANCHORS = "anchor long, s1 long, s2 long, doc_id long, v long, at int, n int"


def _anchors(batches: Iterator[pa.RecordBatch], length: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, digests = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        raws = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in batch.column(2)]
        for data, sizes, doc, offset in _pieces(raws, length):
            anchor, at, n = snippets(np.frombuffer(data, np.uint8), sizes, length)
            if not len(at):
                continue
            columns = [pa.array(anchor.view(np.int64))]
            if digest:
                both = _digests([data[s:e] for s, e in zip(at.tolist(), (at + n - 1 + length).tolist(), strict=True)])
                begins = np.cumsum(sizes) - sizes
                piece = np.searchsorted(begins, at, side="right") - 1
                place = at - begins[piece] + offset[piece]
                columns += [pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids[doc[piece]]), pa.array(digests[doc[piece]]), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "s1", "s2", "doc_id", "v", "at", "n"][: len(columns)])


def _cut(parts: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """The bytes of the snippets that are asked of each document."""
    for part in parts:
        part = part.drop_duplicates(["doc_id", "v"])
        for k in chunks(part["text"]):
            own, rows = part.iloc[k], []
            for doc, v, text, asked in zip(own["doc_id"], own["v"], own["text"], own["asked"], strict=True):
                raw = text.encode()
                rows += [(a["anchor"], doc, v, a["at"], a["many"], raw[a["at"] : a["at"] + a["n"] - 1 + length]) for a in asked]
            yield pd.DataFrame(rows, columns=["anchor", "doc_id", "v", "at", "many", "own"])


def _spans(doc: np.ndarray, v: np.ndarray, at: np.ndarray, length: int) -> pd.DataFrame:
    """Marked strings as spans of bytes, those that follow each other as one."""
    order = np.lexsort((at, v, doc))
    doc, v, at = doc[order], v[order], at[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (v[1:] != v[:-1]) | (at[1:] != at[:-1] + 1)) if len(at) else np.zeros(0, bool))
    last = np.append(first[1:], len(at)) - 1 if len(first) else first
    return pd.DataFrame({"doc_id": doc[first], "v": v[first], "s": at[first], "e": at[last] + length})


def _indexed(parts: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by anchor: whole anchors go together into indexes of about BLOCK bytes."""
    held: list[pd.DataFrame] = []
    size = 0

    def solve() -> pd.DataFrame:
        block = pd.concat(held).drop_duplicates(["anchor", "doc_id", "v", "at"])
        strings = block["own"].tolist()
        sizes = np.array([len(s) + 1 for s in strings])
        begins = np.cumsum(sizes) - sizes
        rank = np.unique(block["doc_id"].to_numpy(), return_inverse=True)[1].astype(np.int64)
        places = np.repeat((rank << 32) + block["at"].to_numpy().astype(np.int64) - begins, sizes) + np.arange(sizes.sum())
        marked = np.flatnonzero(rindex.repeated(strings, length, places))
        which = np.searchsorted(begins, marked, side="right") - 1
        return _spans(block["doc_id"].to_numpy()[which], block["v"].to_numpy()[which], block["at"].to_numpy()[which] + marked - begins[which], length)

    for part in parts:
        if not len(part):
            continue
        # What is held may go once another anchor begins.
        if size >= BLOCK and held[-1]["anchor"].iloc[-1] != part["anchor"].iloc[0]:
            yield solve()
            held, size = [], 0
        cuts = np.append(0, np.flatnonzero(part["anchor"].to_numpy()[1:] != part["anchor"].to_numpy()[:-1]) + 1)
        bytes_to = np.append(0, np.cumsum(part["own"].map(len).to_numpy()))
        start = 0
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
            if size + bytes_to[b] - bytes_to[start] >= BLOCK and b < len(part):
                held.append(part.iloc[start:b])
                yield solve()
                held, size, start = [], 0, b
        held.append(part.iloc[start:])
        size += int(bytes_to[-1] - bytes_to[start])
    if held:
        yield solve()


def _split(parts: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Snippets cut again by a second key: rows as of _anchors, with both keys as their anchor, and their bytes."""
    for part in parts:
        if not len(part):
            continue
        strings = part["own"].tolist()
        sizes = np.array([len(s) for s in strings])
        begins, data = np.cumsum(sizes) - sizes, b"".join(strings)
        key, at, n = snippets(np.frombuffer(data, np.uint8), sizes, length, order=0x5851F42D4C957F2D)
        row = np.searchsorted(begins, at, side="right") - 1
        own = [data[s:e] for s, e in zip(at.tolist(), (at + n - 1 + length).tolist(), strict=True)]
        both = _digests(own)
        anchor = _two(part["anchor"].to_numpy().view(_U)[row], key).view(np.int64)
        place = part["at"].to_numpy()[row] + at - begins[row]
        yield pd.DataFrame({"anchor": anchor, "s1": both[:, 0], "s2": both[:, 1], "doc_id": part["doc_id"].to_numpy()[row], "v": part["v"].to_numpy()[row], "at": place, "n": n, "own": own})


def _single(parts: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Every string of snippets by itself, as rows of _anchors."""
    for part in parts:
        if not len(part):
            continue
        sizes = part["own"].map(len).to_numpy() - length + 1
        both = _digests([s[i : i + length] for s in part["own"] for i in range(len(s) - length + 1)])
        at = gather(part["at"].to_numpy().astype(np.int64), sizes)
        yield pd.DataFrame({"anchor": both[:, 0], "s1": both[:, 0], "s2": both[:, 1], "doc_id": np.repeat(part["doc_id"].to_numpy(), sizes), "v": np.repeat(part["v"].to_numpy(), sizes), "at": at, "n": 1})


_MARKS = "doc_id long, v long, s long, e long"


def _digest(text: str) -> Column:
    return F.xxhash64(F.col(text))


_CLASS = ["anchor", "s1", "s2"]


def _classes(rows: DataFrame, name: str, length: int, own: bool = False) -> tuple[DataFrame, DataFrame]:
    """Classes of equal snippets, each with its first row, and the spans of all other rows.

    Minima are summed up before they are shuffled; a class that holds a large share of all rows is split in the join.
    """
    first = [F.min(F.struct("doc_id", "at", "v")).alias("first"), F.max("n").alias("n"), F.count(F.lit(1)).alias("rows")]
    classes = keep(rows.groupBy(*_CLASS).agg(*first, *([F.first("own").alias("own")] if own else [])), f"{name}-classes")
    firsts = classes.where("rows > 1").select(*_CLASS, "first", "rows")
    later = skew.join(rows.select(*_CLASS, "doc_id", "v", "at", "n"), firsts, _CLASS, "rows").where("doc_id <> first.doc_id OR at <> first.at")
    return classes, later.select("doc_id", "v", F.col("at").cast("long").alias("s"), (F.col("at") + F.col("n") - 1 + length).cast("long").alias("e"))


def _edges(rows: DataFrame, classes: DataFrame, several: DataFrame | None, extra: list[str]) -> DataFrame:
    """The first snippet of each class whose anchor has other classes too, with kinds, the number of these.

    Where texts of one id differ elsewhere, a class may have its first snippet in several of them: each has edges.
    """
    kinds = keep(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1"), "kinds")
    earliest = classes.select("anchor", "first.doc_id", "first.v", "first.at", "n", *extra)
    if several is not None:
        firsts = classes.where("rows > 1").select(*_CLASS, "first")
        tied = rows.join(several, "doc_id", "left_semi").join(firsts.hint("shuffle_hash"), _CLASS).where("doc_id = first.doc_id AND at = first.at AND v <> first.v")
        earliest = earliest.unionByName(tied.select("anchor", "doc_id", "v", "at", "n", *extra).distinct())
    return skew.join(earliest, kinds, ["anchor"], "kinds")


def _index(edges: DataFrame, length: int) -> DataFrame:
    """The spans that run-length indexes mark in kept snippets, whose anchors are all of bounded size."""
    conf = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(1 << 17, max(conf, stored_bytes(edges) // PART_BYTES))
    return edges.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInPandas(lambda p: _indexed(p, length), _MARKS)


def repeat_marks(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, v, s, e): spans of bytes covered by strings that start earlier too, in no order, overlapping, from documents with an id; v is the text's digest."""
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", _digest("text").alias("v"), "text")
    again = keep(texts.mapInArrow(lambda b: _anchors(b, length, False), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1"), "anchors")
    every = texts.mapInArrow(lambda b: _anchors(b, length, True), _ANCHORS)
    rows = keep(skew.join(every, again, ["anchor"], "seen").drop("seen"), "snippets")
    several = keep(rows.groupBy("doc_id").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low <> high").select("doc_id"), "several")
    several = None if several.isEmpty() else several
    classes, out = _classes(rows, "snippet", length)
    asked = (
        _edges(rows, classes, several, [])
        .select("doc_id", "v", F.struct("anchor", "at", "n", (F.col("kinds") > MANY).alias("many")).alias("one"))
        .groupBy("doc_id", "v")
        .agg(F.collect_list("one").alias("asked"))
    )
    edges = keep(
        texts.join(asked.hint("shuffle_hash"), ["doc_id", "v"]).mapInPandas(lambda p: _cut(p, length), "anchor long, doc_id long, v long, at int, many boolean, own binary"), "edges"
    )
    out = out.unionByName(_index(edges.where("NOT many"), length))
    if edges.where("many").isEmpty():
        return out
    rows = keep(edges.where("many").drop_duplicates(["anchor", "doc_id", "v", "at"]).mapInPandas(lambda p: _split(p, length), f"{_ANCHORS}, own binary"), "split")
    classes, later = _classes(rows, "split", length, own=True)
    edges = keep(_edges(rows, classes, several, ["own"]), "split-edges")
    out = out.unionByName(later).unionByName(_index(edges.where(F.col("kinds") <= MANY), length))
    if edges.where(F.col("kinds") > MANY).isEmpty():
        return out
    rows = keep(edges.where(F.col("kinds") > MANY).mapInPandas(lambda p: _single(p, length), _ANCHORS), "strings")
    return out.unionByName(_classes(rows, "string", length)[1])


def union(spans: list, n: int) -> list[tuple[int, int]]:
    """Maximal runs of spans, within n bytes."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], min(x["e"], n)) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        elif s < e:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _with_spans(docs: DataFrame, length: int, name: str = "spans_") -> DataFrame:
    v = name + "v"
    marks = repeat_marks(docs, length).withColumnRenamed("v", v).groupBy("doc_id", v).agg(F.collect_set(F.struct("s", "e")).alias(name))
    return docs.withColumn(v, _digest("text")).join(keep(marks, "marks").hint("shuffle_hash"), ["doc_id", v], "left")


def removed(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, for every row of docs.

    A null text is empty, and one under length bytes loses nothing; a text of any length is taken whole, in overlapping pieces.
    Rows of an equal id and text are one document, and both keep what it keeps; texts of one id that differ have spans of their
    own, and none is earlier at the same byte. Rows with a null id take no part and lose nothing. No rows give no rows; further
    columns, of whatever names, are ignored.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for text, spans in zip(part["text"], part["spans_"], strict=True):
                raw = (text or "").encode()
                gone = union([] if spans is None else list(spans), len(raw))
                kept, at = hashlib.sha256(), 0
                for s, e in gone:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                rows.append((len(raw), sum(e - s for s, e in gone), len(gone), kept.hexdigest()))
            yield pd.concat([part[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])], axis=1)

    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return _with_spans(docs, length).mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without(text: str, spans: list) -> str:
    """text without the characters that lie wholly in the spans of its bytes."""
    raw, out, at = text.encode(), [], 0
    for s, e in union(spans, len(raw)):
        while s < e and raw[s] & 0xC0 == 0x80:
            s += 1
        while e > s and e < len(raw) and raw[e] & 0xC0 == 0x80:
            e -= 1
        out.append(raw[at:s])
        at = max(at, e)
    return b"".join([*out, raw[at:]]).decode()


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated passages cut from text, and n_chars, if there, made to fit.

    Null texts stay null, empty ones empty; texts of any length are taken whole; rows all stay, those of an equal id and text with
    equal cuts, those with a null id uncut; no rows give no rows; other columns pass as they are.
    """
    columns = docs.columns
    name = "spans_" + "_" * max(map(len, columns))  # longer than any name that is there

    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or x is None else without(t, list(x)) for t, x in zip(texts, spans, strict=True)], dtype=object)

    out = _with_spans(docs, length, name).withColumn("text", F.pandas_udf(run, "string")(F.col("text"), F.col(name)))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)
