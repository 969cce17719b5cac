"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens by blocks of documents. A block keeps each document's positions as numbers of its distinct
words, and sends its distinct words, compressed, to the partition that their hash names: there every word is encoded once,
whatever number of blocks holds it, and its ids go back to the blocks, which put them together by position. A word reaches a
partition once for each block, so a very frequent word is no hot key. Blocks are bounded in characters (a longer document is
a block by itself), and so are the rows and groups that are shuffled. The number of buckets follows from the input's bytes, up to
MOST_BUCKETS, as a block sends a row to each. Blocks are cut twice, for the words and for the positions; a digest of a block's
words tells whether both times gave the same, and a task that meets two kinds fails rather than join ids to other words.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a block of documents.
BLOCK = 4_000_000
#: Bytes of input for a bucket of words and for a partition of blocks; most buckets; bytes of words that a task keeps ids of.
BUCKET_BYTES, PART_BYTES, MOST_BUCKETS, KNOWN_BYTES = 16 << 20, 6 << 20, 8192, 96 << 20
#: White space of Unicode, as the rank files' library takes it; the interpreter's own adds a few control characters.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def pattern(source: str = public_tokenizers.PATTERN) -> regex.Pattern:
    """The pre-token pattern with white space spelt out."""
    return regex.compile(source.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes together, and each id's start and length there."""
    enc = vocabulary(path)
    tokens = {rank: token for token, rank in enc._mergeable_ranks.items()}
    lengths = np.array([len(tokens.get(i, b"")) for i in range(max(tokens) + 1)], np.int64)
    return np.frombuffer(b"".join(tokens.get(i, b"") for i in range(max(tokens) + 1)), np.uint8), np.cumsum(lengths) - lengths, lengths


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lengths[i] - 1, for each i in turn."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def decode(ids: np.ndarray, path: str) -> bytes:
    """ids joined with the token-byte table."""
    table, starts, lengths = token_bytes(path)
    return table[gather(starts[ids], lengths[ids])].tobytes()


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _plain(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


_ROW = "block long, bucket int, digest long, words binary, n_words long, doc_id binary, lengths binary, stream binary"


def _blocks(parts: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """For each block a row with its documents, and one for each bucket with its distinct words there."""
    find, number = pattern().findall, None
    docs: list = []
    words: dict[str, int] = {}
    streams: list[np.ndarray] = []
    size = 0

    def done() -> pd.DataFrame:
        listed = list(words)
        at = np.array([zlib.crc32(w.encode()) % buckets for w in listed], np.int64)
        order = np.argsort(at, kind="stable")
        # A word's place in the order of buckets is its number in the stream, so ids that come back only need joining up.
        place = np.empty(len(listed), np.uint32)
        place[order] = np.arange(len(listed), dtype=np.uint32)
        stream = place[np.concatenate(streams)] if streams else np.zeros(0, np.uint32)
        planes = stream.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
        raw = [listed[i].encode() for i in order]
        digest = xxhash.xxh3_64_intdigest(np.array([len(w) for w in raw], "<u4").tobytes() + b"".join(raw)) - (1 << 63)
        ids = np.array([0 if d is None else d for d in docs], "<i8").tobytes() + np.array([d is None for d in docs], np.uint8).tobytes()
        rows = [(number, -1, digest, None, len(listed), _packed(ids), _packed(np.array([len(s) for s in streams], "<i8").tobytes()), _packed(planes))]
        bounds = np.searchsorted(at[order], np.arange(buckets + 1))
        for b in range(buckets):
            if bounds[b] < bounds[b + 1]:
                own = raw[bounds[b] : bounds[b + 1]]
                sizes = np.array([len(w) for w in own], "<u4").tobytes()
                rows.append((number, b, digest, _packed(sizes + b"".join(own)), len(own), None, None, None))
        return pd.DataFrame(rows, columns=["block", "bucket", "digest", "words", "n_words", "doc_id", "lengths", "stream"])

    for part in parts:
        if number is None and len(part):
            number = int(part["part"].iloc[0]) << 32
        for doc, text in zip(part["doc_id"].astype("Int64"), part["text"], strict=True):
            text = text or ""
            if docs and size + len(text) > BLOCK:
                yield done()
                number, docs, words, streams, size = number + 1, [], {}, [], 0
            found = find(text)
            for w in set(found).difference(words):
                words[w] = len(words)
            docs.append(None if doc is pd.NA else int(doc))
            streams.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
            size += len(text)
    if docs:
        yield done()


def _encoded(parts: Iterator[pd.DataFrame], path: str) -> Iterator[pd.DataFrame]:
    """Each distinct word of the partition is encoded once; back go, for each block and bucket, counts and ids in order.

    Words of over KNOWN_BYTES together are forgotten, and those that come again are encoded again: memory stays bounded.
    """
    core = vocabulary(path)._core_bpe
    known: dict[bytes, bytes] = {}
    held = 0
    for part in parts:
        for block, bucket, digest, data, n in zip(part["block"], part["bucket"], part["digest"], part["words"], part["n_words"], strict=True):
            raw = _plain(data)
            sizes = np.frombuffer(raw, "<u4", n)
            ends = (np.cumsum(sizes) + 4 * n).tolist()
            out, start = [], 4 * n
            for e in ends:
                w, start = raw[start:e], e
                if (ids := known.get(w)) is None:
                    ids = known[w] = np.array(core.encode_single_piece(w), "<u4").tobytes()
                    held += len(w) + len(ids) + 150  # what a dictionary's entry takes besides
                    if held > KNOWN_BYTES:
                        known, held = {}, 0
                out.append(ids)
            counts = np.array([len(x) // 4 for x in out], "<u4").tobytes()
            yield pd.DataFrame({"block": [block], "bucket": [bucket], "digest": [digest], "ids": [_packed(counts + b"".join(out))], "n_words": [n]})


def _joined(group: pd.DataFrame, path: str) -> pd.DataFrame:
    """A block's ids by its streams of positions: one row per document."""
    group = group.sort_values("bucket")
    main, rest = group[group["bucket"] < 0].iloc[0], group[group["bucket"] >= 0]
    if (group["digest"] != main["digest"]).any() or rest["n_words"].sum() != main["n_words"]:
        raise ValueError("the input's rows came in another order the second time: write it as a table first")
    counts, ids = [np.zeros(0, "<u4")], [np.zeros(0, "<u4")]
    for data, n in zip(rest["ids"], rest["n_words"], strict=True):
        raw = np.frombuffer(_plain(data), "<u4")
        counts.append(raw[:n])
        ids.append(raw[n:])
    count = np.concatenate(counts).astype(np.int64)
    every, start = np.concatenate(ids), np.cumsum(count) - count
    planes = np.frombuffer(_plain(main["stream"]), np.uint8).reshape(4, -1)
    stream = np.ascontiguousarray(planes.T).view("<u4").ravel()
    lengths = np.frombuffer(_plain(main["lengths"]), "<i8")
    raw = _plain(main["doc_id"])
    docs, none, rows, at = np.frombuffer(raw, "<i8", len(lengths)).tolist(), raw[8 * len(lengths) :], [], 0
    for doc, missing, n in zip(docs, none, lengths.tolist(), strict=True):
        own = stream[at : at + n]
        at += n
        rows.append((None if missing else doc, every[gather(start[own], count[own])].tobytes()))
    return pd.DataFrame({"doc_id": pd.array([d for d, _ in rows], "Int64"), "ids": [x for _, x in rows]})


def stored_bytes(docs: DataFrame) -> int:
    """The optimizer's estimate of a table's bytes: for files, theirs. Where it knows nothing, as many as fill the session's partitions."""
    known = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < 1 << 60 else BUCKET_BYTES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit), for every row of docs.

    A null or empty text has no ids; a text of any length is encoded whole, a very long one as a block by itself; repeated rows
    come as often as they are there, so ties are no question; null ids stay null; no rows give no rows; further columns, of
    whatever names, are ignored. The blocks are cut twice, once for the words and once for the positions: a block is made of one
    input partition's rows in their order. That costs time and saves writing the positions to disk; where the second cut differs,
    as it might after a shuffle, the query fails and asks for a written table.
    """
    n_bytes = stored_bytes(docs)
    buckets = buckets or min(MOST_BUCKETS, max(8, n_bytes // BUCKET_BYTES))
    cut = docs.select(F.spark_partition_id().alias("part"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInPandas(lambda parts: _blocks(parts, buckets), _ROW)
    words = cut.where("bucket >= 0").select("block", "bucket", "digest", "words", "n_words").repartition(buckets, "bucket")
    ids = words.mapInPandas(lambda parts: _encoded(parts, path), "block long, bucket int, digest long, ids binary, n_words long")
    none = F.lit(None).cast("binary")
    back = ids.select("block", "bucket", "digest", "ids", "n_words", none.alias("doc_id"), none.alias("lengths"), none.alias("stream")).unionByName(
        cut.where("bucket < 0").select("block", "bucket", "digest", none.alias("ids"), "n_words", "doc_id", "lengths", "stream")
    )
    blocks = back.repartition(min(1 << 17, max(8, n_bytes // PART_BYTES)), "block")
    return blocks.groupBy("block").applyInPandas(lambda g: _joined(g, path), "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded with data, the bytes of its ids.

    Rows without ids have no bytes; rows of any length are decoded whole; repeated rows come as often as they are there, so ties
    are no question; null ids of documents stay null; no rows give no rows; further columns are ignored.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(data=[decode(np.frombuffer(x, "<u4"), path) for x in part["ids"]])

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, ids binary, data binary")


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a round trip that ends in digests, with no bytes handed on."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame(
                {
                    "doc_id": part["doc_id"],
                    "n_tokens": [len(x) // 4 for x in part["ids"]],
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in part["ids"]],
                    "decoded_sha256": [hashlib.sha256(decode(np.frombuffer(x, "<u4"), path)).hexdigest() for x in part["ids"]],
                }
            )

    return encoded.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
