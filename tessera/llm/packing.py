"""Best-fit packing: bounded-space online best-fit with open bins in a bitset keyed by free space.

Each task places the pieces it cuts as they come, in at most OPEN open bins: into the fullest bin that they fit in, or a new
one; with too many open, the fullest closes. A bin's rows leave the task when it closes, so that OPEN bounds its memory. What
stands in bins that are still open when a task ends is handed on, without texts or ids, and placed again, the longest first, by
tasks that each take over FAN others, in rounds till one task is left: so neither the number of files nor that of tasks costs
sequences.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import keep

LENGTH = 1024
END = 2
#: Bins that are open at once; they bound a task's memory.
OPEN = 2048
#: Tasks whose last open bins one task takes over.
FAN = 16
#: Rows that leave a task together.
BATCH = 1 << 14

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a tokenizers file, whose ids from 256 on are in the order of its merges."""
    if path not in _encodings:
        # Bytes that stand for themselves in such files; the others are given the letters from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        vocab = own["model"]["vocab"]
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in own["added_tokens"]):
            raise ValueError("added tokens that depend on what stands around them")
        added = {a["content"]: a["id"] for a in own["added_tokens"]}
        ranks = {bytes(letters[c] for c in word): i for word, i in vocab.items() if all(c in letters for c in word)}
        # An added token is written in plain letters; it is no product of merges.
        ranks = {word: i for word, i in ranks.items() if word not in {a.encode() for a in added}}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _encodings[path]


class Bins:
    """Open bins by free space; bit f of the bitset says whether one with f free is open.

    Best-fit asks for the lowest bit at or above a piece's length. With too many open, the fullest (the lowest bit) closes.
    """

    def __init__(self, length: int, most: int):
        self.length, self.most, self.open, self.bits, self.made = length, most, 0, 0, 0
        self.closed: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]

    def place(self, n: int) -> tuple[int, int]:
        """The bin of a piece of n and the offset in it."""
        fit = self.bits >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            own = self._take(free)
        else:
            free, own = self.length, self.made
            self.made += 1
        if free > n:
            if self.open == self.most:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            self.by_free[free - n].append(own)
            self.bits |= 1 << (free - n)
            self.open += 1
        else:
            self.closed.append(own)
        return own, self.length - free

    def _take(self, free: int) -> int:
        own = self.by_free[free].pop()
        self.open -= 1
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return own


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first one that may be shorter."""
    first = n % length or length
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pack(lengths: np.ndarray, length: int = LENGTH, most_open: int = OPEN) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, as they come, and the number of bins."""
    bins = Bins(length, most_open)
    placed = np.array([bins.place(int(n)) for n in lengths], np.int64).reshape(-1, 2)
    return placed[:, 0], placed[:, 1], bins.made


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PLACED = "task int, last boolean, doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def _place(pieces: Iterator[tuple], length: int, most_open: int, base: int) -> Iterator[pd.DataFrame]:
    """Rows of pieces (in the order of _PIECE) with their places, as their bins close; last: those of bins that are open at the end."""
    bins, held, out = Bins(length, most_open), {}, []
    task = TaskContext.get().partitionId()

    def frame(last: bool) -> pd.DataFrame:
        got = pd.DataFrame(out, columns=[*_PIECE, "sequence_id", "offset"])
        got["doc_id"], got["sequence_id"] = got["doc_id"].astype("Int64"), got["sequence_id"] + (base | task << 32)
        return got.assign(task=task, last=last)[["task", "last", *got.columns]]

    for row in pieces:
        own, at = bins.place(row[3])
        held.setdefault(own, []).append((*row, own, at))
        for done in bins.closed:
            out += held.pop(done)
        bins.closed.clear()
        if len(out) >= BATCH:
            yield frame(False)
            out = []
    if out:
        yield frame(False)
    out = [row for own in held.values() for row in own]
    if out:
        yield frame(True)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, most_open: int = OPEN, vocabulary: str = "byte_bpe_50k.json", added: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    A null or empty text is the end id alone; a text of any length is cut whole; rows are packed as they come, repeated ones,
    those that tie in length and those with a null id too; no rows give no rows; further columns, of whatever names, are ignored.
    Sequence ids are distinct over the table: the round's and the task's number, then a count. With added, the vocabulary's added
    tokens get their own ids where they stand in texts, as the library does by default; without, they are texts like others.
    """

    def pieces(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        enc = encoding(public_tokenizers.path(vocabulary))
        allowed = enc.special_tokens_set if added else set()
        for part in parts:
            for doc, text in zip(part["doc_id"].astype("Int64"), part["text"], strict=True):
                ids = np.append(np.asarray(enc.encode_to_numpy(text or "", allowed_special=allowed, disallowed_special=()), dtype="<u4"), np.array([end], "<u4"))
                for k, (start, n) in enumerate(cut(len(ids), length)):
                    yield None if doc is pd.NA else int(doc), k, start, n, zlib.crc32(ids[start : start + n].tobytes())

    def again(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for part in parts:
            part["doc_id"] = part["doc_id"].astype("Int64")
            for doc, *rest in zip(*(part[c] for c in _PIECE), strict=True):
                yield None if doc is pd.NA else int(doc), *map(int, rest)

    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    placed = keep(texts.mapInPandas(lambda p: _place(pieces(p), length, most_open, 0), _PLACED), "placed")
    done, tasks, round_ = placed.where("NOT last"), placed.where("last").agg(F.countDistinct("task")).first()[0], 0
    while tasks and (round_ == 0 or tasks > 1):
        round_, groups = round_ + 1, -(-tasks // FAN)
        rest = placed.where("last").withColumn("group", F.pmod("task", F.lit(groups)).cast("int")).repartition(groups, "group").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start", "ids_crc32")
        placed = keep(rest.select(*_PIECE).mapInPandas(lambda p, r=round_: _place(again(p), length, most_open, r << 56), _PLACED), "placed")
        done, tasks = done.unionByName(placed.where("NOT last")), placed.where("last").agg(F.countDistinct("task")).first()[0]
    return done.unionByName(placed.where("last")).select(*_PIECE, "sequence_id", "offset")
