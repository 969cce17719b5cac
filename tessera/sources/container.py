"""Capture containers as tables: one row per framed block, and samples of packed payloads."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The block header (magic, block length, message offset, message length, kind), padded to 32 bytes.
MAGIC, HEADER, HEADER_SIZE = b"LELR", struct.Struct("<4sQQIB"), 32

_BLOCKS = "path string, block_index int, start long, length long, kind int, message binary"


class ContainerError(ValueError):
    """A file that breaks the format."""


def framed(kind: int, message: bytes, payload: bytes = b"") -> bytes:
    """One block: header, payload, message."""
    size = HEADER_SIZE + len(payload) + len(message)
    head = HEADER.pack(MAGIC, size, HEADER_SIZE + len(payload), len(message), kind)
    return head.ljust(HEADER_SIZE, b"\0") + payload + message


def _checked(head: bytes, start: int, size: int | None) -> tuple[int, int, int, int]:
    """A header's block length, message offset, message length and kind, if they can be."""
    if len(head) < HEADER_SIZE:
        raise ContainerError(f"truncated header at {start}")
    magic, length, offset, n, kind = HEADER.unpack_from(head)
    if magic != MAGIC:
        raise ContainerError(f"no block at {start}")
    if length < HEADER_SIZE or offset + n > length:
        raise ContainerError(f"block at {start} has a length that cannot be")
    if size is not None and start + length > size:
        raise ContainerError(f"truncated block at {start}")
    return length, offset, n, kind


def scan(data: bytes, strict: bool = True) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, length, kind, message) of each block. Not strict: up to the last complete one, as of a file still on its way."""
    start = 0
    while start < len(data):
        if start + HEADER_SIZE > len(data):
            if strict:
                raise ContainerError(f"truncated header at {start}")
            return
        length, offset, n, kind = _checked(data[start : start + HEADER_SIZE], start, None)
        if start + length > len(data):
            if strict:
                raise ContainerError(f"truncated block at {start}")
            return
        yield start, length, kind, data[start + offset : start + offset + n]
        start += length


def parsed(files: DataFrame, strict: bool = True) -> DataFrame:
    """path, block_index, start, length, kind, message of every block in files (path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(path, i, *block) for path, data in zip(part["path"], part["content"], strict=True) for i, block in enumerate(scan(data, strict))]
            yield pd.DataFrame(rows, columns=["path", "block_index", "start", "length", "kind", "message"])

    return files.select("path", "content").mapInPandas(run, _BLOCKS)


def files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path, length and content of the containers of a folder (suffix .lri, in either case), in order of their paths; none is an error.

    Where content is not asked for, files are listed and not read.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[lL][rR][iI]").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    if found.select("path").isEmpty():
        raise ContainerError(f"no containers under {folder}")
    return found.select("path", "length", "content").orderBy("path")


def blocks(spark: SparkSession, folder: str, recursive: bool = True, strict: bool = True) -> DataFrame:
    """path, block_index, start, length, kind, message of every block in the containers of a folder."""
    return parsed(files(spark, folder, recursive), strict)


def sparse_blocks(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """The same by ranges: of each file only the headers and messages are read, never a payload; a file may be of any size."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for part in parts:
            rows = []
            for path, size in zip(part["path"], part["length"], strict=True):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as f:
                    start = i = 0
                    while start < size:
                        head = f.read_at(HEADER_SIZE, start)
                        length, offset, n, kind = _checked(head, start, size)
                        rows.append((path, i, start, length, kind, f.read_at(n, start + offset)))
                        start, i = start + length, i + 1
            yield pd.DataFrame(rows, columns=["path", "block_index", "start", "length", "kind", "message"])

    return files(spark, folder, recursive).select("path", "length").mapInPandas(run, _BLOCKS)


def pack10(samples: np.ndarray) -> bytes:
    """10-bit samples, a multiple of four, as groups of five bytes, the last group first."""
    s = np.asarray(samples, np.int64).reshape(-1, 4)
    word = (s[:, 0] << 30) | (s[:, 1] << 20) | (s[:, 2] << 10) | s[:, 3]
    return np.stack([(word >> (8 * i)) & 255 for i in range(5)], axis=1).astype(np.uint8)[::-1].tobytes()


def unpack10(packed: bytes) -> np.ndarray:
    """The samples of pack10's bytes, for whole frames in an Arrow function."""
    b = np.frombuffer(packed, np.uint8).reshape(-1, 5)[::-1].astype(np.int64)
    word = sum(b[:, i] << (8 * i) for i in range(5))
    return np.stack([(word >> shift) & 1023 for shift in (30, 20, 10, 0)], axis=1).astype(np.int16).ravel()


def samples10(packed: Column) -> Column:
    """The same as an expression, for rows of samples: an array of int."""
    groups = F.floor(F.length(packed) / 5).cast("int")
    byte = lambda g, i: F.conv(F.hex(F.substring(packed, F.length(packed) - 5 * g - 4 + i, F.lit(1))), 16, 10).cast("long")
    word = lambda g: sum((F.shiftleft(byte(g, i), 8 * i) for i in range(1, 5)), byte(g, 0))
    words = F.transform(F.when(groups > 0, F.sequence(F.lit(0), groups - 1)).otherwise(F.array().cast("array<int>")), word)
    return F.flatten(F.transform(words, lambda w: F.array(*(F.shiftright(w, s).bitwiseAND(F.lit(1023)).cast("int") for s in (30, 20, 10, 0)))))


def sample10(packed: Column, index: Column) -> Column:
    """One sample of packed groups, by its place, without the others."""
    at = F.length(packed) - 4 - 5 * F.floor(index / 4).cast("int")  # of the group's last byte, from 1
    word = F.lit(0).cast("long")
    for i in range(5):
        word = word * 256 + F.conv(F.hex(F.substring(packed, at + 4 - i, F.lit(1))), 16, 10).cast("long")
    places = F.array(*(F.shiftright(word, s).bitwiseAND(F.lit(1023)).cast("int") for s in (30, 20, 10, 0)))
    return places[(index % 4).cast("int")]
