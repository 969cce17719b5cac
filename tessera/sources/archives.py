"""Factory records and model profiles: severity maps in a framed record file, excess by temperature as JSON, coefficients of a grid."""

from __future__ import annotations

import base64
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tessera.sources.container import MAGIC, ContainerError

# The record file's header (magic, size, footer's place and length, padding) and that of a map (unknown, length, width, height).
FILE, MAP, FOOTER = struct.Struct("<4sQQQ4x"), struct.Struct("<QIII"), bytes(16)

_MAPS = "path string, record int, width int, height int, y int, severity array<int>"


def record_file(maps: list[np.ndarray]) -> bytes:
    """Severity maps (rows by columns, as the factory has them) as one file."""
    packed = [(m.shape[1], m.shape[0], zlib.compress(np.ascontiguousarray(m, np.uint8).tobytes())) for m in maps]
    body = b"".join(MAP.pack(0, len(data), w, h) + data for w, h, data in packed)
    at = FILE.size + len(body)
    return FILE.pack(MAGIC, at + len(FOOTER), at, len(FOOTER)) + body + FOOTER


def severity_maps(data: bytes) -> Iterator[np.ndarray]:
    """The maps of a record file in the orientation of decoded samples, half a turn from the factory's; whatever breaks the format is an error."""
    if len(data) < FILE.size:
        raise ContainerError("a record file ends in its header")
    magic, size, footer, length = FILE.unpack_from(data)
    if magic != MAGIC or size != len(data) or footer + length != size:
        raise ContainerError("no record file, or one of another size than it says")
    at = FILE.size
    while at < footer:
        _, n, width, height = MAP.unpack_from(data, at)
        at, end = at + MAP.size, at + MAP.size + n
        if end > footer:
            raise ContainerError("a record crosses the footer")
        raw = zlib.decompress(data[at:end])
        if len(raw) != width * height:
            raise ContainerError(f"a record of {width} x {height} expands to {len(raw)} bytes")
        yield np.frombuffer(raw, np.uint8)[::-1].reshape(height, width)
        at = end
    if at != footer:
        raise ContainerError("records do not end at the footer")


def severities(files: DataFrame) -> DataFrame:
    """path, record, width, height, y and the row of severities, for each row of each map of files (path, content)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, data in zip(part["path"], part["content"], strict=True):
                for i, m in enumerate(severity_maps(bytes(data))):
                    yield pd.DataFrame({"path": path, "record": i, "width": m.shape[1], "height": m.shape[0], "y": np.arange(len(m)), "severity": list(m.astype(np.int32))})

    return files.select("path", "content").mapInPandas(run, _MAPS)


def excess_nodes(document: str, form: str, version: int) -> list[tuple]:
    """(family, lo, hi, node, excess) of a profile of excess codes by severity and temperature; one that breaks its rules is an error."""
    p = json.loads(document)
    nodes = p["temperature_nodes_c"]
    if p["format"] != form or p["version"] != version:
        raise ContainerError(f"a profile of format {p['format']}, version {p['version']}")
    if len(nodes) < 2 or p["reference_exposure_ns"] <= 0 or min(p["reference_analog_gain"], p["reference_digital_gain"]) <= 0 or not 0 <= p["training_quantile"] < 1:
        raise ContainerError("a profile whose metadata cannot be")
    out = []
    for family, responses in p["families"].items():
        for r in responses:
            lo, hi, excess = r["severity_min"], r["severity_max_exclusive"], r["excess_raw_codes"]
            if hi <= lo or len(excess) != len(nodes):
                raise ContainerError("a severity response that cannot be")
            out += [(family, lo, hi, float(t), float(e)) for t, e in zip(nodes, excess, strict=True)]
    return out


def grid_coefficients(encoded: str, columns: int, rows: int) -> np.ndarray:
    """Level and slope (2 x rows x columns) of a grid written as base64 of 16-bit numbers, levels in 256ths and slopes in 4096ths, pair by pair."""
    raw = np.frombuffer(base64.b64decode(encoded, validate=True), "<i2")
    if len(raw) != 2 * columns * rows:
        raise ContainerError(f"{len(raw)} coefficients for a grid of {columns} x {rows}")
    return raw.reshape(rows, columns, 2).transpose(2, 0, 1) / np.array([256.0, 4096.0])[:, None, None]
