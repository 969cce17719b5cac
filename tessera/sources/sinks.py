"""What leaves as files: 16-bit PNG in bands, run manifests, quantised profiles; and checksums that merge."""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The PNG signature, the checksum's modulus, rows of a band.
SIGNATURE, MODULUS, BAND = b"\x89PNG\r\n\x1a\n", 65521, 64


def adler_combined(first: int, second: int, length: int) -> int:
    """The Adler-32 of two runs of bytes from that of each and the length of the second."""
    a1, b1, a2, b2 = first & 65535, first >> 16, second & 65535, second >> 16
    return ((b1 + b2 + length * (a1 - 1)) % MODULUS) << 16 | (a1 + a2 - 1) % MODULUS


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _filtered(band: np.ndarray, channels: int) -> bytes:
    """Rows as big-endian bytes, each less the byte one pixel before it, after the filter's number."""
    rows = band.reshape(len(band), -1).astype(">u2").view(np.uint8).reshape(len(band), -1)
    out = rows.copy()
    out[:, 2 * channels :] -= rows[:, : -2 * channels]
    return np.concatenate([np.ones((len(band), 1), np.uint8), out], axis=1).tobytes()


def png16(image: np.ndarray, level: int = 2) -> bytes:
    """A grey (height x width) or RGB (height x width x 3) image of 16-bit samples. Bands are compressed one by one, so memory follows a band, not the image's copies."""
    height, width = image.shape[:2]
    channels = 1 if image.ndim == 2 else image.shape[2]
    if channels not in (1, 3) or not height or not width:
        raise ValueError("an image has 1 or 3 channels and at least one sample")
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 16, 0 if channels == 1 else 2, 0, 0, 0))]
    sum_, head = 1, b"\x78\x01"
    for y in range(0, height, BAND):
        raw = _filtered(image[y : y + BAND], channels)
        z = zlib.compressobj(level, zlib.DEFLATED, -15)
        body = z.compress(raw) + z.flush(zlib.Z_SYNC_FLUSH)
        sum_ = adler_combined(sum_, zlib.adler32(raw), len(raw))
        parts.append(_chunk(b"IDAT", head + body))
        head = b""
    return b"".join([*parts, _chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", sum_)), _chunk(b"IEND", b"")])


def write_png16(frames: DataFrame, folder: str, level: int = 2) -> DataFrame:
    """Write each frame (name, width, height, samples: 16-bit little-endian bytes) to folder, by a name of its own and a rename, and return name, path, bytes. A task that is run again writes the same file.

    The folder must be one that all executors see.
    """

    def run(parts: Iterable) -> Iterable:
        import pandas as pd

        os.makedirs(folder, exist_ok=True)
        for part in parts:
            rows = []
            for f in part.itertuples(index=False):
                samples = np.frombuffer(bytes(f.samples), "<u2")
                colour = len(samples) == 3 * f.width * f.height
                data = png16(samples.reshape((f.height, f.width, 3) if colour else (f.height, f.width)), level)
                path, own = os.path.join(folder, f"{f.name}.png"), os.path.join(folder, f".{f.name}.{uuid.uuid4().hex}")
                with open(own, "wb") as out:
                    out.write(data)
                os.replace(own, path)
                rows.append((f.name, path, len(data)))
            yield pd.DataFrame(rows, columns=["name", "path", "bytes"])

    return frames.select("name", "width", "height", "samples").mapInPandas(run, "name string, path string, bytes long")


def manifest(frames: DataFrame, run: str, *order: str) -> DataFrame:
    """run and one JSON of its frames in order; a run's frames are few (one per camera and capture of one export)."""
    own = [c for c in frames.columns if c != run]
    keys = [c for c in order] + [c for c in own if c not in order]
    return frames.groupBy(run).agg(F.to_json(F.struct(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list(F.struct(*keys))).alias("frames"))).alias("manifest"))


def quantised(value: Column, scale: float) -> Column:
    """A 16-bit signed number, rounded half away from zero and held within its range."""
    return F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.round(value * scale))).cast("smallint")
