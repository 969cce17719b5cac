"""Metadata of captures from the messages of their blocks: modules (one row per module frame), settings, captures, payload spans."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.container import ContainerError, unpack10

# Kinds of blocks, sample formats, cameras by number, field numbers of the messages.
HEADER_KIND, SETTINGS_KIND = 0, 1
BAYER_JPEG, PACKED10 = 0, 7
CAMERAS = "A1 A2 A3 A4 A5 B1 B2 B3 B4 B5 C1 C2 C3 C4 C5 C6".split()
HEADER = {"device_low": 6, "device_high": 7, "time": 3, "focal_length": 4, "reference": 5, "modules": 12, "settings": 19}
MODULE = {"id": 2, "enabled": 3, "mirror": 4, "lens": 5, "analog_gain": 7, "exposure": 8, "surface": 9, "temperature": 10, "red": 13, "digital_gain": 14, "frame": 15}
SURFACE = {"size": 2, "format": 3, "stride": 4, "offset": 5}
SETTINGS = {"scene": 6, "orientation": 9, "gain": 10, "integration": 11, "tripod": 16}

_MODULES = (
    "path string, block_index int, start long, length long, camera string, frame int, enabled boolean, format int, width int, height int, stride long, offset long, "
    "analog_gain double, digital_gain double, exposure_ns long, temperature_c int, red_x int, red_y int"
)
_SETTINGS = "path string, place long, focal_length_mm int, reference string, captured_at string, device string, scene int, orientation int, gain double, integration_ns long, tripod boolean"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ContainerError("a number in a message does not end")
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 128:
            return value & (2**64 - 1), at


def fields(data: bytes) -> dict[int, list]:
    """Values of a message by field number: whole numbers, or bytes for all other types."""
    out: dict[int, list] = {}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind in (1, 2, 5):
            n, at = _varint(data, at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at : at + n], at + n
            if at > len(data):
                raise ContainerError("a field runs beyond its message")
        else:
            raise ContainerError(f"wire type {kind} in a message")
        out.setdefault(tag >> 3, []).append(value)
    return out


def _last(m: dict, number: int, default=None):
    return m[number][-1] if number in m else default


def _real(m: dict, number: int, default: float | None = None) -> float | None:
    return struct.unpack("<f", m[number][-1])[0] if number in m else default


def _signed(value: int) -> int:
    """A plain signed number, which the wire has as 64 bits."""
    return value - 2**64 if value >= 2**63 else value


def _zigzag(value: int | None) -> int | None:
    return None if value is None else (value >> 1) ^ -(value & 1)


def _point(data: bytes | None) -> tuple[int | None, int | None]:
    if data is None:
        return None, None
    p = fields(data)
    return _signed(_last(p, 1, 0)), _signed(_last(p, 2, 0))


def _camera(number: int | None) -> str | None:
    if number is not None and number >= len(CAMERAS):
        raise ContainerError(f"no camera of number {number}")
    return None if number is None else CAMERAS[number]


def module_row(data: bytes) -> tuple | None:
    """A module's values, in the order of the table from camera on; None for one without an id or a surface."""
    m = fields(data)
    if MODULE["id"] not in m or MODULE["surface"] not in m:
        return None
    s = fields(_last(m, MODULE["surface"]))
    width, height = _point(_last(s, SURFACE["size"]))
    return (
        _camera(_last(m, MODULE["id"])), _last(m, MODULE["frame"], 0), bool(_last(m, MODULE["enabled"], 1)), _last(s, SURFACE["format"], BAYER_JPEG), width or 0, height or 0,
        _last(s, SURFACE["stride"], 0), _last(s, SURFACE["offset"]), _real(m, MODULE["analog_gain"], 1.0), _real(m, MODULE["digital_gain"], 1.0), _last(m, MODULE["exposure"], 0),
        _zigzag(_last(m, MODULE["temperature"])), *_point(_last(m, MODULE["red"])),
    )


def _moment(data: bytes | None) -> str | None:
    if data is None:
        return None
    t = fields(data)
    y, mo, d, h, mi, s = (_last(t, k, 0) for k in range(1, 7))
    return f"{y:04}-{mo:02}-{d:02} {h:02}:{mi:02}:{s:02}" if y and mo and d else None


def _settings(m: dict) -> tuple:
    tripod = _last(m, SETTINGS["tripod"])
    return _last(m, SETTINGS["scene"]), _last(m, SETTINGS["orientation"]), _real(m, SETTINGS["gain"]), _last(m, SETTINGS["integration"]), None if tripod is None else bool(tripod)


def modules(blocks: DataFrame) -> DataFrame:
    """A row for each module frame that a header block lists; disabled ones too, with the span of their block."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for b in part.itertuples(index=False):
                for data in fields(bytes(b.message)).get(HEADER["modules"], []):
                    row = module_row(data)
                    if row:
                        rows.append((b.path, b.block_index, b.start, b.length, *row))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _MODULES.split(", ")]).astype(object)

    return blocks.where(F.col("kind") == HEADER_KIND).select("path", "block_index", "start", "length", "message").mapInPandas(run, _MODULES)


def settings(blocks: DataFrame) -> DataFrame:
    """A row of what each header or settings block sets, null for what it leaves; place orders them in their file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for b in part.itertuples(index=False):
                m = fields(bytes(b.message))
                if b.kind == SETTINGS_KIND:
                    rows.append((b.path, 2 * b.block_index + 1, None, None, None, None, *_settings(m)))
                    continue
                low, high = _last(m, HEADER["device_low"]), _last(m, HEADER["device_high"])
                focal = _last(m, HEADER["focal_length"])
                own = fields(_last(m, HEADER["settings"], b""))
                device = None if low is None and high is None else f"{high or 0:016x}{low or 0:016x}"
                rows.append((b.path, 2 * b.block_index, None if focal is None else _signed(focal), _camera(_last(m, HEADER["reference"])), _moment(_last(m, HEADER["time"])), device, *_settings(own)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SETTINGS.split(", ")]).astype(object)

    return blocks.where(F.col("kind").isin(HEADER_KIND, SETTINGS_KIND)).select("path", "block_index", "kind", "message").mapInPandas(run, _SETTINGS)


def captures(blocks: DataFrame) -> DataFrame:
    """One row for each file: what was set last, and iso, shutter, night mode and tables of its modules.

    ISO is 100 times the gain, at least 1; where no block sets a gain or time, the reference module's hold.
    """
    names = ("focal_length_mm", "reference", "captured_at", "device", "scene", "orientation", "gain", "integration_ns", "tripod")
    last = settings(blocks).groupBy("path").agg(*(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("place"))).alias(n) for n in names))
    m = modules(blocks).where("enabled")
    # A camera has few frames, a file few cameras.
    have = m.groupBy("path").agg(
        F.array_sort(F.collect_set("camera")).alias("cameras"),
        F.count(F.lit(1)).alias("frames"),
        F.bool_or(F.col("format") == BAYER_JPEG).alias("jpeg"),
    )
    own = m.groupBy("path", F.col("camera").alias("reference")).agg(
        F.min_by(F.struct((F.greatest("analog_gain", F.lit(0.0)) * F.greatest("digital_gain", F.lit(0.0))).alias("g"), "exposure_ns"), F.struct("block_index", "frame")).alias("own")
    )
    gain, time = F.coalesce("gain", "own.g"), F.coalesce("integration_ns", "own.exposure_ns")
    return (
        last.join(have, "path", "left")
        .join(own, ["path", "reference"], "left")
        .select(
            "path", "reference", "focal_length_mm", F.try_to_timestamp("captured_at").cast("timestamp_ntz").alias("captured_at"), "device", F.coalesce("orientation", F.lit(0)).alias("orientation"),
            F.when((gain > 0) & (gain < float("inf")), F.greatest(F.lit(1.0), F.least(F.lit(2.0**32 - 1), F.round(gain * 100))).cast("long")).alias("iso"),
            F.when(time > 0, time).alias("shutter_ns"),
            F.coalesce((F.col("scene") == 4), F.lit(False)).__or__(F.coalesce("jpeg", F.lit(False))).alias("night_mode"),
            "tripod", F.coalesce("cameras", F.array().cast("array<string>")).alias("cameras"), F.coalesce("frames", F.lit(0)).alias("frames"),
        )
    )


def raw_layout(modules: DataFrame) -> DataFrame:
    """The first packed frame of each camera with its absolute span, pattern, and what is wrong with it (null: nothing)."""
    first = F.row_number().over(Window.partitionBy("path", "camera").orderBy("frame", "block_index"))
    rows = modules.where(F.col("enabled") & (F.col("format") == PACKED10)).withColumn("r", first).where("r = 1")
    even = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 0
    known = F.when((F.col("red_x") < 0) | (F.col("red_y") < 0), "MONO")
    for name, x, y in (("RGGB", True, True), ("GRBG", False, True), ("GBRG", True, False), ("BGGR", False, False)):
        known = known.when((even("red_x") == x) & (even("red_y") == y), name)
    spans = rows.select(
        "path", "camera", "width", "height", known.alias("pattern"), (F.col("start") + F.col("offset")).alias("begin"), (F.col("start") + F.col("offset") + F.col("stride") * F.col("height")).alias("end"),
        (F.col("start") + F.col("length")).alias("limit"), F.col("stride") * 4 == F.col("width") * 5, "temperature_c", "exposure_ns", "analog_gain", "digital_gain",
    ).toDF("path", "camera", "width", "height", "pattern", "begin", "end", "limit", "tight", "temperature_c", "exposure_ns", "analog_gain", "digital_gain")
    after = F.lead("begin").over(Window.partitionBy("path").orderBy("begin", "end"))
    wrong = F.when(F.col("begin").isNull() | (F.col("end") > F.col("limit")), "escapes its block").when(after < F.col("end"), "overlaps the next").when(~F.col("tight"), "rows are padded").when(F.col("pattern").isNull(), "no pattern")
    return spans.withColumn("wrong", wrong).drop("limit", "tight")


def plane_rows(files: DataFrame, spans: DataFrame) -> DataFrame:
    """path, camera, y, raw: the rows of samples of every good span of raw_layout, in the order of the stream.

    Rows of packed samples are groups of their own, so each is cut from the file's bytes and unpacked by itself.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, camera, width, height, payload in zip(*(part[c] for c in ("path", "camera", "width", "height", "payload")), strict=True):
                plane = unpack10(payload).reshape(height, width)
                yield pd.DataFrame({"path": path, "camera": camera, "y": np.arange(height), "raw": list(plane.astype(np.int32))})

    cut = files.select("path", "content").join(spans.where("wrong IS NULL"), "path")
    payload = F.substring("content", (F.col("begin") + 1).cast("int"), (F.col("end") - F.col("begin")).cast("int"))
    return cut.select("path", "camera", "width", "height", payload.alias("payload")).mapInPandas(run, "path string, camera string, y int, raw array<int>")


# Bytes of the header before compressed planes, and its mark.
JPEG_HEADER, JPEG_MARK = 1576, b"BJPG"


def payload_reads(modules: DataFrame, captures: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """path, begin, end, what: the bytes that the reference camera's frame asks for.

    Packed samples are one exact range. Compressed planes are a header first; with headers (path, header) of those that are read
    already, its four lengths give the whole range. A range that leaves its block is told in wrong.
    """
    first = F.row_number().over(Window.partitionBy("path").orderBy("block_index", "frame"))
    own = modules.where("enabled").join(captures.select("path", F.col("reference").alias("camera")), ["path", "camera"]).withColumn("r", first).where("r = 1")
    own = own.join(headers, "path", "left") if headers is not None else own.withColumn("header", F.lit(None).cast("binary"))
    begin = F.col("start") + F.col("offset")
    # Little-endian, from the byte after: what hex gives backwards.
    length = lambda at: sum((F.conv(F.hex(F.substring("header", at + i + 1, 1)), 16, 10).cast("long") * (1 << 8 * i) for i in range(1, 4)), F.conv(F.hex(F.substring("header", at + 1, 1)), 16, 10).cast("long"))
    known = F.substring("header", 1, 4) == F.lit(JPEG_MARK)
    size = F.when(F.col("format") == PACKED10, F.floor((F.col("width").cast("long") * F.col("height") * 10 + 7) / 8)).when(known, JPEG_HEADER + sum((length(at) for at in (12, 16, 20)), length(8))).otherwise(JPEG_HEADER)
    what = F.when((F.col("format") == PACKED10) | known, "payload").otherwise("header")
    end = begin + size
    return own.select("path", begin.alias("begin"), end.cast("long").alias("end"), what.alias("what"), F.when(end > F.col("start") + F.col("length"), "escapes its block").alias("wrong"))
