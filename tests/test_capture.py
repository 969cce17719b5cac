"""Metadata of hand-made captures, files that are written, and captures that arrive in parts."""

import io
import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.sources import container, metadata, sinks
from tessera.streaming import progressive


def number(field, value):
    out = bytearray()
    for v in (field << 3, value % 2**64):
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def nested(field, data):
    return number(field, len(data)).replace(number(field, 0)[:-1], bytes([*number(field, 0)[:-2], number(field, 0)[-2] | 2]), 1) + data


def real(field, value):
    return bytes([field << 3 | 5]) + struct.pack("<f", value)


def module(camera, frame, offset, red=(0, 0), form=7, **extra):
    m = metadata.MODULE
    s = nested(2, number(1, 64) + number(2, 48)) + number(3, form) + number(4, 80) + number(5, offset)
    return number(m["id"], camera) + nested(m["surface"], s) + real(m["analog_gain"], 6.25) + real(m["digital_gain"], 1.015625) + number(m["exposure"], 14999805952) + number(m["temperature"], 80) + nested(m["red"], number(1, red[0]) + number(2, red[1])) + number(m["frame"], frame)


def test_capture(spark, tmp_path):
    payload = bytes(3 * 64 * 48 * 5 // 4)
    own = [module(0, 0, 32, (1, 1)), module(1, 1, 32 + 7680), module(1, 0, 32 + 3840, (-1, -1)), module(5, 0, 32 + 7000, (1, 0)), module(6, 0, 10**6), number(2, 3)]
    when = b"".join(number(i, v) for i, v in enumerate((2024, 8, 23, 1, 30, 0), 1))
    head = nested(3, when) + number(4, 70) + number(5, 0) + number(6, 255) + b"".join(nested(12, m) for m in own)
    data = container.framed(0, head, payload) + container.framed(1, number(6, 4) + number(16, 1)) + container.framed(1, number(9, 7))
    (tmp_path / "a.lri").write_bytes(data)
    (tmp_path / "b.lri").write_bytes(container.framed(1, real(10, 2.0)))
    blocks = container.blocks(spark, str(tmp_path))
    rows = metadata.modules(blocks)
    assert rows.count() == 5 and rows.first().temperature_c == 40
    a, b = metadata.captures(blocks).orderBy("path").collect()
    assert (a.reference, a.focal_length_mm, str(a.captured_at), a.orientation, a.night_mode, a.tripod) == ("A1", 70, "2024-08-23 01:30:00", 7, True, True)
    assert (a.iso, a.shutter_ns, a.cameras, a.frames, a.device) == (635, 14999805952, ["A1", "A2", "B1", "B2"], 5, "0" * 30 + "ff")
    assert (b.reference, b.iso, b.shutter_ns, b.cameras, b.night_mode) == (None, 200, None, [], False)
    got = {r.camera: r for r in metadata.raw_layout(rows).collect()}
    assert {k: (v.pattern, v.begin, v.wrong) for k, v in got.items()} == {
        "A1": ("BGGR", 32, None), "A2": ("MONO", 32 + 3840, "overlaps the next"), "B1": ("GRBG", 32 + 7000, None), "B2": ("RGGB", 10**6, "escapes its block"),
    }


def unpacked(data):
    """An independent reader of what the writer may write."""
    at, body = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        if kind == b"IHDR":
            w, h, depth, colour = struct.unpack(">IIBB", part[:10])
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    c = 3 if colour == 2 else 1
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + 2 * c * w)
    assert depth == 16 and (raw[:, 0] == 1).all()
    pixels = np.cumsum(raw[:, 1:].reshape(h, w, 2 * c), axis=1, dtype=np.uint64).astype(np.uint8)
    return pixels.reshape(h, w, c, 2).view(">u2")[..., 0]


def test_png(spark, tmp_path):
    r = np.random.default_rng(3)
    for shape in ((1, 1), (130, 7), (65, 9, 3)):
        image = r.integers(0, 65536, shape).astype(np.uint16)
        assert (unpacked(sinks.png16(image)).reshape(shape) == image).all()
    first, second = b"some bytes", b"and others"
    assert sinks.adler_combined(zlib.adler32(first), zlib.adler32(second), len(second)) == zlib.adler32(first + second)
    frames = spark.createDataFrame([("g", 7, 130, bytearray(r.integers(0, 65536, 910).astype("<u2").tobytes()))], "name string, width int, height int, samples binary")
    (out,) = sinks.write_png16(frames, str(tmp_path / "out")).collect()
    assert unpacked(io.open(out.path, "rb").read()).shape == (130, 7, 1) and [p.name for p in (tmp_path / "out").iterdir()] == ["g.png"]


def test_manifest(spark):
    frames = spark.createDataFrame([("r", "B1", "x"), ("r", "A1", "y"), ("r", "A1", "x")], "run string, camera string, source string")
    (m,) = sinks.manifest(frames, "run", "camera", "source").collect()
    assert [(f["camera"], f["source"]) for f in json.loads(m.manifest)["frames"]] == [("A1", "x"), ("A1", "y"), ("B1", "x")]
    assert [spark.range(1).select(sinks.quantised(F.lit(v), 256.0).alias("q")).first().q for v in (0.5, -1e9, 1e9)] == [128, -32768, 32767]


def test_progressive(spark, tmp_path):
    parts = [[("a", "A1", 0, False), ("a", "A1", 0, False)], [("a", None, None, True), ("b", "C1", 2, False)], [("a", "A2", 1, False), ("a", "A1", 0, False), ("a", None, None, True)]]
    schema = "capture string, camera string, frame int, colour boolean"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in{i}")
    import glob
    import os
    import shutil

    os.makedirs(tmp_path / "in")
    for i in range(3):
        shutil.copy(glob.glob(f"{tmp_path}/in{i}/part-*.json")[0], tmp_path / "in" / f"{i}.json")
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = progressive.told(stream).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("told").collect())
    assert got == [("a", "A1", 0, False), ("a", "A1", 0, True), ("a", "A2", 1, True), ("b", "C1", 2, False)]
