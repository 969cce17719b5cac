"""Framed blocks and packed samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import container


def test_blocks(spark, tmp_path):
    data = container.framed(0, b"head", b"payload") + container.framed(1, b"view") + container.framed(7, b"")
    (tmp_path / "in").mkdir()
    (tmp_path / "a.LRI").write_bytes(data)
    (tmp_path / "in" / "b.lri").write_bytes(data[:60])
    (tmp_path / "c.txt").write_bytes(b"no container")
    got = container.blocks(spark, str(tmp_path), strict=False).orderBy("path", "block_index").collect()
    assert [(r.path[-5:], r.block_index, r.start, r.length, r.kind, bytes(r.message)) for r in got] == [
        ("a.LRI", 0, 0, 43, 0, b"head"), ("a.LRI", 1, 43, 36, 1, b"view"), ("a.LRI", 2, 79, 32, 7, b""), ("b.lri", 0, 0, 43, 0, b"head"),
    ]
    assert container.blocks(spark, str(tmp_path), recursive=False).count() == 3
    with pytest.raises(container.ContainerError):
        list(container.scan(data[:60]))
    with pytest.raises(container.ContainerError):
        list(container.scan(b"x" * 40, strict=False))


def test_packed_samples(spark):
    # A small vector of the format.
    raw, want = bytes(range(1, 11)), [40, 144, 513, 774, 20, 64, 192, 513]
    assert container.unpack10(raw).tolist() == want
    draw = np.random.default_rng(1).integers(0, 1024, 64)
    assert (container.unpack10(container.pack10(draw)) == draw).all()
    rows = spark.createDataFrame([(bytearray(raw),), (bytearray(container.pack10(draw)),), (bytearray(),)], "p binary")
    assert [r.s for r in rows.select(container.samples10(F.col("p")).alias("s")).collect()] == [want, draw.tolist(), []]
