"""Scalar kernels: weights, transfer curves, colour spaces, lens distortion."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def smoothstep(x: Column) -> Column:
    t = clamp(x, 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def huber(x: Column, delta: float) -> Column:
    a = F.abs(x)
    return F.when(a <= delta, 0.5 * x * x).otherwise(delta * (a - 0.5 * delta))


def bisquare(residual: Column, variance: Column, sigma: float = 4.0) -> Column:
    """max(0, 1 - r^2 / (sigma^2 var))^2."""
    w = F.greatest(F.lit(0.0), 1.0 - residual * residual / (sigma * sigma * variance))
    return w * w


def srgb(x: Column) -> Column:
    v = clamp(x, 0.0, 1.0)
    return F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def distort(x: Column, k1: float, k2: float, k3: float) -> Column:
    """A radius through the polynomial of a lens."""
    r2 = x * x
    return x * (1.0 + r2 * (k1 + r2 * (k2 + r2 * k3)))


def angle(y: Column, x: Column) -> Column:
    """atan2 by the C library: the JVM's is often off in the last place, which turns hues that are opposite or mirrored to the other side."""

    def run(y: pa.Array, x: pa.Array) -> pa.Array:
        return pa.array([None if a is None or b is None else math.atan2(a, b) for a, b in zip(y.to_pylist(), x.to_pylist(), strict=True)], pa.float64())

    return F.arrow_udf(run, "double")(y.cast("double"), x.cast("double"))


def delta_e00(l1: Column, a1: Column, b1: Column, l2: Column, a2: Column, b2: Column) -> Column:
    """The CIEDE2000 difference of two Lab colours, by the published formula."""
    size = lambda a, b: F.sqrt(a * a + b * b)
    mean_c7 = F.pow((size(a1, b1) + size(a2, b2)) / 2.0, F.lit(7.0))
    g = 0.5 * (1.0 - F.sqrt(mean_c7 / (mean_c7 + 25.0**7)))
    p1, p2 = a1 * (1.0 + g), a2 * (1.0 + g)
    c1, c2 = size(p1, b1), size(p2, b2)
    hue = lambda b, p: F.when((b == 0) & (p == 0), F.lit(0.0)).otherwise(F.pmod(F.degrees(angle(b, p)) + 360.0, F.lit(360.0)))
    h1, h2 = hue(b1, p1), hue(b2, p2)
    grey = c1 * c2 == 0
    d = h2 - h1
    dh = F.when(grey, 0.0).when(F.abs(d) <= 180, d).when(d > 180, d - 360.0).otherwise(d + 360.0)
    big_dh = 2.0 * F.sqrt(c1 * c2) * F.sin(F.radians(dh / 2.0))
    lm, cm, total = (l1 + l2) / 2.0, (c1 + c2) / 2.0, h1 + h2
    hm = F.when(grey, total).when(F.abs(d) <= 180, total / 2.0).when(total < 360, (total + 360.0) / 2.0).otherwise((total - 360.0) / 2.0)
    cos = lambda x: F.cos(F.radians(x))
    t = 1.0 - 0.17 * cos(hm - 30.0) + 0.24 * cos(2.0 * hm) + 0.32 * cos(3.0 * hm + 6.0) - 0.20 * cos(4.0 * hm - 63.0)
    sl = 1.0 + 0.015 * F.pow(lm - 50.0, F.lit(2.0)) / F.sqrt(20.0 + F.pow(lm - 50.0, F.lit(2.0)))
    sc, sh = 1.0 + 0.045 * cm, 1.0 + 0.015 * cm * t
    cm7 = F.pow(cm, F.lit(7.0))
    rt = -F.sin(F.radians(60.0 * F.exp(-F.pow((hm - 275.0) / 25.0, F.lit(2.0))))) * 2.0 * F.sqrt(cm7 / (cm7 + 25.0**7))
    x, y, z = (l2 - l1) / sl, (c2 - c1) / sc, big_dh / sh
    return F.sqrt(x * x + y * y + z * z + rt * y * z)


def oriented(code: Column, x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    """Where the sample at x, y of a frame comes to lie by each of the eight orientation codes."""
    right, below = width - 1 - x, height - 1 - y
    # Place by code; a code that is not known leaves it.
    places = [(x, y), (below, x), (y, right), (below, right), (y, x), (x, below), (right, y), (right, below)]
    dx, dy = x, y
    for k, (a, b) in enumerate(places[1:], 1):
        dx, dy = F.when(code == k, a).otherwise(dx), F.when(code == k, b).otherwise(dy)
    return dx, dy
