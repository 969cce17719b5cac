"""Colour and confidence as expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.optics import clamp, smoothstep, srgb

# The D65 white, and the linear map from XYZ to sRGB.
D65 = (0.95047, 1.0, 1.08883)
XYZ_TO_SRGB = ((3.2406, -1.5372, -0.4986), (-0.9689, 1.8758, 0.0415), (0.0557, -0.2040, 1.0570))

_SPLIT, _SLOPE = (6 / 29) ** 3, 3 * (6 / 29) ** 2


def product(matrix: tuple, v: tuple[Column, Column, Column]) -> list[Column]:
    """A 3 x 3 matrix of numbers by a vector of columns."""
    return [a * v[0] + b * v[1] + c * v[2] for a, b, c in matrix]


def xyz_to_lab(x: Column, y: Column, z: Column, white: tuple = D65) -> list[Column]:
    f = [F.when(v / w > _SPLIT, F.cbrt(v / w)).otherwise(v / w / _SLOPE + 4 / 29) for v, w in zip((x, y, z), white, strict=True)]
    return [116.0 * f[1] - 16.0, 500.0 * (f[0] - f[1]), 200.0 * (f[1] - f[2])]


def lab_to_xyz(l: Column, a: Column, b: Column, white: tuple = D65) -> list[Column]:  # noqa: E741
    y = (l + 16.0) / 116.0
    return [w * F.when(f > 6 / 29, f * f * f).otherwise(_SLOPE * (f - 4 / 29)) for f, w in zip((y + a / 500.0, y, y - b / 200.0), white, strict=True)]


def balanced(channels: list[Column], gains: list[Column], white: float) -> list[Column]:
    """Channels by their gains, cut where the first of them is white, so that white stays neutral."""
    top = F.least(*(g * white for g in gains))
    return [F.least(c * g, top) for c, g in zip(channels, gains, strict=True)]


def shoulder(channels: list[Column], white: list[Column], start: float = 0.94) -> list[Column]:
    """Channels drawn to their median as the brightest nears white."""
    r, g, b = channels
    middle = r + g + b - F.greatest(r, g, b) - F.least(r, g, b)
    t = smoothstep((F.greatest(*(c / w for c, w in zip(channels, white, strict=True))) - start) / (1.0 - start))
    return [c + t * (middle - c) for c in channels]


def reinhard(x: Column) -> Column:
    return x / (1.0 + x)


def chroma_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """How far two XYZ colours lie apart in x and z chromaticity."""
    (ax, ay, az), (bx, by, bz) = a, b
    return F.hypot(ax / (ax + ay + az) - bx / (bx + by + bz), az / (ax + ay + az) - bz / (bx + by + bz))


def single_variance(signal: Column, a: Column, b: Column, step: float) -> Column:
    """Variance of a reading: linear in the signal, no less than a step's square."""
    return F.greatest(a * signal + b, F.lit(step * step))


def pair_variance(first: Column, second: Column, a: Column, b: Column, gain: Column, step: float) -> Column:
    """Variance of first less gain times second."""
    return single_variance(first, a, b, step) + gain * gain * single_variance(second, a, b, step)


def correspondence_confidence(share: Column, least: float) -> Column:
    """From 0.05 at the least share of inliers, smoothly, to 1 at 0.25 above it."""
    return F.greatest(F.lit(0.05), smoothstep((share - least) / 0.25))


def noise_confidence(reference: Column, own: Column) -> Column:
    return clamp(reference / own, 0.1, 4.0)


def hann(distance: Column, radius: float) -> Column:
    return F.when(F.abs(distance) < radius, 0.5 + 0.5 * F.cos(distance * 3.141592653589793 / radius)).otherwise(0.0)


def undistorted(x: Column, k1: float, k2: float, k3: float, rounds: int = 20) -> Column:
    """The radius that the lens takes to x, by fixed-point rounds."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x, lambda r, _: x / (1.0 + r * r * (k1 + r * r * (k2 + r * r * k3))))


def framed_share(native: Column, framed: Column) -> Column:
    """The part of a module's frame, in each direction, that a picture of another focal length shows."""
    return clamp(native / framed, 0.05, 1.0)


# The map from XYZ under D50 to XYZ under D65.
D50_TO_D65 = ((0.9555766, -0.0230393, 0.0631636), (-0.0282895, 1.0099416, 0.0210077), (0.0122982, -0.020483, 1.3299098))


def output(xyz: tuple[Column, Column, Column], exposure: float) -> list[Column]:
    """Linear sRGB, between 0 and 1, of XYZ under D50."""
    return [clamp(c * exposure, 0.0, 1.0) for c in product(XYZ_TO_SRGB, tuple(product(D50_TO_D65, xyz)))]


def displayed(linear: Column) -> Column:
    return srgb(linear)


def log_chroma(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Logarithms of x and z over y."""
    return F.ln(x / y), F.ln(z / y)
