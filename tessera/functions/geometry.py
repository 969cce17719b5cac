"""A camera as expressions on columns: points to pixels and back, lens distortion, planes seen by two cameras."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Camera:
    """k: the two upper rows of the intrinsic matrix; turn and shift take the world to the camera; bend are five coefficients of a lens, on coordinates less centre over scale.

    With decimals (and whole numbers) in turn, shift and k, points of decimals are projected exactly up to the division by depth.
    """

    k: tuple
    turn: tuple
    shift: tuple
    width: int
    height: int
    bend: tuple = (0.0, 0.0, 0.0, 0.0, 0.0)
    centre: tuple = (0.0, 0.0)
    scale: float = 1.0


def bent(bend: tuple, x: Column, y: Column) -> tuple[Column, Column]:
    """Radial terms k1, k2, k3 and tangential p1, p2, in the order k1, k2, p1, p2, k3."""
    k1, k2, p1, p2, k3 = bend
    r = x * x + y * y
    radial = 1.0 + k1 * r + k2 * r * r + k3 * r * r * r
    return x * radial + 2.0 * p1 * x * y + p2 * (r + 2.0 * x * x), y * radial + p1 * (r + 2.0 * y * y) + 2.0 * p2 * x * y


def unbent(bend: tuple, x: Column, y: Column, rounds: int = 20) -> tuple[Column, Column]:
    """What the lens takes to x, y, by fixed-point rounds."""
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))

    def step(p: Column, _: Column) -> Column:
        u, v = bent(bend, p["x"], p["y"])
        return point(p["x"] + (x - u), p["y"] + (y - v))

    out = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), point(x, y), step)
    return out["x"], out["y"]


def _sum(row: tuple, v: tuple) -> Column:
    first, *rest = (F.lit(a) * c for a, c in zip(row, v, strict=True))
    return sum(rest, first)


def projected(camera: Camera, x: Column, y: Column, z: Column, bounded: bool = True) -> tuple[Column, Column]:
    """The pixel of a point: null behind the camera, and where bounded is set further than half a frame outside the sensor, where the lens's terms mean nothing."""
    a, b, c = (_sum(row, (x, y, z)) + F.lit(s) for row, s in zip(camera.turn, camera.shift, strict=True))
    over = lambda k, p: F.try_divide((F.lit(k) * p).cast("double"), c.cast("double"))
    u, v = over(camera.k[0][0], a) + over(camera.k[0][1], b) + camera.k[0][2], over(camera.k[1][1], b) + camera.k[1][2]
    seen = c > 0
    if bounded:
        seen = seen & (u >= -0.5 * camera.width) & (u <= 1.5 * camera.width) & (v >= -0.5 * camera.height) & (v <= 1.5 * camera.height)
    p, q = bent(camera.bend, (u - camera.centre[0]) / camera.scale, (v - camera.centre[1]) / camera.scale)
    return F.when(seen, camera.centre[0] + camera.scale * p), F.when(seen, camera.centre[1] + camera.scale * q)


def ray(camera: Camera, u: Column, v: Column) -> list[Column]:
    """The unit direction, in the world, of what a pixel sees."""
    p, q = unbent(camera.bend, (u - camera.centre[0]) / camera.scale, (v - camera.centre[1]) / camera.scale)
    p, q = camera.centre[0] + camera.scale * p, camera.centre[1] + camera.scale * q
    y = (q - camera.k[1][2]) / camera.k[1][1]
    x = (p - camera.k[0][2] - camera.k[0][1] * y) / camera.k[0][0]
    world = [_sum(tuple(row[i] for row in camera.turn), (x, y, F.lit(1.0))) for i in range(3)]  # the turn's inverse is its transpose
    size = F.sqrt(sum((c * c for c in world[1:]), world[0] * world[0]))
    return [c / size for c in world]
