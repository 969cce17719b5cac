"""Clipped samples rebuilt from what is around them, and depths that nothing around them supports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import bands, frames

_AROUND = [(dy, dx) for dy in (-2, 0, 2) for dx in (-2, 0, 2) if dy or dx]
RECOVERED = "y int, samples array<int>, sure array<int>, clipped int, recovered int"


def _green(raw: np.ndarray, top: int, height: int, y: np.ndarray, x: np.ndarray, clip: float) -> tuple[np.ndarray, np.ndarray]:
    """Green at red or blue sites, from the smoother of the two directions whose samples are good, and how many are: none at the frame's edge."""
    inside = (y > 0) & (x > 0) & (y < height - 1) & (x < raw.shape[1] - 1)
    at = lambda dy, dx: raw[np.clip(y - top + dy, 0, len(raw) - 1), np.clip(x + dx, 0, raw.shape[1] - 1)]
    a, b, c, d = at(0, -1), at(0, 1), at(-1, 0), at(1, 0)
    along, across = inside & (np.maximum(a, b) < clip), inside & (np.maximum(c, d) < clip)
    first = along & (~across | (np.abs(a - b) <= np.abs(c - d)))
    return np.where(first, (a + b) / 2, (c + d) / 2), along.astype(int) + across


def _site(raw: np.ndarray, top: int, height: int, y: np.ndarray, x: np.ndarray, clip: float, black: float) -> tuple[np.ndarray, np.ndarray]:
    """Values of clipped red and blue sites from differences to green around them, and how sure they are (0: not found)."""
    green, ways = _green(raw, top, height, y, x, clip)
    summed, weights, found = np.zeros(len(y)), np.zeros(len(y)), np.zeros(len(y), int)
    for dy, dx in _AROUND:
        colour = raw[y - top + dy, x + dx]
        near, n = _green(raw, top, height, y + dy, x + dx, clip)
        good = (colour < clip) & (n > 0)
        w = np.where(good, 1 / (np.hypot(dy, dx) * (1 + np.abs(near - green) / 256)), 0)
        summed, weights, found = summed + w * (colour - near), weights + w, found + good
    ok = (ways > 0) & (found >= 2)
    value = np.maximum(green + summed / np.where(weights > 0, weights, 1), black)
    return value, np.where(ok, np.minimum(128 + np.minimum(found, 5) * 20 + ways * 8, 232), 0)


def _same(raw: np.ndarray, top: int, y: np.ndarray, x: np.ndarray, clip: float) -> tuple[np.ndarray, np.ndarray]:
    """Values of clipped green sites from opposite neighbours of their phase, smooth pairs weighing more."""
    summed, weights, found = np.zeros(len(y)), np.zeros(len(y)), np.zeros(len(y), int)
    for dy, dx in ((0, 2), (2, 0), (2, 2), (-2, 2)):
        a, b = raw[y - top - dy, x - dx], raw[y - top + dy, x + dx]
        good = np.maximum(a, b) < clip
        w = np.where(good, 1 / (1 + np.abs(a - b) / 128) ** 2, 0)
        summed, weights, found = summed + w * (a + b) / 2, weights + w, found + good
    return summed / np.where(weights > 0, weights, 1), np.where(found > 0, 148 + np.minimum(found, 4) * 20, 0)


def highlights(rows: DataFrame, height: int, black: float = 0.0, white: float = 65535.0, pattern: str = "RGGB") -> DataFrame:
    """m, y, samples with clipped ones rebuilt (never under the clip), how sure each is in 255ths (0: clipped and not found), and counts.

    Clipped is from 0.995 of the range on. Sites within two of the frame's edge stay as they are; rows that a frame lacks count as
    clipped around others, and as none themselves.
    """
    clip = black + max(white - black, 64.0) * 0.995

    def run(y: np.ndarray, a: dict, own: np.ndarray) -> pd.DataFrame:
        raw, out = a["raw"].astype(float), a["raw"].copy()
        colour = frames.colours(pattern, raw.shape)
        sure = np.where(raw >= clip, 0, 255)
        at, x = np.nonzero((raw >= clip) & own[:, None] & ((y >= 2) & (y < height - 2))[:, None] & (np.arange(raw.shape[1]) >= 2) & (np.arange(raw.shape[1]) < raw.shape[1] - 2))
        for green in (True, False):
            here = (colour[at, x] == 1) == green
            yy, xx = y[at[here]], x[here]
            value, q = _same(raw, int(y[0]), yy, xx, clip) if green else _site(raw, int(y[0]), height, yy, xx, clip, black)
            got = q > 0
            out[at[here][got], xx[got]] = np.clip(np.floor(np.maximum(value[got], clip) + 0.5), 0, 65535)
            sure[at[here][got], xx[got]] = q[got]
        return pd.DataFrame({"y": y[own], "samples": list(out[own].astype(np.int32)), "sure": list(sure[own].astype(np.int32)), "clipped": (raw[own] >= clip).sum(1), "recovered": ((raw[own] >= clip) & (sure[own] > 0)).sum(1)})

    return bands.by_band(rows, run, RECOVERED, height, halo=4)


def supported(rows: DataFrame, height: int, tolerance: float, edge: float = 0.6) -> DataFrame:
    """m, y, kept: of each node of a grid of inverse depths (columns inverse, guide, sure; null: none) whether its neighbours support it.

    A neighbour does that lies within tolerance in inverse depth, with no strong edge of the guide between. One is enough for a
    node that is 0.75 sure, two for others.
    """

    def run(y: np.ndarray, a: dict, own: np.ndarray) -> pd.DataFrame:
        inverse, guide, sure = (np.pad(a[c].astype(float) / SCALE, 1, constant_values=np.nan) for c in ("inverse", "guide", "sure"))
        inverse[inverse <= 0] = np.nan
        agree = np.zeros(a["inverse"].shape, int)
        middle = np.s_[1:-1, 1:-1]
        for dy in range(3):
            for dx in range(3):
                if (dy, dx) != (1, 1):
                    cut = np.s_[dy : dy + agree.shape[0], dx : dx + agree.shape[1]]
                    with np.errstate(invalid="ignore"):
                        agree += (np.abs(inverse[cut] - inverse[middle]) <= tolerance) & (np.abs(guide[cut] - guide[middle]) <= edge)
        kept = ~np.isnan(inverse[middle]) & (agree >= np.where(sure[middle] >= 0.75, 1, 2))
        return pd.DataFrame({"y": y[own], "kept": list(kept[own].astype(np.int32))})

    return bands.by_band(rows, run, "y int, kept array<int>", height, halo=2, columns=("inverse", "guide", "sure"))


#: What nodes' values are in units of, as whole numbers.
SCALE = 1e9


def islands(inverse: np.ndarray, guide: np.ndarray, tolerance: float, least: int = 24, edge: float = 0.6) -> np.ndarray:
    """Which nodes (not NaN) belong to a connected patch of so many; neighbours connect as in supported. For a frame's grid, which is coarse."""
    label = np.where(np.isnan(inverse), -1, np.arange(inverse.size).reshape(inverse.shape))
    pad = lambda a, v: np.pad(a, 1, constant_values=v)
    near, guides = pad(inverse, np.nan), pad(guide, np.nan)
    cuts = [np.s_[dy : dy + inverse.shape[0], dx : dx + inverse.shape[1]] for dy in range(3) for dx in range(3) if (dy, dx) != (1, 1)]
    with np.errstate(invalid="ignore"):
        links = [(np.abs(near[c] - inverse) <= tolerance) & (np.abs(guides[c] - guide) <= edge) for c in cuts]
    while True:
        padded, new = pad(label, -1), label.copy()
        for c, linked in zip(cuts, links, strict=True):
            new = np.where(linked, np.minimum(new, padded[c]), new)
        flat = new.ravel()
        flat = np.where(flat >= 0, flat[np.maximum(flat, 0)], -1)  # each label follows its own label: patches shrink to one fast
        if (flat == label.ravel()).all():
            break
        label = flat.reshape(label.shape)
    sizes = np.bincount(label[label >= 0].ravel(), minlength=inverse.size)
    return (label >= 0) & (sizes[np.maximum(label, 0)] >= least)


def light_prior(rg: Column, bg: Column, anchors: list[tuple[float, float, float]]) -> Column:
    """mired, place (segment and share on it) and sure of a white balance: its logarithms projected on the nearest segment between anchors.

    Anchors are (mired, ln rg, ln bg), in order of mired, two or more of them.
    """
    options = []
    for i, ((m0, x0, y0), (m1, x1, y1)) in enumerate(zip(anchors[:-1], anchors[1:], strict=True)):
        dx, dy = x1 - x0, y1 - y0
        size = dx * dx + dy * dy
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((rg - x0) * dx + (bg - y0) * dy) / size)) if size > 1e-12 else F.lit(0.0)
        off = rg - x0 - dx * share, bg - y0 - dy * share
        distance = F.sqrt(off[0] * off[0] + off[1] * off[1])
        options.append(F.struct(distance.alias("distance"), F.lit(i).alias("segment"), share.alias("share"), (m0 + (m1 - m0) * share).alias("mired"), (1.0 / (1.0 + 4.0 * distance)).alias("sure")))
    return F.array_min(F.array(*options))
