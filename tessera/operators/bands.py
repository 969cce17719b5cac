"""Stencils over sensor rows, a band of rows at a time.

A row goes to its band and, near the edge, to the next one's: one shuffle, in which a row is repeated for a halo's share of a
band. A kernel sees the band as an array, with the halo around it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import frames

#: Rows of a band: a task's memory, whatever a frame's height. Even, as a halo is: bands begin in the phase of row 0.
BAND = 64
#: In place of the samples of rows that a frame lacks: over any sample, so that it sorts last and is clipped.
ABSENT = 1 << 60


def by_band(rows: DataFrame, kernel: Callable[[np.ndarray, dict, np.ndarray], pd.DataFrame], schema: str, height: int, halo: int, columns: tuple = ("raw",)) -> DataFrame:
    """m and what kernel gives for each band: it takes the numbers of its rows, their arrays by column, and which are its own.

    A kernel gets every row of its band and halo up to height. Those that the frame lacks (or that hold null) are ABSENT, and not its own.
    """
    first, last = F.greatest(F.lit(0), F.expr(f"(y - {halo}) div {BAND}")), F.least(F.lit((height - 1) // BAND), F.expr(f"(y + {halo}) div {BAND}"))
    dealt = rows.dropna(subset=list(columns)).select("m", "y", *columns, F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("band"))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        y = part["y"].to_numpy()
        if not (y // BAND == key[1]).any():  # a halo's rows alone
            return pd.DataFrame(columns=["m", *(c.split()[0] for c in schema.split(","))], dtype=object)
        lines = np.arange(max(0, BAND * key[1] - halo), max(min(height, BAND * (key[1] + 1) + halo), y.max() + 1))
        arrays, own = {}, np.zeros(len(lines), bool)
        for c in columns:
            there = np.stack(part[c].to_numpy())
            arrays[c] = np.full((len(lines), there.shape[1]), ABSENT)
            arrays[c][y - lines[0]] = there
        own[y - lines[0]] = y // BAND == key[1]
        out = kernel(lines, arrays, own)
        out.insert(0, "m", key[0])
        return out

    return dealt.groupBy("m", "band").applyInPandas(run, f"m int, {schema}")


def reflected(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places mirrored at the ends, which are not repeated, till they lie within."""
    at = np.where(size <= 1, 0, at)
    while ((at < 0) | (at >= size)).any():
        at = np.where(at < 0, -at, np.where(at >= size, 2 * size - 2 - at, at))
    return at


def predictions(raw: np.ndarray, top: int, height: int, y: np.ndarray, x: np.ndarray, kernel: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Upper median and upper median deviation of the kernel x kernel samples of the phase around y, x; raw begins at row top.

    Absent samples count as the largest; where they are the median, it is ABSENT.
    """
    width, r, near = raw.shape[1], kernel // 2, []
    for dy in range(-r, r + 1):
        own_y = y % step + step * reflected(y // step + dy, -(-(height - y % step) // step))
        for dx in range(-r, r + 1):
            near.append(raw[own_y - top, x % step + step * reflected(x // step + dx, -(-(width - x % step) // step))])
    near = np.sort(np.array(near).reshape(kernel * kernel, -1), axis=0)
    middle = near[len(near) // 2]
    return middle, np.sort(np.abs(near - middle), axis=0)[len(near) // 2]


CORRECTED = "y int, samples array<int>, candidates int, corrected int, positive int, negative int, forced int, total_delta long, max_delta long, sum_pred long, sum_mad long"


def corrected(rows: DataFrame, height: int, kernel: int = 5, mono: bool = False, adaptive: bool = True, sigma: float = 6.0, absolute: int = 4, least: int = 16, samples: str = "raw", forced: str | None = None) -> DataFrame:
    """m, y, samples with defects replaced by their neighbours' median, and counts and sums of each row.

    Candidates are of severity least or more (255 always). One is replaced if it is forced, if not adaptive, or if it exceeds
    the median by sigma deviations (one code at least) and by the absolute codes; at 255 also if it is as far below. Decisions
    are on the samples as they came. Where a frame lacks so many rows that there is no median, only forced candidates (all, if not
    adaptive) are replaced, by null, and sums leave them out (null, where a row has no other).
    """
    if kernel not in (3, 5, 7) or sigma < 0 or absolute < 0:
        raise ValueError("a kernel of 3, 5 or 7 and thresholds that are not negative")
    step = 1 if mono else 2

    def run(y: np.ndarray, a: dict, own: np.ndarray) -> pd.DataFrame:
        raw, sev = a[samples], a["sev"]
        hit = (sev >= least) | (sev == 255)
        hit[~own] = False
        at, x = np.nonzero(hit)
        value, severity = raw[at, x], sev[at, x]
        pred, mad = predictions(raw, int(y[0]), height, y[at], x, kernel, step)
        known = pred < ABSENT
        delta = np.where(known, value - pred, 0)
        must = a[forced][at, x] > 0 if forced else np.zeros(len(at), bool)
        gone = must | known & (np.where(severity == 255, np.abs(delta), delta) > np.maximum(sigma * np.maximum(mad, 1), absolute)) if adaptive else np.ones(len(at), bool)
        out = raw.copy()
        out[at[gone], x[gone]] = pred[gone]
        total = lambda w, where=None: np.bincount(at if where is None else at[where], w if where is None else w[where], len(y)).astype(np.int64)[own]
        lines = list(out[own].astype(np.int32))
        if (gone & ~known).any():
            lines = [[None if v == ABSENT else v for v in line] for line in out[own].tolist()]
        one, most = np.ones(len(at)), np.zeros(len(y), np.int64)
        over_known = lambda w: pd.arrays.IntegerArray(total(w, known), total(one, known) < np.minimum(total(one), 1))
        np.maximum.at(most, at[gone], np.abs(delta)[gone])
        return pd.DataFrame(
            {
                "y": y[own], "samples": lines, "candidates": total(one), "corrected": total(one, gone), "positive": total(one, gone & (delta > 0)),
                "negative": total(one, gone & (delta < 0)), "forced": total(one, gone & must), "total_delta": total(np.abs(delta), gone), "max_delta": most[own], "sum_pred": over_known(pred), "sum_mad": over_known(mad),
            }
        )

    columns = (samples, "sev", *([forced] if forced else []))
    return by_band(rows, run, CORRECTED, height, halo=step * (kernel // 2) + step * (kernel // 2) % 2, columns=columns)


def demosaiced(rows: DataFrame, height: int, pattern: str = "RGGB") -> DataFrame:
    """m, y, and the three channels as arrays: samples themselves, or the rounded mean of the 3 x 3 neighbours of the colour that exist."""

    def run(y: np.ndarray, a: dict, own: np.ndarray) -> pd.DataFrame:
        planes = frames.simple(a["raw"], pattern, a["raw"] != ABSENT)[own].astype(np.int32)
        return pd.DataFrame({"y": y[own], **{c: list(planes[..., k]) for k, c in enumerate(("red", "green", "blue"))}})

    return by_band(rows, run, "y int, red array<int>, green array<int>, blue array<int>", height, halo=2)
