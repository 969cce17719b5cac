"""A run-length index: the run-compressed Burrows-Wheeler transform of a block of strings with the suffix array sampled at run ends.

For a run's first suffix p the sample of the run before gives phi(p), the suffix just before p in order, and the two have some
common length. Inside a run both go on as the text does: phi(p + 1) = phi(p) + 1, and the common length falls by one. So the
samples, as many as there are runs, give every suffix its neighbour and common length, streamed by text position.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class RunIndex:
    """heads: text positions of the runs' first suffixes, ascending; ends: phi of each (the sampled end of the run before, -1 for the first of all); common: their common lengths."""

    size: int
    symbols: np.ndarray
    lengths: np.ndarray
    heads: np.ndarray
    ends: np.ndarray
    common: np.ndarray

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text position the neighbour phi (-1: none) and the common length with it."""
        sampled = np.zeros(self.size, np.int64)
        sampled[self.heads] = np.arange(len(self.heads))
        at = np.maximum.accumulate(sampled)
        gone = np.arange(self.size) - self.heads[at]
        phi = np.where(self.ends[at] < 0, -1, self.ends[at] + gone)
        return phi, np.maximum(0, self.common[at] - gone)


def codes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The strings one after another, bytes from 1 up, a 0 after each; where each begins."""
    sizes = np.array([len(s) + 1 for s in strings], np.int64)
    starts = np.cumsum(sizes) - sizes
    out = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    out[starts + sizes - 1] = 0
    return out, starts


def build(text: np.ndarray) -> RunIndex:
    """The index of codes from 0 to 256. The suffix array is made by doubling from 7 codes, and not kept."""
    n, width = len(text), 7
    padded = np.append(text, np.zeros(width, np.int64))
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = (key << 9) | padded[j : j + n]
    levels: list[tuple[int, np.ndarray]] = []
    while True:
        order = np.argsort(key)
        fresh = np.append(True, key[order][1:] != key[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        levels.append((width, rank))
        if fresh.all() or width > n:
            break
        key = rank * (n + 1)
        key[: n - width] += rank[width:]
        width *= 2
    before = text[order - 1]  # the first suffix has the text's last code before it
    head = np.append(True, before[1:] != before[:-1])
    # The text's first suffix begins a run too: what stands before it does not continue there.
    first = int(np.flatnonzero(order == 0)[0])
    head[first] = True
    if first + 1 < n:
        head[first + 1] = True
    at = np.flatnonzero(head)
    p, q = order[at], np.where(at > 0, order[at - 1], -1)
    common = _common(levels, text, p, q)
    by_place = np.argsort(p)
    return RunIndex(n, before[at], np.diff(np.append(at, n)), p[by_place], q[by_place], common[by_place])


def _common(levels: list[tuple[int, np.ndarray]], text: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Common lengths of suffix pairs, from the ranks that doubling has left."""
    n = len(text)
    out = np.zeros(len(p), np.int64)
    live = q >= 0
    for width, rank in reversed(levels):
        a, b = p + out, q + out
        fits = live & (a + width <= n) & (b + width <= n)
        same = np.zeros(len(p), bool)
        same[fits] = rank[a[fits]] == rank[b[fits]]
        out += np.where(same, width, 0)
    for _ in range(levels[0][0]):
        a, b = p + out, q + out
        fits = live & (a < n) & (b < n)
        same = np.zeros(len(p), bool)
        same[fits] = text[a[fits]] == text[b[fits]]
        live &= same
        out += same
    return out


def repeated(strings: list[bytes], length: int, places: np.ndarray | None = None) -> np.ndarray:
    """Of each position of codes(strings), whether a string of so many bytes begins there that also begins earlier, neither running over its string's end.

    Earlier is by places, one a position, if given; equal places are not earlier than each other.
    """
    text, starts = codes(strings)
    phi, common = build(text).statistics()
    n = len(text)
    room = np.repeat(starts + [len(s) for s in strings], np.diff(np.append(starts, n))) - np.arange(n)
    linked = (room >= length) & (common >= length)
    # Suffixes that share so many codes are neighbours in a row; each row's first one stands for it.
    root = np.where(linked, phi, np.arange(n))
    while True:
        further = root[root]
        if (further == root).all():
            break
        root = further
    places = np.arange(n) if places is None else places
    least = places.copy()
    np.minimum.at(least, root, places)
    return (room >= length) & (least[root] < places)
