"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy, over character and word inputs.

A word's input is the mean of its character n-grams' vectors beside a vector of its own. Windows of WINDOW words that overlap
by half go through the network (a word of over LONG letters counts as its overlapping pieces); attention pools each, and a
document scores as its highest window. Training sees only
documents' labels: each pass picks every document's highest window and learns from it. The network is fitted on a bounded
sample of labelled rows (MOST_LABELLED of up to MOST_CHARS characters, drawn by a hash of the id); every row is scored, whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import gather
from tessera.llm.quality import chunks, held_out, labelled

WINDOW, STEP = 32, 16
BUCKETS = 1 << 15
EACH = 8  # width of either input, and of the state of either direction
MOST_LABELLED = 3000
MOST_CHARS = 32_000
#: Documents of a step, and steps of a fit; the passes over the sample follow from them.
STEP_DOCS, STEPS = 64, 300
#: Windows that go through the network together.
BATCH = 4096
#: Letters from which on a word is cut into pieces of PIECE letters that overlap by half.
LONG, PIECE = 48, 32
_WORD = re.compile(r"\w+")


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its own bucket, and of each byte of <word> the buckets of the 3- to 5-grams from there (BUCKETS: none), with the words' starts."""
    raw = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    own = np.array([zlib.crc32(w) % BUCKETS for w in raw], np.int64)
    sizes = np.array([len(w) for w in raw])
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(raw) + b"\0" * 4, np.uint8).astype(np.uint64)
    n = len(data) - 4
    left = np.repeat(starts + sizes, sizes) - np.arange(n)
    grams = np.full((3, n), BUCKETS, np.int64)
    code = data[:n]
    for k in range(1, 5):
        code = code * np.uint64(0x9E3779B97F4A7C15) + data[k : k + n] + np.uint64(k)
        if k >= 2:
            grams[k - 2] = np.where(left > k, ((code ^ (code >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49)).astype(np.int64), BUCKETS)
    return own, grams, starts


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Vectors of characters' and words' buckets (the last row, for none, is 0) and the weights of both directions."""

    chars: np.ndarray
    words: np.ndarray
    into: np.ndarray  # 2 x (2 EACH + 1) x 3 EACH; the last row is the bias
    back: np.ndarray  # 2 x EACH x 3 EACH
    look: np.ndarray  # 2 EACH, attention
    out: np.ndarray  # 2 EACH + 1, the last the bias
    shift: float = 0.0

    def inputs(self, words: list[str]) -> np.ndarray:
        own, grams, starts = word_inputs(words)
        known = grams < BUCKETS
        summed = np.add.reduceat(sum(self.chars[g] for g in grams), starts, axis=0)
        n = np.maximum(1, np.add.reduceat(known.sum(0), starts))
        return np.concatenate([summed / n[:, None], self.words[own]], axis=1).astype(np.float32)

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        """The inputs' part of both directions' gates."""
        return [x @ w[:-1] + w[-1] for w in self.into]

    def run(self, gates: list[np.ndarray], index: np.ndarray, mask: np.ndarray, cache: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, attention and states of windows of words, given by their rows in gates."""
        n, width = index.shape
        states = np.empty((width, n, 2 * EACH), np.float32)
        for d in range(2):
            h = np.zeros((n, EACH), np.float32)
            for t in range(width) if d == 0 else range(width - 1, -1, -1):
                x, m = gates[d][index[:, t]], mask[:, t : t + 1]
                u = h @ self.back[d]
                zr = 1 / (1 + np.exp(-(x[:, : 2 * EACH] + u[:, : 2 * EACH])))
                z, r = zr[:, :EACH], zr[:, EACH:]
                c = 2 / (1 + np.exp(-2 * (x[:, 2 * EACH :] + r * u[:, 2 * EACH :]))) - 1
                new = m * (c + z * (h - c))
                if cache is not None:
                    cache.append((d, t, h, z, r, c, u[:, 2 * EACH :], m))
                h = new
                states[t, :, d * EACH : (d + 1) * EACH] = h
        e = (states @ self.look).T + np.where(mask > 0, 0, -1e9).astype(np.float32)
        a = np.exp(e - e.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,tnk->nk", a, states)
        return pooled @ self.out[:-1] + self.out[-1], a, states

    def best(self, gates: list[np.ndarray], codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each document's highest logit and the start of that window. Without words: minus infinity."""
        ends = np.cumsum(sizes)
        doc, start = windows(sizes)
        top, at = np.full(len(sizes), -np.inf), np.zeros(len(sizes), np.int64)
        for i in range(0, len(doc), BATCH):
            index, mask = spread(codes, start[i : i + BATCH], ends[doc[i : i + BATCH]])
            logit = self.run(gates, index, mask)[0]
            order = np.lexsort((-start[i : i + BATCH], logit, doc[i : i + BATCH]))
            last = order[np.append(np.flatnonzero(np.diff(doc[i : i + BATCH][order])), len(order) - 1)]
            d = doc[i : i + BATCH][last]
            better = logit[last] > top[d]
            top[d[better]], at[d[better]] = logit[last][better], start[i : i + BATCH][last][better]
        return top, at

    def scores(self, texts: list[str | None]) -> list[float]:
        codes, sizes, words = coded(texts)
        if not words:
            return [0.0] * len(texts)
        top, _ = self.best(self.gates(self.inputs(words)), codes, sizes)
        return sigmoid(np.where(np.isneginf(top), -30, top - self.shift)).astype(float).tolist()


def coded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The texts' words as numbers, one text after another; how many each has; the distinct words."""
    known: dict[str, int] = {}
    parts = []
    for t in texts:
        found = _WORD.findall((t or "").lower())
        if any(len(w) > LONG for w in found):
            found = [p for w in found for p in ([w] if len(w) <= LONG else [w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)])]
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in found), np.int64, len(found)))
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.array([len(x) for x in parts], np.int64), list(known)


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of every window: each STEP words, till one reaches the document's end."""
    each = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STEP)), 0)
    doc = np.repeat(np.arange(len(sizes)), each)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    return doc, (np.cumsum(sizes) - sizes)[doc] + STEP * nth


def spread(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = start[:, None] + np.arange(WINDOW)
    mask = place < end[:, None]
    return codes[np.where(mask, place, start[:, None])], mask.astype(np.float32)


def leaning(rows: Iterable[np.ndarray], y: np.ndarray) -> np.ndarray:
    """How far each bucket leans to label 1, between -1 and 1: the surplus of documents that have it over what chance gives, in deviations."""
    counts = np.zeros((2, BUCKETS + 1))
    for own, label in zip(rows, y, strict=True):
        counts[label, own] += 1
    expected = counts.sum(0) * y.mean()
    return np.clip((counts[1] - expected) / np.sqrt(expected + 2) / 4, -1, 1)


def fit(texts: list[str], y: np.ndarray, steps: int = STEPS, seed: int = 11) -> Network:
    """A network for these texts and labels.

    With no texts that hold words, or one label only among those that do, every text with words scores that label's share. Texts
    without words teach nothing and score 0.
    """
    draw = np.random.default_rng(seed)
    f = np.float32
    net = Network(
        chars=(draw.normal(size=(BUCKETS + 1, EACH)) * 0.02).astype(f),
        words=(draw.normal(size=(BUCKETS + 1, EACH)) * 0.02).astype(f),
        into=(draw.normal(size=(2, 2 * EACH + 1, 3 * EACH)) * 0.4).astype(f),
        back=(draw.normal(size=(2, EACH, 3 * EACH)) * 0.25).astype(f),
        look=(draw.normal(size=2 * EACH) * 0.3).astype(f),
        out=(draw.normal(size=2 * EACH + 1) * 0.3).astype(f),
    )
    net.chars[-1] = net.words[-1] = net.out[-1] = 0
    y = np.asarray(y, int)
    worded = np.array([_WORD.search(t or "") is not None for t in texts], bool)
    if not worded.any() or y[worded].min() == y[worded].max():
        y = y[worded] if worded.any() else y
        net.out[:] = 0
        share = (y.sum() + 0.5) / (len(y) + 1)
        net.out[-1] = np.log(share / (1 - share))
        return net
    codes, sizes, words = coded(texts)
    own, grams, starts = word_inputs(words)
    ends = np.append(starts[1:], grams.shape[1])
    bounds = np.append(0, np.cumsum(sizes))
    mine = [np.unique(codes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    net.words[:, 0] = 2 * leaning((np.unique(own[m]) for m in mine), y)
    none = np.zeros(0, np.int64)
    net.chars[:, 0] = 4 * leaning((np.unique(grams[:, gather(starts[m], ends[m] - starts[m])]) if len(m) else none for m in mine), y)
    net.chars[-1] = net.words[-1] = 0
    weight = np.where(y == 1, 0.5 * len(y) / y.sum(), 0.5 * len(y) / (len(y) - y.sum()))
    own_sums = [{k: np.zeros_like(getattr(net, k), np.float64) for k in ("into", "back", "look", "out")} for _ in range(2)]
    done = 0
    there = np.flatnonzero(sizes > 0)
    parts = max(1, len(there) // STEP_DOCS)
    passes = -(-steps // parts)
    for n_pass in range(passes):
        x = net.inputs(words)
        _, at = net.best(net.gates(x), codes, sizes)
        for batch in np.array_split(draw.permutation(there), parts):
            index, mask = spread(codes, at[batch], bounds[1:][batch])
            grads, dx = gradients(net, x, index, mask, y[batch], weight[batch])
            done += 1
            for k, g in grads.items():
                first, second = own_sums[0][k], own_sums[1][k]
                first += 0.1 * (g - first)
                second += 0.01 * (g * g - second)
                rate = 0.02 * (1 - 0.8 * n_pass / passes)
                getattr(net, k)[...] -= (rate * (first / (1 - 0.9**done)) / (np.sqrt(second / (1 - 0.99**done)) + 1e-6)).astype(f)
            used, inverse = np.unique(index, return_inverse=True)
            each = np.zeros((len(used), 2 * EACH), f)
            np.add.at(each, inverse.ravel(), (dx * mask[..., None]).reshape(-1, 2 * EACH))
            np.subtract.at(net.words, own[used], 0.3 * each[:, EACH:])
            of = gather(starts[used], ends[used] - starts[used])
            word = np.repeat(np.arange(len(used)), ends[used] - starts[used])
            each[:, :EACH] /= np.maximum(1, np.bincount(word, (grams[:, of] < BUCKETS).sum(0), len(used)))[:, None]
            for g in grams[:, of]:
                np.subtract.at(net.chars, g, 0.3 * each[word, :EACH])
            net.chars[-1] = 0
    top, _ = net.best(net.gates(net.inputs(words)), codes, sizes)
    net.shift = cut(top[there], y[there])
    return net


def cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The logit that parts the labels best, both weighing alike; the middle of the gap that is there."""
    order = np.argsort(logit, kind="stable")
    s, label = logit[order], y[order]
    right = np.append(0, np.cumsum(label == 0)) / max(1, (label == 0).sum()) + np.append(np.cumsum((label == 1)[::-1])[::-1], 0) / max(1, (label == 1).sum())
    i = int(np.argmax(right))
    return float(s[-1] if i == len(s) else s[0] if i == 0 else (s[i - 1] + s[i]) / 2)


def gradients(net: Network, x: np.ndarray, index: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Of the mean weighted log loss of windows: by the weights, and by each window's inputs."""
    cache: list = []
    logit, a, states = net.run(net.gates(x), index, mask, cache)
    n, width = index.shape
    dl = (weight * (sigmoid(logit) - y) / n).astype(np.float32)
    pooled = np.einsum("nt,tnk->nk", a, states)
    grads = {"out": np.append(dl @ pooled, dl.sum())}
    dp = dl[:, None] * net.out[:-1]
    da = np.einsum("nk,tnk->nt", dp, states)
    de = a * (da - (a * da).sum(axis=1, keepdims=True))
    grads["look"] = np.einsum("nt,tnk->k", de, states)
    ds = np.einsum("nt,nk->tnk", a, dp) + np.einsum("nt,k->tnk", de, net.look)
    grads["into"], grads["back"] = np.zeros_like(net.into), np.zeros_like(net.back)
    dx = np.zeros((n, width, 2 * EACH), np.float32)
    for d in range(2):
        dh = np.zeros((n, EACH), np.float32)
        for _, t, h, z, r, c, un, m in (s for s in reversed(cache) if s[0] == d):
            dh = (dh + ds[t, :, d * EACH : (d + 1) * EACH]) * m
            dc, dz = dh * (1 - z) * (1 - c * c), dh * (h - c) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            dg = np.concatenate([dz, dr, dc], axis=1)
            du = np.concatenate([dz, dr, dc * r], axis=1)
            xt = x[index[:, t]]
            grads["into"][d, :-1] += xt.T @ dg
            grads["into"][d, -1] += dg.sum(0)
            grads["back"][d] += h.T @ du
            dx[:, t] += dg @ net.into[d, :-1].T
            dh = dh * z + du @ net.back[d].T
    return grads, dx


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, most_chars: int = MOST_CHARS) -> Network:
    """The network of at most so many labelled rows, of so many characters at most, that are not held out."""
    got = labelled(docs.where(F.length("text") <= most_chars), labels, label, most).collect()
    got.sort(key=lambda r: (r.doc_id, r.text))
    return fit([r.text for r in got], np.array([r.label for r in got], int))


def score_toxicity(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, for every row of docs, by whole texts and with no shuffle.

    A null text is empty; a text without words scores 0; a text of any length is scored whole, and a very long one by itself;
    repeated rows are scored as they come, and of windows that tie the first holds, which changes no score; a row with a null id
    is scored too; no rows give no rows; further columns, of whatever names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for s in chunks(part["text"]):
                own = part.iloc[s]
                score = shared.value.scores(own["text"].tolist())
                yield pd.DataFrame({"doc_id": own["doc_id"], "held_out": own["held_out"], "score": score, "predicted": [int(x >= 0.5) for x in score]})

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), held_out(docs[id_col]).alias("held_out")).mapInPandas(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def without_toxic(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of docs whose text scores below 0.5; by rows, so with no shuffle and whatever their ids.

    Null and empty texts, and others without words, score 0 and stay; texts of any length are scored whole; repeated rows go or
    stay together; no rows give no rows; all columns pass as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def own(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([x for s in chunks(part) for x in shared.value.scores(part.iloc[s].tolist())], dtype="float64")

    return docs.where(F.pandas_udf(own, "double")(F.col("text")) < 0.5)
