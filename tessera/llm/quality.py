"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by their class log-count ratios, and a linear hinge-loss model over them is fitted by dual
coordinate descent. n-grams are of words and of word shapes (case, digits, marks, and whether a token repeats the one before).
The model is fitted on a bounded sample of labelled rows (MOST_LABELLED, drawn by a hash of the id); every row is scored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.vectors import drawn

FEATURES = 1 << 18
MOST_LABELLED = 6000
HELD_OUT = 5
#: predicted is 1 from this score on; calibration puts the model's own boundary there.
THRESHOLD = 0.3
_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Characters that are made into features together; bounds the memory of a task.
CHUNK = 2_000_000


def held_out(key):
    """Whether crc32 of an id as text leaves 0 by HELD_OUT; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most so many rows of labels that are not held out, drawn by a hash of the id.

    The draw has a fixed bound, so it is broadcast, and only drawn documents are shuffled. Of an id with several labels the least
    holds, of one with several texts that of the least hash: so what comes to the driver has the bound too, however often an id
    is repeated.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"))
    )
    found = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(drawn(known, "doc_id", most)), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("label").alias("label"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shape(token: str) -> str:
    if not token[0].isalnum():
        return token[:3]
    if token.isdigit():
        return "0"
    kind = "A" if token.isupper() else "a" if token.islower() else "C" if token[0].isupper() and token[1:].islower() else "x"
    return kind + str(min(len(token) // 4, 4))


def features(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct n-grams of each text, as hashes below FEATURES: 1 and 2 words, 1 to 3 shapes."""
    tokens = [_TOKEN.findall(t or "") for t in texts]
    sizes = np.array([len(x) for x in tokens])
    out = [np.zeros(0, np.int64)] * len(texts)
    if not sizes.sum():
        return out
    words: dict[str, int] = {}
    codes = np.fromiter((words.setdefault(w, len(words)) for x in tokens for w in x), np.int64, sizes.sum())
    word = np.array([zlib.crc32(w.lower().encode()) for w in words], np.uint64)
    shape = np.array([zlib.crc32(_shape(w).encode()) for w in words], np.uint64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    w, repeats = word[codes], np.zeros(len(codes), np.uint64)
    repeats[1:] = w[1:] == w[:-1]
    s = shape[codes] * np.uint64(2) + repeats
    found = [(doc, _mix(w + np.uint64(1 << 40))), (doc, _mix(s + np.uint64(2 << 40)))]
    for lag in (1, 2):
        same = doc[lag:] == doc[:-lag]
        if lag == 1:
            found.append((doc[lag:][same], _mix(_mix(w[:-lag]) * np.uint64(3) + w[lag:])[same]))
            found.append((doc[lag:][same], _mix(_mix(s[:-lag]) * np.uint64(5) + s[lag:])[same]))
        else:
            found.append((doc[lag:][same], _mix(_mix(_mix(s[:-2]) * np.uint64(7) + s[1:-1]) * np.uint64(7) + s[2:])[same]))
    keys = np.unique(np.concatenate([d * FEATURES + (h % np.uint64(FEATURES)).astype(np.int64) for d, h in found]))
    bounds = np.searchsorted(keys, np.arange(len(texts) + 1) * FEATURES)
    return [keys[a:b] - i * FEATURES for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


def chunks(texts, most: int = CHUNK) -> Iterator[slice]:
    """Slices of texts of so many characters at most, a longer text by itself."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and size + n > most:
            yield slice(start, i)
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield slice(start, len(texts))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def score(self, own: np.ndarray) -> float:
        margin = (self.weights[own].sum() / max(1.0, len(own)) ** 0.5) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))


def fit(rows: list[np.ndarray], y: np.ndarray, passes: int = 20, cost: float = 1.0, smooth: float = 1.0) -> Model:
    """Log-count ratios, then dual coordinate descent of the L2 hinge loss on length-normalised, scaled indicators.

    With no rows, or one class only, every text gets that class's share.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    flat = Model(np.zeros(FEATURES, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return flat
    counts = np.full((2, FEATURES), smooth)
    for own, label in zip(rows, y, strict=True):
        counts[label, own] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    scaled = [(ratio[own] / max(1.0, len(own)) ** 0.5) for own in rows]
    sign, w, bias = np.where(y == 1, 1.0, -1.0), np.zeros(FEATURES), 0.0
    # The rarer class weighs as much as the other; a squared hinge adds 1 / (2 cost) to the diagonal.
    soft = np.where(y == 1, 0.5 * len(y) / y.sum(), 0.5 * len(y) / (len(y) - y.sum())) * cost
    alpha, diagonal = np.zeros(len(y)), np.array([v @ v for v in scaled]) + 1 + 1 / (2 * soft)
    draw = np.random.default_rng(7)
    for _ in range(passes):
        for i in draw.permutation(len(y)):
            gradient = sign[i] * (w[rows[i]] @ scaled[i] + bias) - 1 + alpha[i] / (2 * soft[i])
            new = max(0.0, alpha[i] - gradient / diagonal[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * scaled[i]
                bias += step
                alpha[i] = new
    # The boundary is put at THRESHOLD, and a margin of 1 at 0.9.
    offset = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    return Model((w * ratio).astype(np.float32), float(bias), float(np.log(9) - offset), offset)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_LABELLED) -> Model:
    """The model of at most so many labelled rows that are not held out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for s in chunks(part["text"]):
                own = part.iloc[s]
                yield pd.DataFrame({"doc_id": own["doc_id"], "label": own["label"], "own": [x.astype("<i4").tobytes() for x in features(own["text"].tolist())]})

    got = labelled(docs, labels, label, most).mapInPandas(run, "doc_id long, label int, own binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.own)))
    return fit([np.frombuffer(r.own, "<i4").astype(np.int64) for r in got], np.array([r.label for r in got], int))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, for every row of docs, by whole texts and with no shuffle.

    A null text is empty; an empty text has no n-grams and gets the score of the bias; a text of any length is scored whole, and
    a very long one by itself; repeated rows are scored as they come and equal texts alike, so ties are no question; a row with a
    null id is scored too; no rows give no rows; further columns, of whatever names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for s in chunks(part["text"]):
                own = part.iloc[s]
                score = [shared.value.score(x) for x in features(own["text"].tolist())]
                yield pd.DataFrame({"doc_id": own["doc_id"], "held_out": own["held_out"], "score": score, "predicted": [int(x >= THRESHOLD) for x in score]})

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), held_out(docs[id_col]).alias("held_out")).mapInPandas(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )
