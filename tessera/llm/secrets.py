"""Secret scans: fixed patterns, and a sliding window of Shannon entropy over candidate strings.

The window's entropy is kept by incremental counts: sum(c * log2 c) changes by two table entries as it moves one character.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds, in their order.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # as AKIA[A-Z0-9]+ of 20 characters or more: runs are taken whole
HEX = re.compile(r"[0-9a-f]{24,}")  # as [0-9a-f]+ of 24 characters or more: runs are taken whole
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits per character that a window must reach, by the class of the characters in it (a window of 20 has 4.32 at most).
LEAST_BITS = {"hex": 3.0, "lower": 3.45, "alnum": 3.8, "base64": 3.9}
#: Runs of letters up to so many pass for words; longer ones are judged by their vowels and consonants.
SHORT_WORD, MOST_CONSONANTS, LEAST_VOWELS = 12, 6, 0.25
#: Candidates of these forms are no secrets: unique ids, dates and numbers, paths and words joined by marks.
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    r"|[0-9+/_=-]+"
    r"|[+/_=-]*+(?:(?:[A-Za-z][a-z]*|[A-Z]{2,}|[0-9]{1,4})(?:[+/_=-]++|\Z))*+"  # every token in one way, and none taken back: linear
)
_CONSONANTS = re.compile(r"[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]+")
_LETTERS = re.compile(r"[A-Za-z]+")
_LOG = [0.0] + [c * __import__("math").log2(c) for c in range(1, WINDOW + 2)]  # a character comes before the oldest goes


def _class(window: str) -> str:
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", window):
        return "hex"
    if window.isalpha() and (window.islower() or window.isupper()):
        return "lower"
    return "alnum" if window.isalnum() else "base64"


def _like_word(letters: str) -> bool:
    """Whether a run of letters may be a word: short, or with vowels often enough and no long row of consonants (y is neither)."""
    if len(letters) <= SHORT_WORD:
        return True
    rows = _CONSONANTS.findall(letters)
    return max(map(len, rows), default=0) <= MOST_CONSONANTS and len(letters) - sum(map(len, rows)) >= LEAST_VOWELS * len(letters)


def allowed(run: str) -> bool:
    """Whether the allow-list takes the candidate: a form of ALLOWED, whose longer runs of letters are like words."""
    return ALLOWED.fullmatch(run) is not None and all(map(_like_word, _LETTERS.findall(run)))


def entropy_spans(text: str) -> list[tuple[int, int]]:
    """Maximal unions of windows that reach their class's entropy, in candidates that the allow-list does not suppress."""
    out: list[tuple[int, int]] = []
    top = 4.33 * WINDOW
    for m in CANDIDATE.finditer(text):
        run, base = m[0], m.start()
        if allowed(run):
            continue
        counts: dict[str, int] = {}
        weighed, begin, end = 0.0, -1, -1
        for i, c in enumerate(run):
            n = counts.get(c, 0)
            weighed += _LOG[n + 1] - _LOG[n]
            counts[c] = n + 1
            if i >= WINDOW:
                old = run[i - WINDOW]
                n = counts[old]
                weighed += _LOG[n - 1] - _LOG[n]
                counts[old] = n - 1
            if i < WINDOW - 1:
                continue
            bits = _LOG[WINDOW] / WINDOW - weighed / WINDOW
            first = i - WINDOW + 1
            if bits >= 3.0 and bits <= top and bits >= LEAST_BITS[_class(run[first : i + 1])]:
                if begin >= 0 and first <= end:
                    end = i + 1
                else:
                    if begin >= 0:
                        out.append((base + begin, base + end))
                    begin, end = first, i + 1
        if begin >= 0:
            out.append((base + begin, base + end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, in code points."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all: those of the entropy scan that no base span holds are added."""
    base, more, at, reach = base_spans(text), [], 0, -1
    for a, b in entropy_spans(text):  # both are in order: one sweep
        while at < len(base) and base[at][0] <= a:
            reach = max(reach, base[at][2])
            at += 1
        if b > reach:
            more.append((a, 3, b))
    return base, sorted(base + more)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """text with the union of all spans replaced, each maximal run by one mark."""
    out, at = [], 0
    runs: list[list[int]] = []
    for s, _, e in all_spans(text)[1]:
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e])
    for s, e in runs:
        out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def _told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for text in part["text"]:
            base, found = all_spans(text or "")
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*n, hashlib.sha256(_told(base).encode()).hexdigest(), _told(found)))
        yield pd.concat([part[["doc_id"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])], axis=1)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, for every row of docs, by whole texts and with no shuffle.

    A null text is empty; a text of any length is scanned whole, in time that grows with its length; repeated rows are scanned as
    they come, so ties cannot arise; rows with a null id are scanned like others; no rows give no rows; further columns, of
    whatever names, are ignored.
    """
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInPandas(
        _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every span in text replaced by a mark, and n_chars, if there, made to fit.

    Null texts stay null, empty ones empty; texts of any length are redacted whole; rows, repeated ones too, all stay; no rows
    give no rows; other columns pass as they are.
    """
    own = F.pandas_udf(lambda texts: texts.map(lambda t: t if t is None else redact(t)), "string")
    out = docs.withColumn("text", own(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
