"""Operators on texts against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from tessera.llm import bpe, minhash, packing, quality, repeats, rindex, secrets, sharding, skew, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, bucket int, id string, spans_ string, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, "x", "y", "z") for i, t in rows], SCHEMA)


def words(draw, n):
    return " ".join("".join(draw.choice("abcdé") for _ in range(draw.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    base, passage = words(draw, 120), words(draw, 40)
    near = base.split()
    near[60] = "changed"
    out = [(5, base), (3, base), (9, " ".join(near)), (1, None), (2, ""), (4, "   \n"), (6, "one two"), (7, "ONE  two"), (8, words(draw, 30) + " " + passage + " " + words(draw, 30))]
    out += [(10 + i, words(draw, 10) + passage + words(draw, i)) for i in range(6)]
    out += [(20, "ab " * 3000), (21, words(draw, 4000)), (22, "日本語 " * 80 + passage), (23, "x" * 500)]
    return out


def test_minhash(spark, rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    of = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    of[a] = min(of[a], of[b])
    got = {r.doc_id: r for r in minhash.near_duplicates(table(spark, rows), 4).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), of[i], of[i] == i) for i in sets}
    assert minhash.near_duplicates(table(spark, rows).limit(0), 4).count() == 0


def test_minhash_null_ids_and_repeated_rows(spark):
    got = minhash.near_duplicates(table(spark, [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f")]), 4).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=str) == sorted([(None, None, None), (2, 1, False), (2, 1, False), (1, 1, True)], key=str)


def test_bpe(spark, rows):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.vocabulary(path)
    got = {r.doc_id: r for r in bpe.digests(bpe.encode_documents(table(spark, rows), path), path).collect()}
    for i, t in rows:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.encode_documents(table(spark, rows).limit(0), path).count() == 0


def test_bpe_in_many_blocks(spark, rows, tmp_path, monkeypatch):
    """Blocks of few characters, buckets, forgotten words, null and repeated ids; a cut that differs the second time is no silent error."""
    monkeypatch.setattr(bpe, "BLOCK", 500)
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 400)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    enc, data = bpe.vocabulary(path), [*rows, rows[8], (None, "one two"), (None, None)]
    table(spark, data).write.parquet(f"{tmp_path}/docs")
    got = bpe.decode_documents(bpe.encode_documents(spark.read.parquet(f"{tmp_path}/docs"), path, buckets=3), path).collect()
    want = sorted(((i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in data), key=str)
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.data)) for r in got), key=str) == want
    import pandas as pd

    parts = pd.DataFrame({"part": 0, "doc_id": [1, 2], "text": ["a b c", "d e f"]})
    one = pd.concat(bpe._blocks(iter([parts]), 3))
    two = pd.concat(bpe._blocks(iter([parts.iloc[::-1]]), 3))
    ids = pd.concat(bpe._encoded(iter([two[two["bucket"] >= 0]]), path))
    with pytest.raises(ValueError):
        bpe._joined(pd.concat([one[one["bucket"] < 0], ids]), path)


def test_pretokens_cut_like_the_library():
    enc, find, draw = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), bpe.pattern().findall, random.Random(1)
    pool = " \t\n\r\x0b\x1c\x1f\x85\xa0 ​　aZé中½²Ⅷ٣_'sdtm!?́\U0001f642\x00"
    for _ in range(2000):
        t = "".join(draw.choice(pool) for _ in range(draw.randint(0, 12)))
        assert [i for w in find(t) for i in enc._core_bpe.encode_single_piece(w.encode())] == enc.encode_ordinary(t)


def best_fit(lengths, most, length=1024):
    """Bounded-space best-fit on plain lists: (bin, offset) of each length, and the bins that are open at the end."""
    fill, still, out = [], [], []
    for n in lengths:
        fits = [b for b in still if fill[b] + n <= length]
        if fits:
            own = max(fits, key=lambda b: fill[b])
        else:
            own = len(fill)
            fill.append(0)
        out.append((fill[own], n))
        before, fill[own] = fill[own], fill[own] + n
        if own in still:
            still.remove(own)
        if fill[own] < length:
            if len(still) == most:
                still.remove(max(still, key=lambda b: fill[b]))
            still.append(own)
    return out, sorted(fill), sorted(fill[b] for b in still)


def test_packing(spark, rows):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    data = [*rows, (99, "<|endoftext|> text"), (None, "no id"), (3, "again")]
    got = packing.pack_documents(table(spark, data).repartition(3), added=True).collect()
    want = sorted(([zlib.crc32(np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()), i] for i, t in data), key=str)
    for i, t in data:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        if i == 3:
            continue
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]] and sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine) and all(r.length == 1024 for r in mine[1:])
    assert {tuple(w) for w in want if w[1] == 3} == {(r.ids_crc32, 3) for r in got if r.doc_id == 3}
    for s in {r.sequence_id for r in got}:
        mine = sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset)
        assert [r.offset for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]] and sum(r.length for r in mine) <= 1024
    assert packing.pack_documents(table(spark, rows).limit(0)).count() == 0


def test_bins_like_brute_force():
    lengths = np.random.default_rng(2).integers(1, 1025, 3000).tolist()
    for most in (1, 4, 64, 2048):
        bins, out = packing.Bins(1024, most), []
        fill: dict[int, int] = {}
        for n in lengths:
            own, at = bins.place(n)
            assert fill.get(own, 0) == at and bins.open <= most and bin(bins.bits).count("1") <= most
            fill[own] = at + n
            out.append((at, n))
        want, filled, _ = best_fit(lengths, most)
        assert out == want and sorted(fill.values()) == filled and bins.made == len(filled)
        assert most > 4 or bins.closed and any(fill[b] < 1024 for b in bins.closed)


def test_packing_hands_on_what_stands_in_the_last_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN", 2)
    monkeypatch.setattr(packing, "BATCH", 3)
    data = [(i, "word " * (40 + 61 * (i % 13))) for i in range(60)]
    for parts in (1, 12):
        got = packing.pack_documents(table(spark, data).repartition(parts), most_open=4 if parts == 1 else 2048).collect()
        fill: dict[int, list] = {}
        for r in got:
            fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for places in fill.values():
            places.sort()
            assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 1024
        assert sorted((r.doc_id, r.piece) for r in got) == [(i, 0) for i in range(60)]
        if parts == 12:  # as few as one task would make, whatever number of tasks there were
            assert len(fill) <= -(-sum(r.length for r in got) // 1024) + 1


def test_secrets():
    text = 'Password = "abcdef12" token: ab, AKIA' + "A1" * 8 + " " + "0a" * 12 + " KKen secret=xyz"
    base, every = secrets.all_spans(text)
    assert [(k, text[s:e]) for s, k, e in base] == [(0, 'Password = "abcdef12'), (1, "AKIA" + "A1" * 8), (2, "0a" * 12)]
    assert set(base) <= set(every)
    noise = "q9Zr7Lk2Xw8Tb4Mn6Vc1Pd3"
    assert any(k == 3 for _, k, _ in secrets.all_spans(f"see {noise} there")[1])
    for calm in ("123e4567-e89b-12d3-a456-426614174000", "2024-01-02-2024-01-02", "some-words-joined-by-marks-here", "z" * 5000, "plainwordthatisverylongindeed"):
        assert secrets.all_spans(calm)[1] == []
    assert secrets.redact(f"a {noise} b") == "a [SECRET] b"


def test_secrets_query(spark, rows):
    got = {r.doc_id: r for r in secrets.scan_secrets(table(spark, [*rows, (50, "secret=abcdefg")])).collect()}
    assert got[50].n_assign == 1 and got[50].spans == "assign:0:14" and got[50].base_sha256 == hashlib.sha256(b"assign:0:14").hexdigest()
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and len(got) == len(rows) + 1
    kept = secrets.redact_secrets(table(spark, [(1, None), (2, "secret=abcdefg")]))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2] and {r.text for r in kept.collect()} == {None, "[SECRET]"}


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("many", [4096, 3, 1])
def test_repeats(spark, rows, many, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", many)  # at 3 most keys are split, at 1 all that differs goes by single strings
    monkeypatch.setattr(skew, "LEAST", 3 if many == 3 else 4096)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed(table(spark, rows)).collect()}
    assert got == brute_repeats(rows)
    cut = repeats.without_repeats(table(spark, rows))
    assert cut.columns == SCHEMA.replace(",", "").split()[::2] and cut.count() == len(rows)
    assert repeats.removed(table(spark, rows).limit(0)).count() == 0


def test_run_index():
    draw = random.Random(3)
    for _ in range(200):
        n, base = draw.choice([3, 5, 10]), bytes(draw.choice(b"ab") for _ in range(60))
        strings = [base[(i := draw.randint(0, 50)) : i + draw.randint(0, 40)] if draw.random() < 0.5 else bytes(draw.choice(b"ab\0") for _ in range(draw.randint(0, 20))) for _ in range(draw.randint(1, 12))]
        seen, want = set(), []
        for s in strings:
            for i in range(len(s) + 1):
                want.append(len(s[i : i + n]) == n and s[i : i + n] in seen)
                if len(s[i : i + n]) == n:
                    seen.add(s[i : i + n])
        assert rindex.repeated(strings, n).tolist() == want
    index = rindex.build(rindex.codes([b"abcabcabc" * 50])[0])
    assert len(index.heads) < 20 and index.lengths.sum() == index.size


def test_sharding(spark, rows, tmp_path):
    draw = random.Random(14)
    data = [*rows, *[(100 + i, "t" * (i % 37)) for i in range(3000)], *[(None, "x" * draw.randint(1, 40)) for _ in range(900)], *[(7777, "same")] * 900, (None, None), (100, "again")]
    maps = str(tmp_path / "maps")
    got = sharding.shard_documents(table(spark, data).repartition(5), maps=maps, together=100).collect()
    sizes, places = {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert len(places) == 24 and all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t in data)
    assert sorted((r.doc_id for r in got), key=str) == sorted((i for i, _ in data), key=str)
    # Two texts are larger than a shard's part; the other shards are near equal.
    rest = sorted(sizes.values())[:-2]
    assert max(rest) - min(rest) < 0.01 * sum(rest) / len(rest) + 50
    assert sharding.shard_documents(table(spark, rows).limit(0)).count() == 0
    one, two = (sharding.load_map(spark, maps, v) for v in (1, 2))
    assert sharding.load_map(spark, maps).agg({"version": "max"}).first()[0] == 2
    key = lambda m: {(r.vslot, r.part): r.shard for r in m.collect()}
    assert {k[0] for k in key(one)} == set(range(sharding.SLOTS)) and key(one).keys() == key(two).keys()
    grown = sharding.grown_map(two, 24)
    sharding.save_map(grown, maps)
    sharding.save_map(grown, maps)  # a retry
    old, new = key(two), key(sharding.load_map(spark, maps))
    assert old.keys() == new.keys() and any(s == 24 for s in new.values()) and all(new[k] in (old[k], 24) for k in old)
    assert sharding.load_map(spark, maps).count() == len(old)
    # A stored map takes records that were not there when it was made.
    stored = sharding.load_map(spark, maps)
    later = sharding.dealt(sharding.sized(table(spark, [(5000 + i, "y") for i in range(500)])), stored)
    assert sharding.placed(later, stored).count() == 500


def test_classifiers(spark):
    draw = random.Random(8)
    bad = [(i, words(draw, 40) + (" vilewort " if i % 3 == 0 else " ") + words(draw, 40)) for i in range(240)]
    docs = table(spark, [*bad, (900, None), (901, ""), (902, "vilewort"), (902, "vilewort")])
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 3 == 0)) for i in range(240)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for got in (toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect(), quality.score_quality(docs, quality.train(docs, labels)).collect()):
        assert len(got) == 244 and all(0 <= r.score <= 1 for r in got)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    toxic = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, toxicity.train(docs, labels)).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([toxic[i] == (i % 3 == 0) for i in held]) > 0.9
    good = {r.doc_id: r for r in quality.score_quality(docs, quality.train(docs, labels)).collect()}
    assert np.mean([good[i].predicted == (i % 3 != 0) for i in held]) > 0.9
    assert all(r.predicted == int(r.score >= 0.3) for r in good.values())
    none = labels.limit(0)
    assert toxicity.score_toxicity(docs, toxicity.train(docs, none)).count() == 244 and quality.score_quality(docs.limit(0), quality.train(docs, none)).count() == 0


def test_network_gradients():
    draw = np.random.default_rng(1)
    net = toxicity.fit(["a b c", "d e f"], np.array([0, 1]), steps=1)
    for k in ("into", "back", "look", "out"):
        setattr(net, k, draw.normal(size=getattr(net, k).shape).astype(np.float64) * 0.5)
    x, index, mask = draw.normal(size=(6, 16)), draw.integers(0, 6, (4, 5)), np.ones((4, 5))
    mask[0, 3:] = 0
    y, weight = np.array([0, 1, 1, 0]), np.ones(4)
    loss = lambda: float(np.mean(np.logaddexp(0, z := net.run(net.gates(x), index, mask)[0]) - y * z))
    grads, _ = toxicity.gradients(net, x, index, mask, y, weight)
    for k, g in grads.items():
        w = getattr(net, k)
        for place in [tuple(draw.integers(0, s) for s in w.shape) for _ in range(6)]:
            old = w[place]
            w[place] = old + 1e-2
            up = loss()
            w[place] = old - 1e-2
            down = loss()
            w[place] = old
            assert abs((up - down) / 2e-2 - g[place]) < 2e-3


@pytest.mark.parametrize("many", [4096, 3, 1])
def test_repeats_of_repeated_rows_and_ids(spark, rows, many, monkeypatch):
    monkeypatch.setattr(repeats, "MANY", many)
    draw = random.Random(12)
    passage, tail = words(draw, 60), words(draw, 60)
    once, other = words(draw, 50) + passage + words(draw, 20), words(draw, 50) + tail
    # The passage stands in three contexts, the first of them in a repeated row; id 51 has three texts, two of them alike at first.
    data = [*rows, rows[0], (50, once), (50, once), (60, words(draw, 9) + passage), (61, words(draw, 5) + passage + words(draw, 7))]
    data += [(51, other), (51, other + words(draw, 30)), (51, words(draw, 80)), (51, other), (40, words(draw, 8) + tail[:150]), (62, tail)]
    first = {}
    for i, t in data:
        raw = (t or "").encode()
        for p in range(len(raw) - 99):
            first[raw[p : p + 100]] = min(first.get(raw[p : p + 100], (i, p)), (i, p))
    want = []
    for i, t in data:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if first[raw[p : p + 100]] < (i, p):
                gone[p : p + 100] = b"\1" * 100
        want.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed(table(spark, data)).collect()]
    assert sorted(got) == sorted(want)
    assert [w[2] for w in want if w[0] == 50] == [0, 0] and {w[2] > 0 for w in want if w[0] == 51} == {True, False}


def test_allow_list_takes_long_runs_of_marks_in_linear_time():
    code = """
from tessera.llm import secrets
for text in ("=" * 16 + "Rev2", "-" * 3000 + "Rev2", "-=" * 40 + "Rev2" + "_" * 40 + "x9", "A-" * 40 + "Rev2", "ab-" * 2000 + "Rev2"):
    secrets.entropy_spans(text)
assert secrets.entropy_spans("-" * 40 + "q9Zr7Lk2Xw8Tb4Mn6Vc1Pd3") and not secrets.entropy_spans("--Some/WORDS_and-2024=x" + "-" * 40)
"""
    root = str(Path(secrets.__file__).resolve().parents[2])
    subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": f"{root}:{os.environ.get('PYTHONPATH', '')}"}, timeout=60, check=True)


def test_packing_gives_added_tokens_as_the_library_does(spark, tmp_path):
    from tokenizers import Tokenizer

    from tessera.llm import queries

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    data = [(1, "a <|endoftext|> text"), (2, "<|endoftext|><|endoftext|>"), (3, "x  <|endoftext|>\n\n y"), (4, "<|endoftext|"), (5, None), (6, "one  <|endoftext|>  " * 700)]
    table(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op6_packing(spark, str(tmp_path)).collect()
    for i, t in data:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in mine) == len(ids) and all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)


def plain_spans(text):
    """The contract's patterns, and windows of 20 whose entropy is summed up afresh each time."""
    base = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+))""", text, re.ASCII):
        base += [(m.start(), "assign", m.end())] if len(m[2]) >= 6 else []
    base += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    more = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        if len(m[0]) < 20 or secrets.allowed(m[0]):
            continue
        hot = set()
        for i in range(len(m[0]) - 19):
            w = m[0][i : i + 20]
            bits = -sum(w.count(c) / 20 * np.log2(w.count(c) / 20) for c in set(w))
            kind = "hex" if set(w) <= set("0123456789abcdef") or set(w) <= set("0123456789ABCDEF") else "lower" if w.isalpha() and w in (w.lower(), w.upper()) else "alnum" if w.isalnum() else "base64"
            hot |= set(range(m.start() + i, m.start() + i + 20)) if bits >= secrets.LEAST_BITS[kind] - 1e-9 else set()
        at = sorted(hot)
        first = [p for p in at if p - 1 not in hot]
        last = [p + 1 for p in at if p + 1 not in hot]
        more += [(s, "entropy", e) for s, e in zip(first, last, strict=True) if not any(a <= s and e <= b for a, _, b in base)]
    order = ["assign", "access", "hex", "entropy"]
    key = lambda x: (x[0], order.index(x[1]))
    tell = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=key))
    return tell(base), tell(base + more)


def test_secrets_like_brute_force():
    draw = random.Random(21)
    marks = ["password", "Token", "api_key", "APIKEY", "=", ":", '"', " ", "AKIA", "-", "_", "/", "\n", "é", "ſecret", "secret", ".", "==", "\u212a"]
    pools = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz", "abcABC019+/_=-", "ab"]
    for _ in range(500):
        t = "".join(draw.choice(marks) if draw.random() < 0.5 else "".join(draw.choice(draw.choice(pools)) for _ in range(draw.randint(1, 40))) for _ in range(draw.randint(0, 12)))
        base, every = secrets.all_spans(t)
        assert (secrets._told(base), secrets._told(every)) == plain_spans(t)


def test_secrets_take_keys_of_one_case_and_many_spans():
    draw = random.Random(22)
    for pool in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        found = sum(bool(secrets.all_spans("see " + "".join(draw.choice(pool) for _ in range(32)) + " there")[1]) for _ in range(200))
        assert found > 140
    for calm in ("internationalizationconference", "donaudampfschiffahrtsgesellschaft", "some-words-joined-by-marks-here-and-there"):
        assert secrets.all_spans(calm)[1] == []
    import time

    long = "password=abcdefg q9Zr7Lk2Xw8Tb4Mn6Vc1Pd3 " * 20_000 + "=" * 10_000 + "Section1Title"
    start = time.perf_counter()
    assert len(secrets.all_spans(long)[1]) == 40_000 and time.perf_counter() - start < 30


def test_secrets_of_an_empty_table(spark):
    assert secrets.scan_secrets(table(spark, []).limit(0)).count() == 0 and secrets.redact_secrets(table(spark, []).limit(0)).count() == 0


def test_network_like_loops():
    """Scores of a trained network against one written word by word."""
    draw = random.Random(9)
    texts = [words(draw, 50) + (" vilewort" if i % 2 else "") for i in range(40)]
    net = toxicity.fit(texts, np.arange(40) % 2, steps=20)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def word(w):
        raw = b"<" + w.encode() + b">"
        grams = [raw[i : i + k] for i in range(len(raw)) for k in (3, 4, 5) if i + k <= len(raw)]
        own, table_, starts = toxicity.word_inputs([w])
        got = table_[table_ < toxicity.BUCKETS]
        assert len(got) == len(grams)
        return np.concatenate([net.chars[got].astype(float).sum(0) / max(1, len(got)), net.words[own[0]].astype(float)])

    def window(ws):
        xs, states = [word(w) for w in ws], np.zeros((len(ws), 2 * toxicity.EACH))
        for d in range(2):
            h = np.zeros(toxicity.EACH)
            for i in range(len(ws)) if d == 0 else reversed(range(len(ws))):
                g, u = xs[i] @ net.into[d][:-1] + net.into[d][-1], h @ net.back[d]
                e = toxicity.EACH
                z, r = sig(g[:e] + u[:e]), sig(g[e : 2 * e] + u[e : 2 * e])
                c = np.tanh(g[2 * e :] + r * u[2 * e :])
                h = (1 - z) * c + z * h
                states[i, d * e : (d + 1) * e] = h
        a = np.exp(states @ net.look - (states @ net.look).max())
        return float((a / a.sum()) @ states @ net.out[:-1] + net.out[-1])

    cases = [*texts[:4], "", None, "!!", "one", "x" * 200, words(draw, 90)]
    for t, got in zip(cases, net.scores(cases), strict=True):
        ws = [p for w in re.findall(r"\w+", (t or "").lower()) for p in ([w] if len(w) <= 48 else [w[i : i + 32] for i in range(0, len(w) - 16, 16)])]
        starts = [0]
        while starts[-1] + 32 < len(ws):
            starts.append(starts[-1] + 16)
        want = sig(max(window(ws[s : s + 32]) for s in starts) - net.shift) if ws else 0.0
        assert abs(got - want) < 1e-4


def test_fits_without_words_and_with_repeated_ids(spark):
    for texts, y in ((["", ""], [0, 1]), (["", "!!"], [0, 1]), (["a", ""], [1, 0]), ([], []), (["a b", "", "c d"], [1, 1, 0])):
        scores = toxicity.fit(texts, np.array(y, int), steps=3).scores(["", None, "??", "a word"])
        assert max(scores[:3]) < 1e-9 and 0 < scores[3] < 1
    docs = table(spark, [(1, f"text {i}") for i in range(50)] + [(2, "other"), (None, "none")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (7, 1), (None, 1)], "doc_id long, toxic int")
    got = quality.labelled(docs, labels, "toxic", 10).collect()
    assert sorted((r.doc_id, r.label) for r in got) == [(i, int(i == 2)) for i in (1, 2) if zlib.crc32(str(i).encode()) % 5]


def test_quality_fit_like_primal_descent():
    """The dual solution against plain gradient steps on the same squared hinge loss."""
    draw = np.random.default_rng(3)
    rows_ = [np.unique(draw.integers(0, 40, 12)) for _ in range(60)]
    y = np.array([int(r[0] % 3 == 0) for r in rows_])
    model = quality.fit(rows_, y, passes=400)
    counts = np.ones((2, quality.FEATURES))
    for own, label in zip(rows_, y, strict=True):
        counts[label, own] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.zeros((60, 41))
    for i, own in enumerate(rows_):
        x[i, own] = ratio[own] / len(own) ** 0.5
    x[:, 40] = 1
    sign, weight, w = 2.0 * y - 1, np.where(y == 1, 30 / y.sum(), 30 / (60 - y.sum())), np.zeros(41)
    for _ in range(60000):
        slack = np.maximum(0, 1 - sign * (x @ w))
        w -= 0.005 * (w - 2 * x.T @ (weight * slack * sign))
    mine = np.array([model.weights[own].sum() / len(own) ** 0.5 + model.bias for own in rows_])
    assert np.abs(mine - x @ w).max() < 0.02


def test_repeats_of_a_hot_anchor_and_long_texts(spark, monkeypatch):
    """A short passage in thousands of contexts, split by the second key and indexed; texts of many chunks; one class of many copies."""
    monkeypatch.setattr(repeats, "MANY", 64)
    monkeypatch.setattr(repeats, "BLOCK", 20_000)
    monkeypatch.setattr(repeats, "CHUNK", 5_000)
    monkeypatch.setattr(skew, "LEAST", 50)
    draw = random.Random(17)
    middle, notice = words(draw, 12), words(draw, 50)
    contexts = [words(draw, 8) for _ in range(12)]
    data = [(i, draw.choice(contexts) + words(draw, draw.randint(1, 12)) + middle + words(draw, 1) + draw.choice(contexts)) for i in range(1500)]
    data += [(2000 + i, notice) for i in range(300)] + [(3000, " ".join(words(draw, 40) + notice[:150] for _ in range(60)))]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed(table(spark, data)).collect()}
    assert got == brute_repeats(data)


@pytest.mark.parametrize("hot", [4096, 40])
def test_minhash_of_many_texts_with_one_frame(spark, hot, monkeypatch):
    """Hundreds of unlinked members of one bucket in blocks, or under rare shingles; a few of them are near-duplicates."""
    monkeypatch.setattr(minhash, "HOT", hot)
    monkeypatch.setattr(minhash, "BLOCK", 64)
    monkeypatch.setattr(skew, "LEAST", 100)
    draw = random.Random(23)
    frame = [words(draw, 1) + str(i) for i in range(60)]
    data = [(i, " ".join(frame + [f"own{i}x{j}" for j in range(draw.randint(18, 26))])) for i in range(400)]
    data += [(1000 + i, data[3 * i][1] + " tail") for i in range(30)] + [(2000 + i, data[5][1]) for i in range(200)]
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in data}
    of = {i: i for i, _ in data}
    for a, b in [(a, b) for a in of for b in of if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]:
        low, high = sorted((of[a], of[b]))
        of = {i: low if c == high else c for i, c in of.items()} if low != high else of
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, data), 4).collect()}
    assert got == of and len(set(of.values())) > 300


def test_blocks_of_buckets_that_parts_cut():
    """Blocks handed from part to part give the links that they give in one part; empty parts and no parts give none."""
    draw = np.random.default_rng(5)
    base = [np.unique(draw.integers(0, 1 << 32, 60, dtype=np.uint32)) for _ in range(6)]
    rows = []
    for i in range(120):
        own = base[i % 6][: 60 - i % 4]
        least = np.full(minhash.ROWS * minhash.BANDS, i % 6, np.uint8).tobytes()
        rows.append((i // 12, 0, i % 2, i, len(own), i, i % 3 == 0, True, least, own.tobytes()))
    frame = pd.DataFrame(rows, columns=["key", "p", "q", "id", "n", "component", "asks", "here", "least", "small"]).sort_values(["key", "p", "q"], kind="stable")
    links = lambda parts: {(r.u, r.v) for part in minhash._pairs(iter(parts), 80) for r in part.itertuples()}
    whole = links([frame])
    brute = set()
    for _, block in frame.groupby(["key", "p", "q"]):
        sets = {r.id: set(np.frombuffer(r.small, np.uint32).tolist()) for r in block.itertuples()}
        brute |= {(min(a, b), max(a, b)) for a in block.id[block.asks] for b in block.id if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert whole == brute and len(whole) > 10
    for step in (1, 2, 5, 17, 50):
        assert links([frame.iloc[i : i + step] for i in range(0, len(frame), step)] + [frame.iloc[:0]]) == whole
    assert links([]) == links([frame.iloc[:0]]) == set()


def test_few_links_are_solved_as_many_are(spark):
    """Chains, hubs, a self-link, repeated links and ids at both ends of 64 bits, by rounds and by the driver."""
    from tessera.llm.components import components

    draw = np.random.default_rng(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(300, 340)] + [(5, 5), (-(2**63), 2**63 - 1)] + [(int(a) + 1000, int(b) + 1000) for a, b in draw.integers(0, 200, (90, 2))] * 2
    links = spark.createDataFrame(pairs, "u long, v long")
    got, rounds = (sorted(map(tuple, components(links, few=n).collect())) for n in (len(pairs), 0))
    assert got == rounds and (160, 100) in got and (339, 7) in got and (2**63 - 1, -(2**63)) in got and all(i != 5 for i, _ in got)
    assert components(links.where("u = 5")).count() == 0
