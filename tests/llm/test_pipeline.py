"""The pipeline over a small folder: stages keep the columns, decisions take effect, every document that stays is packed."""

import random

import corpus_pipeline
import __spark_entry__


def test_stages(spark, tmp_path):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcde") for _ in range(draw.randint(2, 6)))
    texts = [" ".join(word() for _ in range(60)) for _ in range(120)]
    rows = [(i, t + (" vilewort slurword" if i % 4 == 0 else "") + " password = hunter2x", "en", "s", 0) for i, t in enumerate(texts)]
    rows += [(500, rows[1][1], "en", "s", 0), (501, None, None, None, None), (None, "free text", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept, sizes = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path)).cache()
        assert kept.columns == docs.columns and kept.schema.simpleString() == docs.schema.simpleString()
        sizes.append(kept.count())
    ids = {r.doc_id for r in kept.collect()}
    assert 500 not in ids and {1, 2, 3, 501, None} <= ids and len(ids & set(range(0, 120, 4))) <= 3 and sizes[1] == sizes[2] == sizes[3]
    assert not any("hunter2x" in (r.text or "") for r in kept.collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids
    assert {"pipeline", "op1_minhash", "op10_ann"} <= set(__spark_entry__.queries())


def test_near_duplicates_and_repeats_go_by_row(spark, tmp_path):
    draw = random.Random(6)
    a, b, c, d = (" ".join("".join(draw.choice("abcde") for _ in range(5)) for _ in range(60)) for _ in range(4))
    rows = [(7, a), (7, b), (3, a), (3, a), (None, a), (None, c), (None, c), (9, None), (9, None), (None, d + " " + b[:200])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near(spark, docs, "").cache()
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(7, b), (3, a), (None, c), (9, None), (9, None), rows[-1]], key=str)
    cut = corpus_pipeline.repeated(spark, kept, "")
    assert cut.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in cut.collect()), key=str) == sorted([(7, b), (3, a), (None, c), (9, None), (9, None), (None, d + " ")], key=str)


def test_run_like_brute_force(spark, tmp_path):
    """Every stage restated plainly on a small folder, and the rows that come out at the end."""
    import re
    import zlib

    import numpy as np
    import public_tokenizers
    from test_texts import plain_spans
    from tokenizers import Tokenizer

    from tessera.llm import toxicity

    draw = random.Random(31)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6)))
    some = lambda n: [word() for _ in range(n)]
    passage = some(60)
    texts = [some(70) + (["vilewort", "slurword"] if i % 4 == 0 else []) for i in range(60)]
    for i in (5, 9, 13):
        texts[i][20:20] = passage
        texts[i].append("api_key: q9Zr7Lk2Xw8Tb4Mn6Vc1Pd3")
    texts += [texts[1], texts[1][:-1] + ["end"], texts[2][:40] + some(30), []]
    rows = [(3 * i + 1, " ".join(t)) for i, t in enumerate(texts)]
    table = [(i, t, "en", "s", len(t)) for i, t in rows]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int("vilewort" in t)) for i, t in rows[:50]], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    net = toxicity.train(docs, labels)
    kept = [(i, t) for (i, t), s in zip(rows, net.scores([t for _, t in rows]), strict=True) if s < 0.5]
    assert 40 < len(kept) < len(rows)

    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for i, t in kept}
    of = {i: i for i, _ in kept}
    for _ in kept:
        for a in of:
            for b in of:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    of[a] = min(of[a], of[b])
    kept = [(i, t) for i, t in kept if of[i] == i]

    seen, cut = set(), []
    for i, t in kept:
        gone = bytearray(len(t))
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(t[p : p + 100])
        cut.append((i, "".join(c for c, g in zip(t, gone, strict=True) if not g)))
    assert cut != kept

    def redacted(t):
        hit = bytearray(len(t))
        for _, s, e in (x.split(":") for x in plain_spans(t)[1].split(",") if x):
            hit[int(s) : int(e)] = b"\1" * (int(e) - int(s))
        for m in reversed(list(re.finditer(b"\1+", bytes(hit)))):
            t = t[: m.start()] + "[SECRET]" + t[m.end() :]
        return t

    clean = [(i, redacted(t)) for i, t in cut]
    assert clean != cut
    own, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, t in clean:
        ids = np.array([*own.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert len(ids) <= 1024
        want.append((i, 0, 0, len(ids), zlib.crc32(ids.tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in fill.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1]] and sum(n for _, n in places) <= 1024


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
