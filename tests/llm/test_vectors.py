"""Vector searches against brute force."""

import numpy as np

from tessera.llm import ann, topk
from tessera.llm import vectors as V


def vectors(spark, n=700):
    x = np.random.default_rng(6).normal(size=(n, 16)).astype(np.float32)
    x[300:380] = x[300]
    rows = [(i, v.tolist(), "q") for i, v in enumerate(x)]
    rows[100] = (100, None, "q")
    rows[200] = (200, [None] * 16, "q")
    rows[201] = (201, [float("nan")] * 16, "q")
    rows[202] = (202, [0.0] * 16, "q")
    rows[203] = (203, [1.0, 2.0], "q")
    return spark.createDataFrame([*rows, (None, x[0].tolist(), "q"), (400, x[400].tolist(), "q")], "vec_id long, embedding array<float>, list string"), x, {100, 200, 201, 203}


def test_topk(spark):
    table, x, out = vectors(spark)
    got = {}
    for r in topk.search(table).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    z = np.floor(64 * x.astype(float)).astype(np.int64)
    z[202] = 0
    ids = np.array([i for i in range(len(x)) if i not in out] + [400])
    assert set(got) == {i for i in set(ids.tolist()) if i % 20 == 0}
    for q, hits in got.items():
        s = [(-int(z[i] @ z[q]), int(i)) for i in ids if i != q]
        assert [hits[k + 1] for k in range(20)] == [(i, -v) for v, i in sorted(s)[:20]]
    assert topk.search(table.limit(0)).count() == 0


def test_topk_in_blocks(spark, monkeypatch):
    """Blocks of few queries and rows, several query groups, clusters that bounds exclude, two lengths of vectors, one query group of equal vectors."""
    monkeypatch.setattr(V, "BLOCK_ROWS", 7)
    monkeypatch.setattr(V, "MANY_ROWS", 60)
    draw = np.random.default_rng(8)
    x = (draw.normal(size=(9, 6))[draw.integers(0, 9, 400)] * 5 + draw.normal(size=(400, 6)) * 0.1).astype(np.float32)
    x[100:300] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, [float(i), 1.0]) for i in range(5)]
    got = {}
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=2, k=5, pivots=9).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    z = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in rows}
    assert set(got) == {i for i in z if i % 2 == 0}
    for q, hits in got.items():
        want = sorted((-int(z[i] @ z[q]), i) for i in z if i != q and len(z[i]) == len(z[q]))[:5]
        assert [hits[k] for k in sorted(hits)] == [(i, -v) for v, i in want]


def test_bounds_leave_groups_out():
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(8, 5)) * 20
    own = draw.integers(0, 8, 500)
    x = centres[own] + draw.normal(size=(500, 5)) * 0.05
    rows, radius = np.bincount(own, minlength=8), np.array([np.linalg.norm(x[own == g] - centres[g], axis=1).max() for g in range(8)])
    floor = topk.reach(centres, radius, centres, rows, radius, 10)
    may = topk.needed(x, centres, radius, floor)
    for g in range(8):
        for q in np.flatnonzero(own == g)[:5]:
            score = x @ x[q]
            score[q] = -np.inf
            assert may[np.argsort(-score)[:10], g].all()
    assert may.mean() < 0.5


def test_ann(spark):
    table, x, out = vectors(spark)
    got = {}
    for r in ann.search(table).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    ids = np.array([i for i in range(len(x)) if i not in out | {202}] + [400])
    assert set(got) == {0, 300, 400, 500, 600}
    hit = 0
    for q, hits in got.items():
        d = sorted((float(np.sqrt(((x[i].astype(float) - x[q]) ** 2).sum())), int(i)) for i in ids if i != q)[:10]
        hit += len({i for _, i in d} & {v for v, _ in hits.values()})
        assert all(abs(s - float(np.sqrt(((x[v].astype(float) - x[q]) ** 2).sum()))) < 1e-12 for v, s in hits.values())
        assert [hits[k] for k in sorted(hits)] == sorted(hits.values(), key=lambda h: (h[1], h[0]))
    assert hit >= 45 and [got[300][k][0] for k in range(1, 11)] == list(range(301, 311))
    assert ann.search(table.limit(0)).count() == 0


def test_ann_lists_grow_and_probes_follow_the_data(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 50)
    assert [ann.lists_of(n) for n in (1, 2_000, 50_000, 10**9)] == [16, 64, 512, 1024]
    draw = np.random.default_rng(10)
    x = (draw.normal(size=(40, 16))[draw.integers(0, 40, 4000)] * 3 + draw.normal(size=(4000, 16)) * 0.3).astype(np.float32)
    index = ann.fit(x.astype(float), 64)
    assert index.probes < 16  # clustered: a small share
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(table, every=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        d = ((x.astype(float) - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(found & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert len(got) == 200 and hit >= 0.9 * 2000
