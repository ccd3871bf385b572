import math

import numpy as np

from eventide.llm import topk as K


def brute(rows, k):
    v = {}
    for i, e in rows:
        if e is not None and all(x is not None and math.isfinite(x) for x in e):
            v.setdefault(i, []).append([math.floor(64 * x) for x in e])
    rows = [(i, c) for i, cs in v.items() for c in cs]
    out = []
    for at, (q, x) in enumerate(rows):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, c, strict=False)), i) for n, (i, c) in enumerate(rows) if n != at)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def run(spark, rows, k):
    v = K.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = K.top_k(v, "vec_id % 20 = 0", k).collect()
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got)


def test_against_brute_force(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert run(spark, rows, 20) == brute(rows, 20)


def test_ties_nulls_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-1, 2, 4) / 4]) for i in range(200)]
    rows += [(200, None), (220, [None, 1.0]), (240, [float("nan"), 1.0]), (260, [float("inf"), 1.0]), (280, [0.0, 0.0, 0.0, 0.0]), (300, [])]
    assert run(spark, rows, 7) == brute(rows, 7)


def test_fewer_candidates_and_empty_table(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.5]), (2, [-1.0, 0.5])]
    assert run(spark, rows, 20) == brute(rows, 20)
    assert run(spark, [], 20) == []


def test_pruning_keeps_the_result(monkeypatch):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(3000, 8)) * 5 + rng.integers(0, 6, (3000, 1)) * 60).astype(np.int64)
    pivots = x[:20]
    d = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(axis=2))
    near = d.argmin(axis=1)
    rings = []
    for p in range(20):
        own = np.flatnonzero(near == p)
        own = own[np.argsort(d[own, p])]
        for a in range(0, len(own), 50):
            s = own[a : a + 50]
            rings.append({"pivot": p, "lo": d[s, p].min(), "hi": d[s, p].max(), "norm": np.sqrt((x[s] ** 2).sum(axis=1)).max(), "ids": s, "keys": s, "x": x[s]})
    done = []
    plain = K.products
    monkeypatch.setattr(K, "products", lambda q, c: done.append(len(q) * len(c)) or plain(q, c))
    q = x[:50]
    best = K.expand(np.arange(50), q, rings, pivots, np.full(50, K.NONE), 5)
    assert sum(done) < 0.9 * 50 * 3000
    scores = q @ x.T
    scores[np.arange(50), np.arange(50)] = -(2**62)
    rows, ids, s = best.rows()
    for k in range(50):
        assert ids[rows == k].tolist() == sorted(range(3000), key=lambda i: (-scores[k, i], i))[:5]


def test_rows_that_repeat_an_id_are_queries_each(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in [0, 0, 0, 20, 20, *range(1, 60)]]
    rows += [(0, rows[0][1]), (40, rows[3][1])]
    assert run(spark, rows, 5) == brute(rows, 5)


def test_queries_of_another_table(spark):
    rows = [(i, [float(i), 1.0]) for i in range(30)]
    v = K.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    asked = K.quantized(spark.createDataFrame([(29, [1.0, 0.0]), (100, [0.0, 1.0]), (100, [-1.0, 0.0])], "vec_id long, embedding array<float>"))
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in K.top_k(v, asked, 2).collect())
    assert got == [(29, 1, 28), (29, 2, 27), (100, 1, 0), (100, 1, 0), (100, 2, 1), (100, 2, 1)]


def test_annuli_that_cannot_matter_do_not_travel(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8)) * 40
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=8) / 10]) for i in range(2400)]
    for name, n in (("SHARD", 200), ("ANNULUS", 20), ("BLOCK", 16), ("SEEDS", 400)):
        monkeypatch.setattr(K, name, n)
    want = brute(rows, 4)
    assert run(spark, rows, 4) == want
    seen = []
    plain = K.Scratch.write
    monkeypatch.setattr(K.Scratch, "write", lambda self, df: seen.append(out := plain(self, df)) or out)
    assert run(spark, rows, 4) == want
    blocks = next(f for f in seen if "rings" in f.columns)
    rings = next(f for f in seen if "norm" in f.columns).count()
    assert max(r.n for r in blocks.selectExpr("size(rings) as n").collect()) < rings / 2
    monkeypatch.setattr(K, "BROADCAST_RINGS", 0)
    assert run(spark, rows, 4) == want
