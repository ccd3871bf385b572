import math

import numpy as np

from eventide.llm import embeddings as E


def brute(rows, t=0.9):
    ok = [(i, np.array(e, float)) for i, e in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    u = np.stack([x / np.linalg.norm(x) for _, x in ok])
    hit = u @ u.T >= t
    np.fill_diagonal(hit, False)
    ids = np.array([i for i, _ in ok])
    label = ids.copy()
    while True:
        new = np.array([min([label[k], *label[hit[k]]]) for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return {int(i): (int(n), int(c)) for i, n, c in zip(ids, hit.sum(axis=1), label, strict=True)}


def planted(n, width, rng):
    x = rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(n // 2, n):  # links at cosines from just under to well over the threshold
        y = x[rng.integers(0, n // 2)]
        c = rng.uniform(0.88, 0.999)
        z = rng.normal(size=width)
        z -= (z @ y) * y
        x[k] = c * y + math.sqrt(1 - c * c) * z / np.linalg.norm(z)
    return x


def test_recall_and_precision_against_brute_force(spark):
    rows = [(int(i), [float(v) for v in x]) for i, x in enumerate(planted(3000, 64, np.random.default_rng(8)))]
    got = {r.vec_id: r for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    found, there = sum(r.n_links for r in got.values()), sum(n for n, _ in want.values())
    assert all(got[i].n_links <= n for i, (n, _) in want.items())
    assert found % 2 == 0 and found >= 0.98 * there, (found, there)
    assert all(r.kept == (r.vec_id == r.component_id) and want[r.vec_id][1] <= r.component_id for r in got.values())


def test_edge_cases(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, -1.0]
    rows = [(7, a), (3, a), (5, [10 * v for v in a]), (9, b), (11, [0.0] * 4), (12, None), (13, [None, 1.0, 1.0, 1.0]), (14, [float("nan"), 1.0, 1.0, 1.0]), (15, [float("inf"), 1.0, 1.0, 1.0]), (16, []), (9, b), (None, a), (20, [1e-30 * v for v in b])]
    docs = spark.createDataFrame([(*r, k, "z") for k, r in enumerate(rows)], "vec_id long, embedding array<double>, x int, cls string")
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in E.near_vectors(docs).collect()]
    assert sorted(got, key=str) == sorted([(7, 2, 3, False), (3, 2, 3, True), (5, 2, 3, False), (9, 2, 9, True), (9, 2, 9, True), (20, 2, 9, False), *((i, 0, i, True) for i in (11, 12, 13, 14, 15, 16)), (None, 0, None, False)], key=str)
    assert E.near_vectors(docs.limit(0)).collect() == []


def test_traversal_is_the_plain_order():
    rng = np.random.default_rng(0)
    x = planted(500, 10, rng)
    grid = E.Grid(x, 8, 0.9)
    one, two = grid.halves(x[:20])
    for k in range(20):
        total = (one[k][:, None] + two[k][None, :]).ravel()
        assert np.allclose(total[grid.order(x[:20], 13)[k]], np.sort(total)[:13])


def test_forests_connect_what_links_connect():
    rng = np.random.default_rng(4)
    for density in (0.002, 0.02, 0.3, 0.9):
        hit = rng.random((60, 90)) < density
        row, col = rng.permutation(200)[:60], rng.permutation(200)[:90]
        if not hit.any():
            continue
        x, y = np.nonzero(hit)
        a, b = E.step_forest(hit, row, col)
        want = E.forest(row[x], col[y])
        assert dict(zip(a.tolist(), b.tolist(), strict=True)) == dict(zip(want[0].tolist(), want[1].tolist(), strict=True))


def test_blocks_hold_every_cell():
    sizes = {0: 10, 3: 4000, 4: 200, 7: 9000, 9: 1, 12: 4096}
    first, parts, n = E.blocks_of(sizes, 16)
    assert {c: int(p) for c, p in enumerate(parts) if p} == {0: 1, 3: 1, 4: 1, 7: 3, 9: 1, 12: 1}
    assert n == first.max() + 1 and [int(first[c]) for c in sizes] == [0, 0, 1, 2, 5, 6]


def test_many_near_equal_vectors(spark, monkeypatch):
    """A tight cluster over several blocks: every pair links, none is listed."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(E, "CELL_ROWS", 300)
    monkeypatch.setattr(E, "PROBE_ROWS", 500)
    base = rng.normal(size=24)
    rows = [(i, [float(v) for v in base + rng.normal(size=24) * 0.01]) for i in range(1500)] + [(2000 + i, [float(v) for v in -base + rng.normal(size=24) * 0.01]) for i in range(200)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (1499, 0) if i < 1500 else (199, 2000) for i, _ in rows}
