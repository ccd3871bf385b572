import zlib

import numpy as np

from eventide.llm import quality as Q


def test_held_out_accuracy_and_folds(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = {r.doc_id: r for r in Q.scored(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    truth = {r.doc_id: r.quality for r in labels.collect() if got[r.doc_id].held_out}
    right = np.mean([got[i].predicted == q for i, q in truth.items()])
    clean = np.mean([got[i].predicted for i, q in truth.items() if q == 1])
    assert right > 0.985 and clean > 0.99, (right, clean)


def test_neighbours_are_exact():
    rng = np.random.default_rng(0)
    counts = rng.poisson(0.02, (300, Q.TERMS)).astype(np.float32)
    counts[:, 0] += 1
    good = (rng.random(300) < 0.6).astype(float)
    model = Q.fit(counts, good, 0.8)
    fresh = rng.poisson(0.02, (20, Q.TERMS)).astype(np.float32)
    fresh[:, 0] += 1
    z = model.latent(fresh)
    for row, got in zip(z, model.score(fresh), strict=True):
        cosine = np.array([float(row @ v) for v in model.vectors])
        near = np.argsort(-cosine)[: Q.NEIGHBOURS]
        w = np.maximum(cosine[near], 1e-6) ** 8 * model.votes[near]
        assert abs(got - (w * good[near]).sum() / w.sum()) < 1e-4


def test_edge_cases(spark):
    rows = [(1, None, 0), (2, "", 0), (3, " \n", 1), (4, "Plain words here.", 1), (4, "Plain words here.", 1), (None, "x", 1), (5, "a|b " * 50000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(4, 1), (5, 0), (9, None), (None, 1), (77, 1)], "doc_id long, quality int")
    got = Q.scored(docs, labels).collect()
    assert len(got) == 7 and all(r.score is not None and r.predicted in (0, 1) for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert Q.accepted(docs, labels).columns == ["doc_id", "text", "score"]
    assert [r.score for r in Q.scored(docs, labels.limit(0)).collect()] == [0.5] * 7
    assert Q.scored(docs.limit(0), labels).collect() == []


def test_score_against_loops_from_the_text():
    """The whole path from raw texts, written out: terms, latent vectors and votes."""
    rng = np.random.default_rng(6)
    words = ["plain", "Word", "x1", "a|b", "été", "no-no", "RUN", "7"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40), p=(w := rng.dirichlet(np.ones(8))))) for _ in range(60)]
    data, ends = "".join(texts).encode(), np.cumsum([0] + [len(t.encode()) for t in texts])
    counts = Q.term_counts(np.frombuffer(data, np.uint8), ends)

    def shape(word):
        out = []
        for b in word.encode():
            kind = "a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b)
            if not out or out[-1] != kind:
                out.append(kind)
        return "".join(out)

    # texts with the same shapes, shape pairs and repetitions in the same numbers, and no others, have equal counts
    def said(text):
        w = text.split(" ")
        return sorted(map(shape, w)), sorted((shape(a), shape(b), a.lower() == b.lower()) for a, b in zip(w, w[1:], strict=False))

    pairs = sorted((shape(a), shape(b)) for a, b in zip(texts[0].split(" "), texts[0].split(" ")[1:], strict=False))
    assert counts[0].sum() == len(texts[0].split(" ")) + 2 * len(pairs)
    for i in range(60):
        for j in range(i):
            a, b = said(texts[i]), said(texts[j])
            if a[0] == b[0] and [x[:2] for x in a[1]] == [x[:2] for x in b[1]] and sum(x[2] for x in a[1]) == sum(x[2] for x in b[1]):
                assert (counts[i] == counts[j]).all()
            elif a[0] != b[0]:
                assert (counts[i] != counts[j]).any()
    good = (rng.random(40) < 0.5).astype(float)
    model = Q.fit(counts[:40], good, 0.7)
    got = model.score(counts[40:])

    def vector(c):
        x = [np.sqrt(v / c.sum()) * w for v, w in zip(c, model.weight, strict=True)]
        z = [sum(x[t] * model.axes[t, k] for t in np.flatnonzero(c)) for k in range(model.axes.shape[1])]
        return np.array(z) / np.sqrt(sum(v * v for v in z))

    known = [vector(c) for c in counts[:40]]
    for c, g in zip(counts[40:], got, strict=True):
        z = vector(c)
        cosine = np.array([float((z * v).sum()) for v in known])
        last = np.sort(cosine)[-Q.NEIGHBOURS]
        near = np.flatnonzero(cosine >= last - 1e-6)
        w = [max(cosine[k], 1e-6) ** 8 * (0.7 / good.mean() if good[k] else 0.3 / (1 - good.mean())) for k in near]
        assert abs(g - sum(x for x, k in zip(w, near, strict=True) if good[k]) / sum(w)) < 2e-3


def test_ties_and_labels_that_disagree(spark):
    counts = np.zeros((60, Q.TERMS), np.float32)
    counts[:, 3] = 1
    counts[30:, 5] = 1
    good = np.r_[np.arange(30) % 3 == 0, np.ones(30)].astype(float)
    for order in (np.arange(60), np.random.default_rng(0).permutation(60)):
        model = Q.fit(counts[order], good[order], good.mean())
        assert abs(model.score(counts[:1])[0] - 1 / 3) < 1e-6  # all 30 that tie vote
    docs = spark.createDataFrame([(k, f"Plain words {k} here.") for k in range(40)] + [(k, "a|b;;") for k in range(40, 80)] + [(3, "a|b;;")], "doc_id long, text string")
    labels = [(k, int(k < 40)) for k in range(80)]
    plain = spark.createDataFrame([x for x in labels if x[0] not in (1, 2, 41)], "doc_id long, quality int")
    noisy = spark.createDataFrame([*labels, (1, 0), (2, 0), (41, 1)], "doc_id long, quality int")
    both = [sorted((r.doc_id, r.score) for r in Q.scored(docs, x).collect()) for x in (plain, noisy)]
    assert both[0] == both[1]
