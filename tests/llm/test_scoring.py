import numpy as np

from eventide.llm import scoring as S


def test_contexts_stay_in_their_text():
    tokens, index = np.arange(7, dtype=np.int32), np.array([0, 4, 4, 7])
    got = S.contexts(tokens, index)
    p = S.PAD
    assert got[0].tolist() == [p, p, p, 1, 2, 3] and got[3].tolist() == [0, 1, 2, p, p, p] and got[4].tolist() == [p, p, p, 5, 6, p]


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = S.Network.fresh()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    context, target = rng.integers(0, 50, (40, 2 * S.WINDOW)), rng.integers(0, S.VOCABULARY, 40)

    loss = lambda: -net.log_probability(context, target).mean()
    before = {k: v.copy() for k, v in net.w.items()}
    memory = {k: np.ones(v.shape) * 1e12 for k, v in before.items()}  # steps of a known, tiny size
    net.step(context, target, memory)
    moved = {k: (before[k] - net.w[k]) * 1e6 / S.RATE for k in before}
    net.w = before
    for k in before:
        flat = before[k].reshape(-1)
        at = int(np.abs(moved[k]).argmax())
        old = flat[at]
        flat[at] = old + 1e-5
        up = loss()
        flat[at] = old - 1e-5
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-5 - moved[k].reshape(-1)[at]) < 1e-4 * max(1, abs(moved[k]).max()) + 1e-6, k


def test_training_beats_a_fresh_network_and_sums_are_exact(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4, "doc_id")
    net = S.trained(docs.select("text"))
    fresh = {r.doc_id: r for r in S.scored(docs, S.Network.fresh()).collect()}
    got = {r.doc_id: r for r in S.scored(docs, net).collect()}
    mean = lambda rows: sum(r.log_probability for r in rows.values()) / sum(r.n_tokens for r in rows.values())
    assert mean(got) > mean(fresh) + 0.5
    for r in docs.limit(20).collect():
        data = np.frombuffer(r.text.encode(), np.uint8)
        tokens, index = S.tokens_of(data, np.array([0, len(data)]))
        want = 0.0
        for k, t in enumerate(tokens):
            near = [tokens[k + d] if 0 <= k + d < len(tokens) else S.PAD for d in (-3, -2, -1, 1, 2, 3)]
            want += float(net.log_probability(np.array([near]), np.array([t]))[0])
        assert got[r.doc_id].n_tokens == len(tokens) and abs(got[r.doc_id].log_probability - want) < 1e-3 * max(1, abs(want))


def test_shuffled_text_scores_lower(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(12)]
    text = " ".join(words * 30)
    rows = [(k, text) for k in range(60)]
    net = S.trained(spark.createDataFrame(rows, "doc_id long, text string").repartition(1).select("text"), rounds=4)
    mixed = " ".join(rng.permutation(words * 30))
    a, b = (r.log_probability for r in S.scored(spark.createDataFrame([(1, text), (2, mixed)], "doc_id long, text string"), net).orderBy("doc_id").collect())
    assert a > b


def test_edge_cases(spark):
    rows = [(1, None, 3), (2, "", 3), (3, " \n", 3), (4, "one", 3), (4, "one", 3), (None, "a b", 3), (5, "x " * 200000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = S.scored(docs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 1), (4, 1), (5, 200000)]
    assert all((r.log_probability == 0) == (r.n_tokens == 0) == (r.mean_log_probability is None) for r in got)
    assert S.scored(docs.limit(0)).collect() == []


def test_words_of_one_class_are_told_apart(spark, monkeypatch):
    words = [f"w{k}" for k in range(3000)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    classes = S.tokens_of(data, np.array([0, len(data)]))[0].tolist()
    often, seldom = next((words[classes.index(c)], words[k]) for k, c in enumerate(classes) if classes.index(c) < k)
    rows = [(k, f"{often} and more") for k in range(30)] + [(30, f"{seldom} and more"), (31, f"{seldom} and more"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for share in (S.COMMON, 0.05, 1.0):  # all words looked up, some, none
        monkeypatch.setattr(S, "COMMON", share)
        got = {r.doc_id: r.log_probability for r in S.scored(docs).collect()}
        assert abs(got[0] - got[30] - np.log(30 / 2)) < 1e-6 and got[30] == got[31] and got[None] == 0


def test_counts_hold_every_word(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    want = {}
    for r in docs.collect():
        data = np.frombuffer(r.text.encode(), np.uint8)
        for w in S.hash_words(data, np.array([0, len(data)]))[0].view(np.int64).tolist():
            want[w] = want.get(w, 0) + 1
    for held in (S.HELD, 50):
        monkeypatch.setattr(S, "HELD", held)
        assert {r.word: r.n for r in S.word_counts(docs).collect()} == want


def test_every_position_is_a_target(spark):
    text = "one two three four " * 50
    net, fresh = S.trained(spark.createDataFrame([(text,)] * 40, "text string").repartition(1)), S.Network.fresh()
    data = np.frombuffer(text.encode(), np.uint8)
    tokens, index = S.tokens_of(data, np.array([0, len(data)]))
    near = S.contexts(tokens, index)
    gain = net.log_probability(near, tokens) - fresh.log_probability(near, tokens)
    assert all(gain[k::4].mean() > 1 for k in range(4))


def test_sums_by_plain_loops_from_the_weights(spark):
    """The conditional log-probability of each word, written out from the weights and plain counts."""
    import math

    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["the", "a", "Cat", "dog", "sat", "on", "mat", "ran"], rng.integers(1, 30))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    w = S.trained(docs.select("text")).w
    got = {r.doc_id: r for r in S.scored(docs).collect()}
    of, n, per_class = {}, {}, {}
    for t in texts:
        for word in t.lower().split():
            data = np.frombuffer(word.encode(), np.uint8)
            of[word] = int(S.hash_words(data, np.array([0, len(data)]))[0][0] % np.uint64(S.VOCABULARY))
            n[word] = n.get(word, 0) + 1
            per_class[of[word]] = per_class.get(of[word], 0) + 1

    def softmax(z):
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    for i, t in enumerate(texts):
        words, want = t.lower().split(), 0.0
        for k, word in enumerate(words):
            h = [0.0] * S.WIDTH
            for j, d in enumerate((-3, -2, -1, 1, 2, 3)):
                if 0 <= k + d < len(words):
                    e = w["embed"][of[words[k + d]]]
                    h = [x + float(e[c]) * float(w["place"][j][c]) for c, x in enumerate(h)]
            h = [math.tanh(x) for x in h]
            a, b = divmod(of[word], S.SIDE)
            p = softmax([sum(h[c] * float(w["one"][c][s]) for c in range(S.WIDTH)) + float(w["one_b"][s]) for s in range(S.SIDE)])
            h = [x + float(w["hint"][a][c]) for c, x in enumerate(h)]
            q = softmax([sum(h[c] * float(w["two"][c][s]) for c in range(S.WIDTH)) + float(w["two_b"][s]) for s in range(S.SIDE)])
            want += math.log(p[a]) + math.log(q[b]) + math.log(n[word] / per_class[of[word]])
        assert got[i].n_tokens == len(words) and abs(got[i].log_probability - want) < 1e-3 * max(1, abs(want))


def test_contexts_of_some_tokens():
    rng = np.random.default_rng(3)
    index = np.array([0, 3, 3, 10, 11, 40])
    tokens = rng.integers(0, S.VOCABULARY, 40).astype(np.int16)
    whole = S.contexts(tokens, index)
    for chosen in (np.arange(40), np.array([0, 2, 3, 10, 39]), np.arange(1, 40, 4)):
        assert (S.contexts_at(tokens, index, chosen) == whole[chosen]).all()
