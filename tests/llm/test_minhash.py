import re

import pytest

from eventide.llm.minhash import minmax_signature, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(s), root(i)) for i, s in sets}


def run(spark, rows, columns="doc_id long, text string"):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, columns)).collect()}


def test_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = run(spark, rows)
    want = brute(rows)
    assert {i: v[:2] for i, v in got.items()} == want
    assert all(kept == (i == c) for i, (_, c, kept) in got.items())


def test_star_and_chain_of_near_copies(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(100, " ".join(base))]
    for k in range(40):  # each near the base, most not near each other
        words = list(base)
        words[k + 10] = f"x{k}"
        rows.append((k, " ".join(words)))
    chain = [f"c{k}" for k in range(80)]
    for k in range(6):
        rows.append((200 + k, " ".join(chain[4 * k : 4 * k + 50])))
    assert {i: v[:2] for i, v in run(spark, rows).items()} == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"v{k % 5000}" for k in range(60000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a B"), (6, "a b c d e"), (6, "a b c d e"), (7, "A B C D E"), (8, long), (9, long + " end"), (10, "Ünï çødé x"), (None, "a b")]
    got = run(spark, rows)
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (1, 4, True) and got[5] == (1, 4, False) and got[None] == (1, 4, False)
    assert got[6] == (1, 6, True) and got[7] == (1, 6, False)
    assert got[8][1] == 8 and got[9][1] == 8 and got[10] == (1, 10, True)


def test_empty_table_and_extra_columns(spark):
    assert run(spark, []) == {}
    rows = [(1, "a b c d e f", 7, "z"), (2, "a b c d e f", 8, None)]
    got = run(spark, rows, "doc_id long, text string, id long, label string")
    assert got[2] == (2, 1, False)


@pytest.mark.parametrize("n", [1, 3, 5000])
def test_signature_holds_both_ends(n):
    import numpy as np

    x = np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64)
    s = minmax_signature(x)
    assert len(s) == 128 and (s[:64] <= s[64:]).all()


def test_an_id_of_several_texts_joins_their_groups(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (5, c), (6, c), (4, c), (3, " "), (7, None), (7, "z")]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 26): (1, True), (2, 26): (1, False), (3, 26): (1, False), (3, 0): (3, True), (5, 26): (4, False), (6, 26): (4, False), (4, 26): (4, True), (7, 0): (7, True), (7, 1): (7, True)}
