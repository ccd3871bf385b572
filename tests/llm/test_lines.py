import hashlib

import duckdb
import numpy as np

from eventide.llm import lines as L


def brute(rows):
    """Numbers of the lines that go, by comparing every pair of lines."""
    sets = []
    for doc_id, text in rows:
        if doc_id is None:
            continue
        for k, line in enumerate((text or "").split("\n")):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
            words = [w for w in low.replace("\t", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
            if words:
                sets.append(((doc_id, k), {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}))
    out = {}
    for at, s in sets:
        if any(b < at and 4 * len(s & t) >= 3 * len(s | t) for b, t in sets):
            out.setdefault(at[0], set()).add(at[1])
    return out


def run(spark, rows, columns="doc_id long, text string"):
    got = L.removed_lines(spark.createDataFrame(rows, columns)).collect()
    assert all(len(r.lines) == len(set(r.lines)) for r in got)
    out = {}
    for r in got:
        out.setdefault(r.doc_id, set()).update(r.lines)
    return out


def test_against_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/documents.parquet'")
    cursor = con.execute(L.ORACLE)
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r[n] for n in names) for r in L.op5_lines(spark, at).collect()) == sorted(cursor.fetchall())


def test_near_copies_chains_and_stars(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(60)]
        for k in range(30):
            words = list(base)
            for j in rng.choice(60, rng.integers(0, 3), replace=False):
                words[j] = f"x{g}_{k}_{j}"
            start = int(rng.integers(0, 8))
            rows.append((int(rng.integers(0, 40)) * 100 + len(rows) % 100, "\n".join(["head " + str(len(rows)), " ".join(words[start:]), "a b c d e", "tail"])))
    assert run(spark, rows) == brute(rows)


def test_edge_cases(spark):
    line = "one two three four five six"
    long = " ".join(f"w{k}" for k in range(50000))
    rows = [(1, None), (2, ""), (3, line), (3, line), (4, f"\n{line}\n"), (5, f"{line.upper()}\n{line}\nfew words here"), (None, line), (6, long), (7, f"few words here\n{long} end"), (8, "\n\n"), (9, "é ü ñ ç ø\n\té ü  ñ ç ø")]
    assert run(spark, rows) == brute(rows) == {4: {1}, 5: {0, 1}, 7: {0, 1}, 9: {1}}
    assert run(spark, []) == {}
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, line int, cls string")
    got = L.deduplicated(docs)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[4] == "\n" and texts[5] == "few words here" and texts[1] is None and texts[None] == line and texts[7] == ""
    assert hashlib.md5(texts[6].encode()).hexdigest() == hashlib.md5(long.encode()).hexdigest()


def test_lines_of_few_words(spark):
    rows = [(1, "All rights reserved.\none\n \n\nx"), (2, "all  rights RESERVED.\nall rights\none one\n"), (3, "one\none two three four\none two three four five\n\n "), (4, "one two three four\none two three four six\nx")]
    assert run(spark, rows) == brute(rows) == {2: {0}, 3: {0}, 4: {0, 2}}


def test_repeated_words_and_lines_of_equal_sets(spark):
    rows = [(1, "a a a a a a"), (2, "a a a a a\nb c b c b c b"), (3, "b c b c b c b c b c\na a a a"), (4, "b c b c b c")]
    assert run(spark, rows) == brute(rows)


def test_rows_that_repeat_an_id_keep_their_own_lines(spark):
    line, own = "one two three four five six", "one unique line of seven words here"
    rows = [(1, line), (2, line), (2, own), (2, f"{own} \n{line}"), (3, None), (3, own)]
    got = L.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(1, line), (2, ""), (2, own), (2, f"{own} "), (3, ""), (3, "")]


def test_columns_of_any_name(spark):
    names = ["doc_id", "text", "__lines", "__id", "lines", "row", "version", "bucket", "may", "bits", "a.b", "c`d"]
    rows = [(k, "one two three four five", *range(2, len(names))) for k in (1, 2)]
    got = L.deduplicated(spark.createDataFrame(rows, names))
    assert got.columns == names
    assert sorted(tuple(r) for r in got.collect()) == [(1, *rows[0][1:]), (2, "", *rows[1][2:])]


def test_hot_tokens_and_wide_rounds(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(150):
        words = list(base)
        for j in rng.choice(40, rng.integers(0, 8), replace=False):
            words[j] = f"x{k}_{j}"
        rows.append((int(rng.integers(0, 10**6)), " ".join(words)))
    want = brute(rows)
    assert want and run(spark, rows) == want
    monkeypatch.setattr(L, "SMALL", 4)
    assert run(spark, rows) == want
    monkeypatch.setattr(L, "HOT", 2)
    assert run(spark, rows) == want


def test_prefix_is_long_enough():
    for n in range(1, 200):
        p = int(L.prefix(np.array([n]))[0])
        assert n - p + 1 == -(-3 * n // 4)
