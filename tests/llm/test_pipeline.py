import duckdb

import corpus_pipeline as P
from eventide.llm import mixing, packing, quality

from .test_lines import brute as brute_lines
from .test_minhash import brute as brute_near

AT = "/root/testdata/sf0.001"


def test_every_stage_against_a_plain_version(spark, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{AT}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, steps[-1], AT).write.parquet(f"{tmp_path}/{k}")
        steps.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(s.columns == columns for s in steps[:-1])
    rows = [{r.doc_id: r for r in s.collect()} for s in steps[:-1]]

    good = {r.doc_id for r in quality.scored(docs, spark.read.parquet(f"{AT}/labels.parquet")).collect() if r.predicted}
    assert rows[1] == {i: r for i, r in rows[0].items() if i in good}

    gone, want = brute_lines([(i, r.text) for i, r in rows[1].items()]), {}
    for i, r in rows[1].items():
        text = "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone.get(i, ()))
        if i not in gone or text.split():
            want[i] = (text, len(text) if i in gone else r.n_chars)
    assert {i: (r.text, r.n_chars) for i, r in rows[2].items()} == want

    near = brute_near([(i, r.text) for i, r in rows[2].items()])
    assert rows[3] == {i: r for i, r in rows[2].items() if near[i][1] == i}

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/2/*.parquet'")
    cursor = con.execute(mixing.oracle())
    names = [d[0] for d in cursor.description]
    kept = {r[names.index("doc_id")] for r in cursor.fetchall() if r[names.index("kept")]}
    assert rows[4] == {i: r for i, r in rows[3].items() if i in kept}

    tok = packing.Ids(packing.tokenizer_path()).tokenizer
    total = {i: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in rows[4].items()}
    got = {}
    for r in steps[5].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == total


def test_run_gives_the_last_stage(spark):
    out = P.run(spark, AT)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_near_stage_keeps_documents_without_id(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcd")
    rows = [(1, a), (2, a), (None, a), (None, a + " end"), (None, b), (None, c), (None, c), (None, c + " end"), (7, d), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in P.near_stage(spark, docs, AT).collect()]
    assert sorted(got[k][0] or 0 for k in range(len(got))) == [0, 0, 0, 0, 1, 7]
    assert sorted((t or "")[:2] for i, t in got if i is None) == ["", "", "b0", "c0"]
    none = docs.where("doc_id is null").select("doc_id", "text")
    assert sum((r.text or "")[:2] == "a0" for r in P.near_stage(spark, none, AT).collect()) == 1


def test_every_stage_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeats, ties and columns of clashing names come through every stage."""
    plain = "This is a plain sentence of ordinary words number {} that nobody else has written down here.\n"
    names = ["doc_id", "text", "lang", "source", "n_chars", "lines", "__lines", "cell", "rate", "row", "version", "a.b"]
    texts = [plain.format(k) * 3 for k in range(30)] + [None, "", " \n\t ", "All rights reserved.\n" * 3, "".join(plain.format(1000 + k) for k in range(3000)), plain.format(3) * 3, plain.format(3) * 3]
    rows = [(None if k in (4, 31) else k if k != 7 else 6, t, None if k % 5 == 0 else "en", None if k % 7 == 0 else "s", None if k == 9 else len(t or ""), *range(7)) for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lines int, __lines int, cell int, rate int, row int, version int, `a.b` int"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    for k, (name, stage) in enumerate(P.STAGES):
        given = docs if k else docs.union(docs.limit(2))
        out = stage(spark, given, AT)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert out.columns == names and out.dtypes == docs.dtypes, name
            assert 0 < out.count() <= given.count(), name
            docs = out
        empty = stage(spark, spark.createDataFrame([], schema), AT)
        assert empty.collect() == [], name
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_line_stage_without_a_length_column(spark):
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "one two three four five\nown words"), (3, "one two three four five")], "doc_id long, text string")
    got = P.line_stage(spark, docs, AT)
    assert got.columns == ["doc_id", "text"] and sorted(map(tuple, got.collect())) == [(1, "one two three four five"), (2, "own words")]
