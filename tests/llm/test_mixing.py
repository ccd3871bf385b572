import duckdb
import pytest

from eventide.llm import mixing as M


def test_against_sql(spark):
    at = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/documents.parquet'")
    want = con.execute(M.oracle()).fetchall()
    got = M.op10_mixing(spark, at)
    names = [d[0] for d in con.execute(M.oracle()).description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want)


def test_weights_meet_the_marginals_and_the_budget(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = M.mixed(docs).collect()
    total = sum(r.n_tokens for r in rows)
    share = {}
    for r in rows:
        share[r.lang] = share.get(r.lang, 0) + r.weight / total
        share[r.topic] = share.get(r.topic, 0) + r.weight / total
    assert share == pytest.approx({"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15, "prose": 0.9, "legal": 0.1}, abs=1e-3)
    assert sum(r.rate * r.n_tokens for r in rows) / total == pytest.approx(0.8, abs=1e-6)
    assert sum(r.n_tokens for r in rows if r.kept) / total == pytest.approx(0.8, abs=0.02)
    plan = M.mixed(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_edge_cases(spark):
    rows = [(1, None, None, None, 5), (1, None, None, None, 5), (2, "", "en", "a", 6), (3, "w " * 100000, "xx", "b", 7), (None, "a b License c", "de", "a", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, t int")
    got = M.mixed(docs).collect()
    assert len(got) == 5 and all(0 < r.rate <= 1 and r.weight > 0 and r.kept is not None for r in got)
    assert {r.n_tokens for r in got} == {1, 100000, 4} and {r.lang for r in got} == {"", "en", "xx", "de"}
    assert M.sampled(docs).columns == docs.columns
    assert sorted(r.t for r in M.sampled(docs).collect()) == sorted(8 if r.doc_id is None else {1: 5, 2: 6, 3: 7}[r.doc_id] for r in got if r.kept)
    assert M.mixed(docs.limit(0)).collect() == []


def test_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "lang", "__cell", "__rate", "cell", "rate", "row", "topic", "a.b"]
    docs = spark.createDataFrame([(k, f"w{k} words", "s", "en", *range(7)) for k in range(50)], names)
    got = M.sampled(docs)
    kept = {r.doc_id for r in M.mixed(docs).collect() if r.kept}
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in docs.collect() if r.doc_id in kept)


def test_sweeps_converge(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    few, many = ({(r.source, r.lang, r.topic): r.w for r in M.cells_of(docs, M.Targets(sweeps=n)).collect()} for n in (M.PRODUCTION.sweeps, 40))
    assert all(abs(few[c] / many[c] - 1) < 1e-3 for c in many)
    left = [{r.margin: r.residual for r in M.residuals(M.cells_of(docs, M.Targets(sweeps=n)), M.PRODUCTION).groupBy("margin").agg({"residual": "max"}).withColumnRenamed("max(residual)", "residual").collect()} for n in (1, M.PRODUCTION.sweeps)]
    assert max(left[1].values()) < 1e-3 and max(left[1].values()) < max(left[0].values())


def test_topics_of_ones_own(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, "cat " * (k % 5 + 1) if k % 4 else "dog run", "s", "en") for k in range(200)], "doc_id long, text string, source string, lang string")
    rows = M.mixed(docs, M.Targets(topic={"dogs": 0.6, "cats": 0.4}), lambda t: F.when(t.contains("dog"), "dogs").otherwise("cats")).collect()
    total = sum(r.weight for r in rows)
    assert sum(r.weight for r in rows if r.topic == "dogs") / total == pytest.approx(0.6, abs=1e-6)
