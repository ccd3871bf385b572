"""Every registered query with an oracle gives the oracle's rows."""

import math

import duckdb
import pytest

from eventide.plans.catalog import ORACLES, QUERIES

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{AT}/{t}.parquet'")
    return c


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    got = QUERIES[name](spark, AT)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=str)
    assert rows == sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=str)


def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    betas = [r.beta for r in rows if r.beta is not None]
    assert rows and betas == sorted(betas)
