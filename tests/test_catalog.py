"""Every catalogue query against its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from quillspark.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def normal(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.strftime("%F %T.%f")
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(normal(r[c]) for c in columns) for r in df.collect())
    if name not in catalog.ORACLES:
        assert got
        return
    result = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted(tuple(normal(r[i]) for i in at) for r in result.fetchall())


@pytest.mark.parametrize("name", ["movement_funnel", "digest_with_summaries", "dashboard_counts"])
def test_texts_are_read_once(spark, name):
    """What two parts of a result are made of is detected or scored once; the count of all items asks for no scores."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    got = plan(catalog.QUERIES[name](spark, SF))
    if name == "dashboard_counts":
        assert got.count("Generate ") == plan(catalog.QUERIES["strategic_signals"](spark, SF)).count("Generate ") > 0
    else:
        assert "parquet" not in got
