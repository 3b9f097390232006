"""Registered queries against their SQL on the smallest tables."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return float(v) if isinstance(v, (int, float)) else str(v)


def names():
    import sys

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from quire.plans.queries import ORACLES

    return sorted(ORACLES)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", names())
def test_matches_sql(spark, duck, name):
    from quire.plans.queries import ORACLES, QUERIES

    got = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(rel.columns)
    at = [rel.columns.index(c) for c in order]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr) == expected


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_labelled_texts_move_no_words(spark, tmp_path):
    from quire.plans.queries import QUERIES

    run = QUERIES["labelled_text_round_trip"]
    assert "Exchange" not in run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    rows = [(1, "one 2 two three"), (1, "four"), (2, "7 8"), (None, "five")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {(r.doc_id, r.n, r.tagged) for r in run(spark, str(tmp_path)).collect()} == {(1, 4, 1), (None, 1, 0)}
