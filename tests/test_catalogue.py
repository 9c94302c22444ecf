"""Every catalogue query against its SQL twin on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")

from admitflow.operators import metrics
from admitflow.plans import catalogue


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    sql = catalogue.oracles().get(name)
    if sql is None:
        assert got
        return
    assert got == sorted(tuple(map(plain, r)) for r in duck.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({sql}) q").fetchall())


def test_bootstrap_ci_is_the_whole_operator(spark, duck):
    got = catalogue.queries()["bootstrap_ci"](spark, SF).first()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert got.asDict().keys() == {"mean", "low", "high"}
    assert round(got["mean"], 9) == round(duck.sql("SELECT avg(quality) FROM labels").fetchall()[0][0], 9)
    assert (got.low, got.high) == tuple(metrics.bootstrap_interval(labels, "quality", 2000, 0.95, 7).first())
