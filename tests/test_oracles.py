"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

from veilspark.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return round(float(v), 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    rel = duck.sql(catalogue.oracle_sql()[name])
    columns = sorted(df.columns)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in df.collect()) == want


def test_fakes_of_late_years(spark, tmp_path):
    """Some 416,000 fake dates reach the year 10000, which Spark writes with a plus sign; years before 1 are BC."""
    duckdb = pytest.importorskip("duckdb")
    ids = [0, 1, 416_050, 416_093, 416_100, 500_000, 3_000_000, -20, -105_800, -400_000]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.register("documents", spark.read.parquet(f"{tmp_path}/documents.parquet").toArrow())
    dated = lambda rows: sorted((i, fake) for label, i, fake in rows if label == "private_date")
    got = [(r["label"], r["i"], r["fake"]) for r in catalogue.queries()["faker_each_label"](spark, str(tmp_path)).collect()]
    assert dated(got) == dated(c.sql(catalogue.oracle_sql()["faker_each_label"]).fetchall())
