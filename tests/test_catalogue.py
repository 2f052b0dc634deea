"""Each query with SQL gives DuckDB's rows."""

import pytest

import __spark_entry__ as entry
from factloom.plans import catalogue

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sf_dir, duck, name):
    got = catalogue.QUERIES[name](spark, sf_dir).toArrow()
    duck.register("got", got)
    duck.execute(f"CREATE OR REPLACE TEMP TABLE want AS {catalogue.SQL[name]}")
    columns = sorted(got.column_names)
    assert columns == sorted(r[0] for r in duck.execute("DESCRIBE want").fetchall())
    listed = ", ".join(f'"{c}"' for c in columns)
    either = f"(SELECT {listed} FROM got EXCEPT ALL SELECT {listed} FROM want) UNION ALL (SELECT {listed} FROM want EXCEPT ALL SELECT {listed} FROM got)"
    assert duck.execute(f"SELECT count(*) FROM ({either})").fetchall()[0][0] == 0


def test_without_sql(spark, sf_dir):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.SQL)):
        assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() >= 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
