"""Queries with SQL give DuckDB's rows; every query reads its whole table; the pipeline's stages take odd inputs."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import queries
from tests.llm.conftest import CLASHES

duckdb = pytest.importorskip("duckdb")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    c.register("got", queries.QUERIES[name](spark, sf_dir).toArrow())
    c.execute(f"CREATE TEMP TABLE want AS {queries.ORACLE_SQL[name]}")
    listed = ", ".join(sorted(r[0] for r in c.execute("DESCRIBE want").fetchall()))
    assert c.execute(f"SELECT count(*) FROM ((SELECT {listed} FROM got EXCEPT ALL SELECT {listed} FROM want) UNION ALL (SELECT {listed} FROM want EXCEPT ALL SELECT {listed} FROM got))").fetchall()[0][0] == 0


def test_one_row_for_each_row(spark, sf_dir):
    for name, table in (("op1_secret_scan", "documents"), ("op4_license_scan", "documents"), ("op7_pii_pseudonyms", "documents"), ("op9_html_main_text", "pages"), ("op10_quality_classifier", "documents")):
        assert queries.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


@pytest.fixture(scope="module")
def strange(docs):
    """The documents with null ids, repeated rows and extra columns, but with the columns of the table first."""
    more = docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long"))
    rows = docs.unionByName(more).unionByName(docs.where("doc_id IN (4, 5)"))
    return rows.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, sf_dir, strange, empty, name, stage):
    out = stage(spark, strange, sf_dir)
    rows = out.collect()
    nulls = sum(r["doc_id"] is None for r in rows)
    if name == "best-fit packing":
        assert sum(r["piece"] == 0 for r in rows) == strange.count()
        assert stage(spark, empty, sf_dir).collect() == []
        return
    assert out.columns == strange.columns and len(rows) <= strange.count()
    if name != "quality classifier":
        assert nulls == 3  # rows without an id are no copies of one, and stay
    assert stage(spark, empty, sf_dir).collect() == []
