"""The registered corpus queries and the pipeline as a whole."""

from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from strandlake.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    got = queries.QUERIES[name](spark, str(DATA))
    want = con.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_stages_keep_columns_and_only_drop(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(DATA))
        assert after.columns == docs.columns
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids and ids <= kept and len(ids) >= 0.75 * len(kept), name
        assert name != "secrets" or ids == kept
        docs, kept = after, ids


def test_run_packs_what_is_left(spark):
    pieces = corpus_pipeline.run(spark, str(DATA)).toPandas()
    assert len(pieces) and pieces.groupby("doc_id").length.sum().eq(pieces.groupby("doc_id").doc_tokens.first()).all()
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048
