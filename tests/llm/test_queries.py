"""The registered queries: SQL twins where they exist, and the pipeline."""

import duckdb
import pytest

from inkgauge.llm.queries import ORACLE_SQL, QUERIES

from .conftest import DOCS, awkward_rows


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    found = QUERIES[name](spark, data)
    cursor = con.execute(ORACLE_SQL[name])
    order = [c[0] for c in cursor.description]
    assert sorted(order) == sorted(found.columns)
    assert sorted(map(str, map(tuple, found.select(order).collect()))) == sorted(map(str, cursor.fetchall()))


def test_all_ten_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


def test_pipeline_stages_on_awkward_rows(spark, docs, empty, data):
    import corpus_pipeline

    for first in (docs, empty):
        table = first
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, data)
            assert out.columns == first.columns, name
            table = spark.createDataFrame(out.collect(), DOCS)
        packed = corpus_pipeline.STAGES[-1][1](spark, table, data).collect()
        ids = {r.doc_id for r in packed}
        assert ids == {r.doc_id for r in table.collect()}
    kept = {d for d, *_ in awkward_rows()} - {5, 6, 7, 11}
    assert ids <= kept


def test_pipeline_runs(spark, data):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, data)
    assert found.count() > 0 and corpus_pipeline.ORACLE_SQL is None
