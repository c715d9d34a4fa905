"""Tests of the findings of round 3."""

import duckdb
from pyspark.sql import functions as F

from inkgauge.operators import stats
from inkgauge.plans import report_oracles, report_queries


def _with_empty(spark, data, folder):
    """The documents and two without words, as a folder of tables."""
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(20)
    empty = docs.limit(2).withColumn("doc_id", F.col("doc_id") + 10_000_000).withColumn("text", F.lit(" \n ")).withColumn("n_chars", F.lit(3).cast(docs.schema["n_chars"].dataType))
    docs.unionByName(empty).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_expressions_have_no_time_where_documents_have_no_words(spark, data, tmp_path):
    folder = _with_empty(spark, data, tmp_path)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
        want = db.execute(report_oracles.ORACLE_SQL["score_latency"]).fetchall()
    found = [tuple(r) for r in report_queries.score_latency(spark, folder).collect()]
    assert sorted(found) == sorted(want) and ("expression", 0, False, True) in found


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange SinglePartition") + df._jdf.queryExecution().executedPlan().toString().count("TakeOrdered")


def test_large_samples_do_not_meet_in_one_task(spark, monkeypatch):
    """Also where equal keys stand at the edge, and for null and empty keys, which have the same hash."""
    keys = [None if k % 50 == 0 else "" if k % 50 == 1 else str(k % 300) for k in range(1000)]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, i int").repartition(3)
    assert not _exchanges(stats.seeded_sample(df, "key", 2_000_000_000))
    for n in (1, 17, 500, 999, 1000, 5000):
        want = sorted(str(r.key) for r in stats.seeded_sample(df, "key", n, 3).collect())
        monkeypatch.setattr(stats, "FEW", 0)
        found = sorted(str(r.key) for r in stats.seeded_sample(df, "key", n, 3).collect())
        monkeypatch.undo()
        assert found == want and len(found) == min(n, 1000)


def test_chunk_lines_clean_texts_once(spark, data):
    """No filter inferred from the generator repeats the cleaning below it."""
    plan = report_queries.chunk_lines(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    once = report_queries.card_lines(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</think>") == once.count("</think>") > 0


def test_draws_are_not_written_out_row_by_row(spark, monkeypatch):
    """Intervals of scores with few values come from vectors, the same ones as by grouping."""
    rows = [(k, k % 4, (k * 7) % 5 % 4, (k * 37 % 101) / 101, (k * 13 % 17) / 17) for k in range(60)]
    df = spark.createDataFrame(rows, "sample_id bigint, gt_bucket int, model_bucket int, model_score double, cosine_score double").repartition(3)
    told = lambda: {r.stat: (round(r.low, 9), round(r.high, 9)) for r in stats.bootstrap_cis(df, n_boot=12, seed=3).collect()}
    if hasattr(stats, "VALUES"):
        monkeypatch.setattr(stats, "VALUES", 5)
    grouped = told()
    monkeypatch.undo()
    monkeypatch.setattr(stats, "resampled", None)
    assert told() == grouped and len(grouped) == 5
