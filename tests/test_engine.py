"""The scoring and evaluation engine against plain versions, boundary tables and SQL."""

import json
import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkgauge.functions import numeric, text
from inkgauge.operators import bands, detect, prose, stats, windows
from inkgauge.plans import evaluate
from inkgauge.plans import oracles, queries, report_oracles, report_queries
from inkgauge.plans.score import score_targets
from inkgauge.scorers import BatchScorer, LengthStub, ScorerUnavailableError, chosen_scorer, decode_numpy, run_with_backoff, transformer_scorer
from inkgauge.sinks import report, tables
from inkgauge.sources import documents, references


QUERIES = queries.QUERIES | report_queries.QUERIES
ORACLE_SQL = oracles.ORACLE_SQL | report_oracles.ORACLE_SQL


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


# --- SQL twins ---------------------------------------------------------------------------------------------------------


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6))
    return a == b


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for table in ("documents", "labels", "embeddings", "conversations", "events", "lineitem", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    found = QUERIES[name](spark, data)
    cursor = con.execute(ORACLE_SQL[name])
    order = [c[0] for c in cursor.description]
    assert sorted(order) == sorted(found.columns)
    key = lambda r: [(v is None, str(round(v, 3) if isinstance(v, float) else v)) for v in r]
    ours, theirs = sorted(map(tuple, found.select(order).collect()), key=key), sorted(cursor.fetchall(), key=key)
    assert len(ours) == len(theirs)
    assert all(same(a, b) for x, y in zip(ours, theirs) for a, b in zip(x, y))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


# --- text --------------------------------------------------------------------------------------------------------------

CLEAN = [
    ("Hello  World\n", "hello world"),
    ("Sure, here you go:\nText one.\n\nText two.", "text one. text two."),
    ("**Title: x\nbody", "body"),
    ("Surely not\nbody", "body"),
    ("Sure only one line", "sure only one line"),
    ("sure\nlower case stays", "sure lower case stays"),
    ("I'm happy to help!\nA", "a"),
    ("\n\nHere\n\n\nB\n", "b"),
    ("✨ Sure\nfoo", ":sparkles: sure foo"),
    ("a</think> b ", "b"),
    ("a</think> b </think> c", "b"),
    ("a</think>", ""),
    ("", ""),
    (" \t\n\x1c  　", ""),
    ("x y z\x1fw\x85v", "x y z w v"),
    ("I ❤️ it", "i :red_heart: it"),
    ("ΑΣ", "ας"),
    (None, None),
]


@pytest.mark.parametrize("raw, want", CLEAN)
def test_clean_text(spark, raw, want):
    assert one(spark, text.clean_text("x"), raw) == want


def test_white_space_is_pythons(spark):
    points = [c for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "c int, x string")
    ours = {r.c for r in df.select("c", text.normalize_whitespace("x").alias("y")).filter("y = 'a b'").collect()}
    assert ours == {c for c in points if chr(c).isspace()}


MARKED = [
    "---\nkey: v\n---\nbody",
    "x\n---\nkey: v\n---\nbody",
    "a\n```py\ncode\n```\nb\n  ~~~\nc\n~~~\nd",
    "open\n```\nnever closed",
    "```\na\n~~~\nb\n```\nc",
    "# One\r\nb\n## Two\n### Three\n#none",
    "x <IMAGE src='a'/> y <image> z <imagery>",
    "  \x1c pad 　",
    None,
]


@pytest.mark.parametrize("raw", MARKED)
def test_generic_strip(spark, raw):
    want = re.sub(r"\A---\n.*?\n---\n", "", raw or "", flags=re.S)
    want = re.sub(r"^[ \t]*(```|~~~).*?^[ \t]*\1[ \t]*$", "", want, flags=re.S | re.M)
    want = re.sub(r"^[ \t]*#{1,2}[ \t].*$", "", want, flags=re.M)
    want = re.sub(r"<image\b[^>]*/?>", "", want, flags=re.I).strip()
    assert one(spark, text.generic_strip("x"), raw) == want


def test_count_words_and_preview(spark):
    assert one(spark, text.count_words("x"), "a_1 b-c, d'e") == 5
    assert one(spark, text.preview("x", 5), " a\n\nb cdef") == "a b c"
    assert one(spark, text.preview("x"), None) == ""


# --- numbers -----------------------------------------------------------------------------------------------------------


def test_rounding_is_exact(spark):
    rng = random.Random(0)
    values = [0.62505, 0.12345, 0.00015, 0.5, 1.5, 2.5, 0.1015, 0.00005, 1.0, 0.0] + [round(rng.random(), 5) for _ in range(3000)] + [rng.random() for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", numeric.round_exact("x", 4).alias("a"), numeric.round_exact("x", 3).alias("b"))
    assert all(r.a == round(r.x, 4) and r.b == round(r.x, 3) for r in df.collect())


BUCKETS = [(0.0, 0), (0.029, 0), (0.03, 0), (0.05, 1), (0.089, 1), (0.09, 2), (0.149, 2), (0.15, 3), (0.30, 3), (1.0, 3)]


@pytest.mark.parametrize("score, want", BUCKETS)
def test_buckets(spark, score, want):
    assert one(spark, numeric.score_to_bucket("x"), score, "double") == want


@pytest.mark.parametrize("score, n, want", [(0.05, 3, 0), (0.5, 3, 1), (0.95, 3, 2), (0.05, 2, 0), (0.5, 2, 1), (0.95, 2, 1)])
def test_custom_buckets(spark, score, n, want):
    assert one(spark, numeric.score_to_bucket("x", low=0.1, high=0.9, n_buckets=n), score, "double") == want


def test_decoding(spark):
    logits = [[0.0, 0.0, 0.0, 0.0], [5.0, 1.0, 5.0, 0.0], [-800.0, 0.0, 800.0, 1.0]]
    df = spark.createDataFrame([(x,) for x in logits], "x array<double>").withColumn("p", numeric.softmax("x"))
    found = df.select("p", numeric.expected_score("p").alias("s"), numeric.confidence("p").alias("c"), numeric.argmax("p").alias("b")).collect()
    for row, want in zip(found, decode_numpy(np.array(logits), [1, 1, 9], 5)):
        assert np.allclose(row.p, want["probs"]) and math.isclose(row.s, want["score"]) and row.b == want["bucket"]
        assert math.isclose(row.c, want["confidence"], abs_tol=1e-12)
    assert found[0].s == 0.5 and abs(found[0].c) < 1e-12 and found[1].b == 0
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="non-finite"):
            one(spark, numeric.softmax("x"), [0.0, bad], "array<double>")


def test_fixed_and_percent(spark):
    assert one(spark, numeric.fixed("x"), None, "double") == "—" == one(spark, numeric.fixed("x"), float("nan"), "double")
    assert one(spark, numeric.percent("x"), 0.625, "double") == 62


# --- bands -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("score, want", [(0.0, "human"), (0.29, "human"), (0.30, "lightly edited"), (0.75, "heavily edited"), (0.95, "fully AI"), (1.0, "fully AI"), (None, None)])
def test_band_of(spark, score, want):
    assert one(spark, bands.band_label("x"), score, "double") == want
    if score is not None:
        assert bands.band_for(score).label == want


ARTIFACT = {"version": 1, "kind": bands.KIND, "cuts": [{"lt": x, "band": f"b{k}"} for k, x in enumerate((0.2, 0.4, 0.6, 0.8))], "top_band": "top"}


def test_artifact():
    table = bands.bands_from_artifact(ARTIFACT)
    assert [b.label for b in table] == ["b0", "b1", "b2", "b3", "top"] and bands.band_for(0.4, table).label == "b2"
    assert [b.colour for b in table] == list(bands.COLOURS)
    for change in ({"kind": "x"}, {"version": 2}, {"degenerate": True}, {"cuts": ARTIFACT["cuts"][:3]}, {"cuts": ARTIFACT["cuts"][::-1]}):
        with pytest.raises(ValueError):
            bands.bands_from_artifact(ARTIFACT | change)


# --- windows and detection ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n, want", [(0, []), (1, [1]), (49, [49]), (350, [350]), (351, [350, 1]), (725, [350, 350, 25])])
def test_windows(spark, n, want):
    df = spark.createDataFrame([(1, ["alpha"] * n)], "id int, w array<string>").withColumn("windows", windows.window_array("w"))
    rows = windows.explode_windows(df, "id").orderBy("index").collect()
    assert [r.n_words for r in rows] == want
    assert [r.word_start for r in rows] == [350 * k for k in range(len(want))] and sum(r.word_end - r.word_start for r in rows) == n


def plain_detect(raw, scale=1000):
    w = re.sub(r"\s+", " ", raw.lower()).strip().split()
    chunks = [" ".join(w[i : i + 350]) for i in range(0, len(w), 350)]
    if not chunks:
        return 0.0, "unreliable", 0, 0, None
    scores = [round(min(1.0, len(c) / scale), 4) for c in chunks]
    sizes = [len(c.split()) for c in chunks]
    mean = sum(s * n for s, n in zip(scores, sizes)) / sum(sizes)
    band = bands.band_for(mean).label if len(w) >= 50 else "unreliable"
    return round(mean, 4), band, round(mean * 3), len(w), scores.index(max(scores))


@pytest.mark.parametrize("parts", [1, 7])
def test_detect_equals_plain(spark, parts):
    rng = random.Random(4)
    texts = ["", "   ", "x", " ".join(["tie"] * 700)] + [" ".join("ab" * rng.randint(1, 3) for _ in range(rng.choice([30, 49, 50, 360, 705]))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(parts)
    found = {r.doc_id: r for r in detect.detect(df, LengthStub(1000)).collect()}
    for k, raw in enumerate(texts):
        r = found[k]
        assert (r.score, r.band, r.bucket, r.n_words, r.most_ai_chunk) == plain_detect(raw)
        assert r.reliable == (r.n_words >= 50) and r.n_chunks == len(r.chunks)
    assert found[3].most_ai_chunk == 0


def test_detect_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "w", 7, "p"), (2, None, "x", 8, "q")], "doc_id int, text string, windows string, scores int, preview string")
    found = detect.detect(df, LengthStub()).orderBy("doc_id").collect()
    assert [(r.windows, r.scores, r.preview, r.n_words) for r in found] == [("w", 7, "a b", 2), ("x", 8, "", 0)]


def test_filter_on_results_stays_cheap(spark, data):
    """A filter on a result may move below the projections; the cleaning must not multiply."""
    df = detect.detect(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text"), LengthStub()).filter("score > 0.1 AND band <> 'x'")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</think>") < 40


def test_batch_scorer_equals_expression(spark):
    def load():
        def forward(texts):
            s = [min(1.0, len(t) / 1000) for t in texts]
            return [{"score": x, "bucket": round(x * 3), "probs": [1 - x, 0.0, 0.0, x], "confidence": 0.9, "truncated": False} for x in s]

        return forward

    scorer = BatchScorer(load, key="test", name="stub", width=3)
    df = spark.createDataFrame([(k, " ".join(["word"] * n)) for k, n in enumerate((0, 3, 60, 400, 800))], "doc_id int, text string").repartition(2)
    timed = detect.detect(df, scorer, with_latency=True).orderBy("doc_id")
    assert [r.latency_s > 0 for r in timed.collect()] == [False, True, True, True, True]
    a = timed.drop("latency_s").select(*detect.detect(df, scorer).columns).collect()
    assert a == detect.detect(df, LengthStub(1000)).orderBy("doc_id").collect()


def test_backoff():
    seen = []

    def forward(batch):
        seen.append(len(batch))
        if len(batch) > 2:
            raise RuntimeError("CUDA out of memory")
        return [x.upper() for x in batch]

    assert run_with_backoff(forward, list("abcdefg"), 8) == list("ABCDEFG")
    assert seen == [7, 4, 2, 2, 2, 1]
    with pytest.raises(RuntimeError, match="memory"):
        run_with_backoff(lambda b: (_ for _ in ()).throw(RuntimeError("out of memory")), ["a"], 1)
    with pytest.raises(RuntimeError, match="other"):
        run_with_backoff(lambda b: (_ for _ in ()).throw(RuntimeError("other")), ["a", "b"], 2)


def test_missing_model(spark):
    with pytest.raises(ScorerUnavailableError):
        transformer_scorer("nothing/here").load()


def test_weighted_probs(spark):
    chunks = [(1, [1.0, 0.0]), (3, [0.0, 1.0])]
    kind = "array<struct<n_words:int,probs:array<double>>>"
    assert one(spark, detect.weighted_probs("x"), chunks, kind) == [0.25, 0.75]
    assert one(spark, detect.weighted_probs("x"), [], kind) == []


# --- sources, routing, gate --------------------------------------------------------------------------------------------

REFS = {
    "ok": [{"source": "s1", "label": "", "content": "# T\nbody", "prose": None}],
    "two": [{"source": "s2", "label": "l2", "prose": "p " * 60, "prose_authors": ["a", "b"]}, {"source": "", "prose": ""}],
    "bad": [{"label": "l4", "prose": "x", "metadata": {"transcript_error": "boom"}}],
    "none": [],
}


def test_targets_keep_order(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes(b"caf\xe9 " + b"word " * 60)
    documents.register_resolver(REFS.get)
    try:
        found = score_targets(documents.from_targets(spark, ["two", str(path), "none", "bad", "ok"]), LengthStub()).orderBy("ordinal").collect()
        split = score_targets(documents.from_targets(spark, ["two"], split=True), LengthStub()).collect()
    finally:
        documents.register_resolver(None)
    assert [r.label for r in found] == ["l2", "<ref>", str(path), "l4", "s1"]
    assert [r.reason for r in found] == ["2 authors (pass --split)", "no prose", None, "transcription failed", None]
    assert found[2].preview.startswith("caf� word") and found[2].reliable and found[4].preview == "body"
    assert split[0].n_words == 60 and all(r.score is None for r in found if r.skipped)
    with pytest.raises(documents.ResolverMissingError):
        documents.from_targets(spark, ["http://x"])


def test_files_and_reference_format(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes(b"two\xff")
    (tmp_path / "a.txt").write_text("one")
    assert [r.text for r in documents.from_files(spark, [str(tmp_path / "*.txt")]).orderBy("ordinal").collect()] == ["one", "two�"]
    table = {k: v for k, v in REFS.items()}
    references.register(spark, lambda t: table[t])
    rows = spark.read.format("references").option("targets", json.dumps(["two", "none", "ok"])).load().orderBy("target", "doc").collect()
    assert [(r.target, r.doc, r.source) for r in rows] == [(0, 0, "s2"), (0, 1, ""), (2, 0, "s1")]


@pytest.mark.parametrize("rows, code", [([(0.9, True, False)], 3), ([(0.5, True, False)], 0), ([(None, None, True)], 4), ([(0.9, False, False)], 4)])
def test_gate(spark, rows, code):
    df = spark.createDataFrame(rows, "score double, reliable boolean, skipped boolean")
    assert detect.gate(df, 0.5).first()["exit_code"] == code


def test_labeled_samples(spark):
    df = spark.createDataFrame([(1, "w " * 80, 0.01, None), (2, "w " * 80, 0.07, "s"), (3, "a b", 0.2, None)], "doc_id int, text string, cosine_score double, source_text string")
    found = documents.labeled_samples(df, 10, key="doc_id").orderBy("sample_id").collect()
    assert [(r.gt_bucket, r.n_words) for r in found] == [(0, 80), (1, 80), (3, 2)]
    assert documents.labeled_samples(df, 2, key="doc_id", seed=1).count() == 2


# --- statistics --------------------------------------------------------------------------------------------------------


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns)).repartition(3)


def test_ranks_and_spearman(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 20, 300).astype(float), rng.random(300).round(1)
    df = frame(spark, x=x, y=y)
    ranks = stats.average_ranks(df, "x").toPandas()
    assert (ranks["rank"] == ranks["x"].rank()).all()
    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    assert math.isclose(stats.spearman(df, "x", "y").first()["spearman"], want, abs_tol=1e-9)
    assert stats.spearman(frame(spark, x=[1.0, 1.0], y=[1.0, 2.0]), "x", "y").first()["spearman"] is None
    assert stats.spearman(frame(spark, x=[1.0], y=[1.0]), "x", "y").first()["spearman"] is None


def test_auroc_equals_pairs(spark):
    rng = np.random.default_rng(2)
    s, p = rng.random(120).round(1), rng.random(120) < 0.4
    want = np.mean([(a > b) + 0.5 * (a == b) for a in s[p] for b in s[~p]])
    found = stats.auroc(frame(spark, s=s, p=p), "s", F.col("p")).first()
    assert math.isclose(found["auroc"], want) and found["n_pos"] == p.sum()
    assert stats.auroc(frame(spark, s=[0.1], p=[True]), "s", F.col("p")).first()["auroc"] is None


def test_describe_and_thresholds(spark):
    d = stats.describe(frame(spark, x=[0.1, 0.2, 0.2, 0.4, 0.9]), "x").first()
    assert d["n"] == 5 and math.isclose(d["q90"], np.percentile([0.1, 0.2, 0.2, 0.4, 0.9], 90)) and d["median"] == 0.2
    assert stats.describe(frame(spark, x=[1.0]).filter("x > 2"), "x").first().asDict() == {k: 0 if k == "n" else None for k in d.asDict()}
    counts = {r.threshold: r["count"] for r in stats.threshold_counts(frame(spark, x=[0.05, 0.10, 0.41, 0.5, 0.95]), "x").collect()}
    assert counts == {0.10: 4, 0.40: 3, 0.50: 2, 0.70: 1, 0.90: 1}


def test_confusion(spark):
    df = frame(spark, gt=[0, 0, 1, 2, 3, 3], pred=[0, 1, 1, 2, 3, 2])
    cells = {(r.gt, r.pred): r.n for r in stats.confusion(df, "gt", "pred").collect()}
    assert len(cells) == 16 and cells[0, 1] == 1 and cells[3, 2] == 1 and sum(cells.values()) == 6
    with pytest.raises(Exception, match="out of range"):
        stats.confusion(frame(spark, gt=[4], pred=[0]), "gt", "pred").collect()


def test_sweep(spark):
    found = stats.balanced_accuracy_sweep(frame(spark, s=[0.0, 0.1, 0.2, 0.8, 0.9, 1.0], p=[False] * 3 + [True] * 3), "s", F.col("p"))
    assert found["bal_acc"] == 1 and found["plateau"] == [0.21, 0.8] and (found["tp"], found["fp"]) == (3, 0)
    assert found["threshold"] == round(float(np.median([0.21 + 0.01 * k for k in range(60)])), 4)
    assert stats.balanced_accuracy_sweep(frame(spark, s=[0.1], p=[True]), "s", F.col("p")) is None
    rng = np.random.default_rng(5)
    s, p = rng.integers(0, 101, 500) / 100, rng.random(500) < 0.5
    grid = np.round(np.arange(0, 1 + 1e-9, 0.01), 4)
    bal = np.array([((s[p] >= t).mean() + (s[~p] < t).mean()) / 2 for t in grid])
    found = stats.balanced_accuracy_sweep(frame(spark, s=s, p=p), "s", F.col("p"))
    assert found["threshold"] == round(float(np.median(grid[np.isclose(bal, bal.max(), rtol=0, atol=1e-15)])), 4)


def scored(spark, gt, score, bucket):
    n = len(gt)
    cosine = [(0.01, 0.06, 0.12, 0.30)[g] for g in gt]
    probs = [[float(b == k) for k in range(4)] for b in bucket]
    return spark.createDataFrame(
        list(zip(range(n), [f"t{i}" for i in range(n)], [100] * n, [True] * n, cosine, gt, score, bucket, bucket, probs, [0.1] * n)),
        "sample_id long, preview string, n_words int, reliable boolean, cosine_score double, gt_bucket int, model_score double, model_bucket int, model_bucket_argmax int, probs array<double>, latency_s double",
    ).persist()


def test_metrics_of_perfect_rows(spark):
    gt = [0, 1, 2, 3] * 4
    m = evaluate.dataset_metrics(scored(spark, gt, [(0.05, 0.30, 0.60, 0.92)[g] for g in gt], gt), n_boot=50)
    assert m["bucket_accuracy"] == 1 == m["auroc_human"] and m["bucket_mae"] == 0 and m["worst_disagreements"] == []
    assert math.isclose(m["spearman_score"], 1) and m["ece_argmax"] == 0 and m["confusion"][2][2] == 4
    assert m["cis"]["bucket_accuracy"] == [1, 1] and set(m["per_gt_score"]) == set("0123")
    again = evaluate.dataset_metrics(scored(spark, gt, [(0.05, 0.30, 0.60, 0.92)[g] for g in gt], gt), n_boot=50)
    assert again == m


def test_metrics_of_nothing(spark):
    m = evaluate.dataset_metrics(scored(spark, [0], [0.1], [0]).filter("sample_id < 0"))
    assert m["n"] == 0 and m["bucket_accuracy"] is None and m["confusion"] == [[0] * 4] * 4


def test_bands_from_classes(spark):
    gt = [0] * 6 + [1] * 6 + [2] * 6 + [3] * 6
    good = evaluate.propose_bands(scored(spark, gt, [(0.05, 0.30, 0.60, 0.92)[g] for g in gt], gt), n_boot=20)
    cuts = [b["cut"] for b in good["boundaries"]]
    assert cuts == sorted(cuts) and not good["degenerate"] and [b["pinned"] for b in good["boundaries"]] == [True, True, False, True]
    bad = evaluate.propose_bands(scored(spark, [0] * 6 + [3] * 6, [0.9] * 6 + [0.05] * 6, [3] * 6 + [0] * 6), n_boot=0)
    assert bad["degenerate"]
    none = evaluate.propose_bands(scored(spark, [0], [0.1], [0]), n_boot=0)
    assert [b["cut"] for b in none["boundaries"]] == [0.3, 0.55, 0.725, 0.9] and not any(b["pinned"] for b in none["boundaries"])


def test_compare_scores(spark):
    schema = "k int, model_score double, model_bucket int, reliable boolean"
    a = spark.createDataFrame([(1, 0.05, 0, True), (2, 0.5, 2, False), (3, 0.9, 3, True)], schema)
    b = spark.createDataFrame([(1, 0.10, 0, True), (2, 0.5, 2, False), (3, 0.7, 2, True)], schema)
    r = stats.compare_scores(a, b, "k").first()
    assert r["n"] == 2 and math.isclose(r["score_mae"], 0.125) and math.isclose(r["max_delta"], 0.2) and r["bucket_flip_rate"] == 0.5


def test_bootstrap_equals_plain_resampling(spark):
    """Intervals over the same draws, taken by plain loops."""
    import hashlib

    rng, n, draws = np.random.default_rng(8), 60, 40
    gt, score = rng.integers(0, 4, n), rng.random(n).round(2)
    cosine, bucket = rng.random(n).round(1), np.clip((score * 4).astype(int), 0, 3)
    df = spark.createDataFrame(list(zip(range(n), gt.tolist(), bucket.tolist(), score.tolist(), cosine.tolist())), "sample_id long, gt_bucket int, model_bucket int, model_score double, cosine_score double")
    found = {r.stat: (r.low, r.high) for r in stats.bootstrap_cis(df.repartition(3), n_boot=draws, seed=5).collect()}
    assert found == {r.stat: (r.low, r.high) for r in stats.bootstrap_cis(df, n_boot=draws, seed=5).collect()}
    values = {k: [] for k in found}
    for draw in range(draws):
        chance = [int(hashlib.md5(f"5:{draw}:{k}".encode()).hexdigest()[:8], 16) / 2**32 for k in range(n)]
        at = np.repeat(np.arange(n), [sum(p <= u for p in stats.POISSON) for u in chance])
        g, s, b = gt[at], score[at], bucket[at]
        area = lambda p: (pd.Series(s).rank()[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())  # noqa: B023, E731
        values["bucket_accuracy"].append((g == b).mean())
        values["adjacent_accuracy"].append((abs(g - b) <= 1).mean())
        values["spearman_score"].append(np.corrcoef(pd.Series(s).rank(), pd.Series(cosine[at]).rank())[0, 1])
        values["auroc_human"].append(area(g >= 1))
        values["auroc_top"].append(area(g == 3))
    for stat, ends in found.items():
        assert np.allclose(ends, np.percentile(values[stat], [2.5, 97.5]), atol=1e-9), stat
    cuts = {r.stat: (r.low, r.high) for r in stats.bootstrap_cuts(df, {"human": 1, "top": 3}, n_boot=10, seed=5).collect()}
    assert set(cuts) == {"human", "top"} and all(0 <= low <= high <= 1 for low, high in cuts.values())


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(6)
    for values in (rng.random(1000), rng.integers(0, 5, 777) / 4.0, np.array([3.5])):
        shares = [0, 0.05, 0.5, 0.95, 1]
        assert np.allclose(stats.percentiles(frame(spark, x=values), "x", shares), np.percentile(values, [100 * p for p in shares]))
    assert stats.percentiles(frame(spark, x=[1.0]).filter("x > 2"), "x", [0.5]) == [None]


def test_hot_keys_are_split(spark):
    """A third of all rows with one key: the join's tasks stay small, and no row is lost."""
    from inkgauge.operators.skew import split_join

    rows = spark.range(30000).selectExpr("if(id % 3 = 0, 0, id) AS a", "id AS b")
    table = spark.range(30000).selectExpr("id AS a", "concat('w', id) AS w")
    found = split_join(rows, table, "a", "b", 30000)
    assert found.count() == 30000 and found.filter("w <> concat('w', a)").count() == 0


# --- evaluation and views ----------------------------------------------------------------------------------------------


def test_eval_dataset_and_views(spark, data, tmp_path):
    df = spark.read.parquet(f"{data}/documents.parquet").withColumn("cosine_score", F.col("n_chars") % 20 / 100).withColumn("source_text", F.col("text"))
    samples = documents.labeled_samples(df, 60, key="doc_id").persist()
    found = evaluate.eval_dataset(samples, LengthStub(2500), against=LengthStub(5000, name="other"), with_source=True, n_boot=20)
    assert found["n_used"] <= found["n_total"] == 60 and found["compare"]["n"] == found["n_used"] and found["latency"]["words_per_s"] > 0
    shown = report.report_view(found)
    assert "bucket_accuracy" in shown and "label_b" in shown and "source_control.frac_bucket0" in shown and " to " in shown
    assert json.loads(report.to_json(found))["mode"] == "dataset"
    assert report.benchmark_view(found, "cmd").count("\n") == 4
    if not found["bands"]["degenerate"]:
        tables.write_bands(evaluate.bands_artifact(found), str(tmp_path / "bands.json"))
        assert len(bands.bands_from_artifact(tables.read_bands(str(tmp_path / "bands.json")))) == 5


def test_gradient_and_references(spark, tmp_path):
    names = ["a.txt", "b.txt", "c.txt"]
    for k, n in enumerate(names):
        (tmp_path / n).write_text("word " * (60 + 60 * k))
    probe = evaluate.gradient_probe(documents.gradient_samples(spark, str(tmp_path), names), LengthStub(1000))
    assert probe["passed"] and math.isclose(probe["spearman_order"], 1) and "passed: yes" in report.report_view(probe)
    with pytest.raises(FileNotFoundError):
        documents.gradient_samples(spark, str(tmp_path), ["missing"])
    results = score_targets(documents.from_targets(spark, [str(tmp_path / n) for n in names]), LengthStub(1000))
    found = evaluate.eval_references(results)
    assert found["n_scored"] == 3 and len(found["by_source"]) == 3 and "by_source:" in report.report_view(found)


ENTRY = {
    "label": "doc", "score": 0.62, "band": "moderately edited", "bucket": 2, "n_words": 400, "n_chunks": 2, "reliable": True, "confidence": 0.8,
    "truncated": True, "model": "stub", "calibrated": False, "most_ai_chunk": 1, "skipped": False, "reason": None, "preview": "p",
    "chunks": [
        {"index": 0, "score": 0.2, "band": "human", "n_words": 350, "word_start": 0, "word_end": 350, "confidence": 0.5, "truncated": False, "preview": "x" * 99},
        {"index": 1, "score": 0.9, "band": "fully AI", "n_words": 50, "word_start": 350, "word_end": 400, "confidence": 0.9, "truncated": True, "preview": "y"},
    ],
}
SKIPPED = {k: None for k in ENTRY} | {"label": "gone", "skipped": True, "reason": "no prose"}


CHUNKS = "array<struct<index:int,score:double,band:string,n_words:int,word_start:int,word_end:int,confidence:double,truncated:boolean,preview:string>>"
SHOWN = "ordinal long, label string, score double, band string, bucket int, n_words int, n_chunks int, reliable boolean, confidence double, truncated boolean, model string, calibrated boolean, most_ai_chunk int, skipped boolean, reason string, preview string"


def entries(spark, *rows):
    return spark.createDataFrame([{"ordinal": k} | r for k, r in enumerate(rows)], f"{SHOWN}, chunks {CHUNKS}")


def test_views(spark):
    card = report.view(entries(spark, ENTRY), "card")
    assert "62%" in card and "number 1 at 90%" in card and all(report.NOTES[x] in card for x in ("truncated", "uncalibrated"))
    gone = entries(spark, SKIPPED)
    assert "no prose" in report.view(gone, "card") and report.view(gone, "chunks") == ""
    lines = report.view(entries(spark, ENTRY, SKIPPED, ENTRY | {"reliable": False}), "list").split("\n")
    assert "uncalibrated" in lines[0] and "no prose" in lines[1] and "unreliable" in lines[2] and len(lines) == 3
    chunks = report.view(entries(spark, ENTRY), "chunks")
    assert "truncated" in chunks and "x" * 60 in chunks and "x" * 61 not in chunks
    diff = report.view(entries(spark, ENTRY, SKIPPED, ENTRY | {"score": 0.82}), "diff")
    assert "(+20 points)" in diff and diff.count("points") == 1
    table = report.view(entries(spark, ENTRY, SKIPPED, ENTRY | {"score": 0.6}), "md", deltas=True).split("\n")
    assert table[2].endswith("|  | truncated |") and table[3] == "| gone | — | — | — | — | skipped: no prose |" and "| -2 |" in table[4]
    wire = json.loads(report.view(entries(spark, ENTRY), "jsonl"))
    assert "preview" not in wire and wire["chunks"][1]["preview"] == "y"


def test_model_runs_once_over_targets(spark):
    """A counting model sees each window once: results are not sorted behind it."""
    seen = spark.sparkContext.accumulator(0)

    def load():
        def forward(texts):
            seen.add(len(texts))
            return [{"score": 0.5, "bucket": 1, "probs": [0.5, 0.5, 0.0, 0.0], "confidence": 0.5, "truncated": False} for _ in texts]

        return forward

    targets = spark.range(400).selectExpr("id AS ordinal", "'r' AS ref", "'s' AS source", "'l' AS label", "repeat('word ', 60) AS text", "CAST(NULL AS string) AS reason")
    score_targets(targets, BatchScorer(load, key=str(id(seen)), name="counting")).write.format("noop").mode("overwrite").save()
    assert seen.value == 400


def test_only_one_kind_is_calibrated(tmp_path):
    for kind in ("llama", "roberta"):
        (tmp_path / kind).mkdir()
    made = {m: chosen_scorer(m, checkpoints=str(tmp_path)) for m in ("auto", "llama", "roberta", "stub")}
    assert {m: s.calibrated for m, s in made.items()} == {"auto": False, "llama": True, "roberta": False, "stub": True}
    with pytest.raises(FileNotFoundError, match="checkpoint"):
        chosen_scorer("auto", checkpoints=str(tmp_path / "none"))


def test_jsonl_writes_nulls(spark, tmp_path):
    df = score_targets(documents.from_text(spark, ""), LengthStub())
    tables.write_jsonl(df, str(tmp_path / "out"))
    (row,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert row["most_ai_chunk"] is None and row["source"] is None and "preview" not in row and row["chunks"] == []


def test_label_and_delta(spark):
    df = spark.createDataFrame([(1, None), (2, 0.5), (3, 0.7)], "ordinal int, score double")
    assert [r.delta and round(r.delta) for r in prose.delta_from_first(df, order="ordinal").orderBy("ordinal").collect()] == [None, None, 20]


def test_stream(spark, data, tmp_path):
    from inkgauge.streaming.score_stream import document_stream, score_stream, write_scores

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = score_stream(document_stream(spark, str(tmp_path / "in"), max_files=1), LengthStub()).drop("chunks")
    write_scores(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.exceptAll(detect.detect(docs, LengthStub()).drop("chunks")).count() == 0 and found.count() == docs.count()


# --- command line ------------------------------------------------------------------------------------------------------


def test_cli(spark, tmp_path, capsys, data, monkeypatch):
    from inkgauge import cli

    monkeypatch.setattr(cli.sys.stdin, "isatty", lambda: True, raising=False)
    path = tmp_path / "a.txt"
    path.write_text("word " * 700)
    stub = ["-m", "stub"]
    assert cli.main([str(path), "--chunks", *stub]) == 0 and "words 350-700" in capsys.readouterr().out
    assert cli.main(["score", str(path), "--fail-over", "0.1", "--json", *stub]) == 3
    out = capsys.readouterr()
    assert json.loads(out.out)[0]["n_words"] == 700 and "1 of 1 above" in out.err
    assert cli.main(["--text", "short", "--fail-over", "0.1", "-q", *stub]) == 4
    assert cli.main(["diff", str(path), str(path), "-f", "md", *stub]) == 0 and "| +0 |" in capsys.readouterr().out
    assert cli.main(["diff", str(path)]) == 2 and cli.main(["score"]) == 2
    assert cli.main(["score", "http://nowhere", *stub]) == 1
    monkeypatch.delenv("INKGAUGE_CHECKPOINTS", raising=False)
    assert cli.main([str(path)]) == 1 and "--checkpoints" in capsys.readouterr().err
    assert cli.main(["eval", *stub]) == 1
    assert cli.with_default_command(["eval"]) == ["eval"] and cli.with_default_command([]) == ["score"]
    with pytest.raises(SystemExit):
        cli.main(["score", "--text", "x", "-m", "stub", "--json", "--jsonl"])


def test_library_stands_without_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "inkgauge"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", path.read_text(), re.M), path
