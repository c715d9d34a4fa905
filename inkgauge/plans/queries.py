"""One query per operator over the given tables; the model is a stub whose score grows with a window's length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numeric, text
from ..operators import stats
from ..operators.bands import DEFAULT, band_label, join_bands
from ..operators.detect import chunk_array, chunk_rows, detect, detect_both, gate, scored_windows, weighted_probs
from ..operators.prose import delta_from_first, label, resolve_prose
from ..operators.windows import explode_windows, regroup, window_array
from ..scorers import LengthStub, LogitsScorer, add_scores
from ..sinks.report import diff_rows, heatmap, markdown_rows
from ..workspace import Workspace
from .evaluate import propose_bands
from .score import score_targets

#: Scales of the stub: the usual one, and one that reaches the upper bands.
SCALE, STEEP = 10_000, 2_500


def _t(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def _docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return _t(spark, d, "documents", "doc_id", "text", *more)


def _detected(spark: SparkSession, d: str, *more: str, scale: int = SCALE) -> DataFrame:
    return detect(_docs(spark, d, *more), LengthStub(scale))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Labeled documents as scored samples: truth 0..3 from the labels, a similarity from the length."""
    truth = _t(spark, d, "labels").select("doc_id", (F.col("quality") * 2 + F.col("toxic")).alias("gt_bucket"))
    found = detect(_docs(spark, d, "n_chars").join(truth, "doc_id"), LengthStub(STEEP))
    return found.select(
        F.col("doc_id").alias("sample_id"), "gt_bucket", F.col("score").alias("model_score"), F.col("bucket").alias("model_bucket"),
        (F.col("n_chars") % 97 / 97.0).alias("cosine_score"), weighted_probs("chunks").alias("probs"), "reliable", "preview", "n_words",
    )


def _round(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + 0.0 for c in columns})


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.clean_text("text").alias("clean"))


def word_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).withColumn("w", text.words(text.clean_text("text"))).withColumn("windows", window_array("w"))
    rows = explode_windows(docs, "doc_id")
    return rows.select("doc_id", "index", "n_words", "word_start", "word_end", F.md5("text").alias("text_md5"))


def window_regroup(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).withColumn("w", text.words(text.clean_text("text"))).withColumn("windows", window_array("w"))
    back = regroup(explode_windows(docs, "doc_id"), "doc_id", as_col="windows")
    words = F.aggregate("windows", F.lit(0), lambda s, w: s + w["n_words"])
    return back.select("doc_id", F.size("windows").alias("n_windows"), words.alias("n_words"), F.md5(F.array_join(F.transform("windows", lambda w: w["text"]), " ")).alias("text_md5"))


def reliability_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", F.size(text.words(text.clean_text("text"))).alias("n_words"))
    return docs.filter(F.col("n_words") >= 50)


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.count_words("text").cast("bigint").alias("n_words"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    step = scored_windows(_docs(spark, d), LengthStub(STEEP))
    return step.select("doc_id", chunk_array("windows", "scores", DEFAULT).alias("chunks"))


def chunk_scores(spark: SparkSession, d: str) -> DataFrame:
    return chunk_rows(scored_windows(_docs(spark, d), LengthStub(STEEP, varied=True)).drop("text"), "doc_id").select(
        "doc_id", "index", "score", "bucket", "band", "n_words", "word_start", "word_end", "confidence", "truncated", F.substring("preview", 1, 60).alias("preview")
    )


def chunk_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("doc_id", heatmap("chunks").alias("strip"))


def detect_documents(spark: SparkSession, d: str) -> DataFrame:
    return detect(_docs(spark, d), LengthStub(SCALE, varied=True)).select(
        "doc_id", "score", "band", "bucket", "n_words", "n_chunks", "reliable", "confidence", "truncated", "most_ai_chunk"
    )


def most_ai_chunk(spark: SparkSession, d: str) -> DataFrame:
    return _detected(spark, d, scale=STEEP).select("doc_id", "most_ai_chunk", F.array_max(F.transform("chunks", lambda c: c["score"])).alias("top_score"))


def _logits(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))


def decode_logits(spark: SparkSession, d: str) -> DataFrame:
    rows = _logits(spark, d).withColumn("probs", numeric.softmax("logits"))
    return _round(rows.select("vec_id", numeric.expected_score("probs").alias("score"), numeric.argmax("probs").alias("bucket")), "score")


def decode_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = _logits(spark, d).withColumn("probs", numeric.softmax("logits"))
    return _round(rows.select("vec_id", numeric.confidence("probs").alias("confidence")), "confidence")


def logits_scorer(spark: SparkSession, d: str) -> DataFrame:
    """The same decoding as a scorer of windows that carry their logits; a window of over 100 vectors' ids counts as cut."""
    scorer = LogitsScorer(lambda w: w["logits"], name="vectors", max_length=100, raw_length=lambda w: w["vec_id"])
    rows = _logits(spark, d).select("vec_id", F.array(F.struct("vec_id", "logits")).alias("windows"))
    found = add_scores(rows, scorer, "windows", "scores").select("vec_id", F.inline("scores"))
    return _round(found.select("vec_id", "score", "bucket", "confidence", "truncated"), "score", "confidence")


def document_probs(spark: SparkSession, d: str) -> DataFrame:
    rows = detect(_docs(spark, d), LengthStub(STEEP, varied=True)).select("doc_id", weighted_probs("chunks").alias("p"))
    return _round(rows.select("doc_id", *[F.get("p", F.lit(k)).alias(f"p{k}") for k in range(4)]), *[f"p{k}" for k in range(4)])


def _simple_scores(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", (F.least(F.col("n_chars"), F.lit(6000)) / 6000.0).alias("score"))


def band_lookup(spark: SparkSession, d: str) -> DataFrame:
    return _simple_scores(spark, d).select("doc_id", band_label("score").alias("band"))


def band_range_join(spark: SparkSession, d: str) -> DataFrame:
    return join_bands(_simple_scores(spark, d), "score").select("doc_id", F.col("label").alias("band"))


def score_to_bucket(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_discount")
    return rows.select("l_orderkey", "l_linenumber", numeric.score_to_bucket(F.col("l_discount") * 2).alias("bucket"))


DESCRIBED = ("min", "q25", "median", "mean", "q75", "q90", "max")


def describe_overall(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.describe(_detected(spark, d), "score"), *DESCRIBED, places=9)


def describe_by_source(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.describe(_detected(spark, d, "source"), "score", "source"), *DESCRIBED, places=9)


def fp_table(spark: SparkSession, d: str) -> DataFrame:
    return stats.threshold_counts(_detected(spark, d, scale=STEEP), "score")


def gate_over(spark: SparkSession, d: str) -> DataFrame:
    return gate(_detected(spark, d, scale=STEEP), 0.5)


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return detect(_t(spark, d, "conversations", "conv_id", "turn", "text"), LengthStub(1000))


def diff_vs_first(spark: SparkSession, d: str) -> DataFrame:
    rows = delta_from_first(_turns(spark, d), "conv_id", order="turn")
    return rows.select("conv_id", "turn", F.round("delta", 4).alias("delta"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Documents as references that take every branch of the prose rules, by their number."""
    k = F.col("doc_id") % 5
    fenced = F.concat(F.lit("---\nkey: x\n---\n# Title\n"), F.col("text"), F.lit("\n```\ncode\n```\n<IMAGE src='a'/>\n### kept\n"))
    return _docs(spark, d, "source").select(
        F.col("doc_id").alias("ordinal"),
        F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc "), F.col("doc_id").cast("string"))).alias("label"),
        F.when(k != 4, fenced).alias("content"),
        F.when(k == 0, F.col("text")).when(k == 1, "").when(k == 2, F.col("text")).alias("prose"),
        F.when(k == 2, F.array(F.lit("a"), F.lit("b"))).when(k == 0, F.array(F.lit("a"))).alias("prose_authors"),
        F.when(F.col("doc_id") % 7 == 0, F.create_map(F.lit("transcript_error"), F.lit("x"))).alias("metadata"),
    )


def prose_resolution(spark: SparkSession, d: str) -> DataFrame:
    rows = resolve_prose(_references(spark, d))
    return rows.select(F.col("ordinal").alias("doc_id"), label().alias("label"), "skip_reason", F.md5("text").alias("text_md5"))


def generic_strip(spark: SparkSession, d: str) -> DataFrame:
    return _references(spark, d).select(F.col("ordinal").alias("doc_id"), F.md5(text.generic_strip("content")).alias("text_md5"))


def scored_targets(spark: SparkSession, d: str) -> DataFrame:
    refs = resolve_prose(_references(spark, d))
    targets = refs.select("ordinal", F.col("source").alias("ref"), "source", label().alias("label"), "text", F.col("skip_reason").alias("reason"))
    out = score_targets(targets, LengthStub(STEEP))
    return out.select("ordinal", "label", "score", "band", "n_words", "skipped", "reason")


def rankdata(spark: SparkSession, d: str) -> DataFrame:
    return stats.average_ranks(_scored(spark, d).select("sample_id", "model_bucket"), "model_bucket").select("sample_id", "rank")


def spearman(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.spearman(_scored(spark, d), "model_score", "cosine_score"), "spearman")


def auroc(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.auroc(_scored(spark, d), "model_score", F.col("gt_bucket") >= 2), "auroc")


def balacc_sweep(spark: SparkSession, d: str) -> DataFrame:
    found = stats.balanced_accuracy_sweep(_scored(spark, d), "model_score", F.col("gt_bucket") >= 2)
    row = [] if found is None else [(found["threshold"], round(found["bal_acc"], 6), *found["plateau"], found["tp"], found["n_pos"], found["fp"], found["n_neg"])]
    return spark.createDataFrame(row, "threshold double, bal_acc double, plateau_low double, plateau_high double, tp bigint, n_pos bigint, fp bigint, n_neg bigint")


def proposed_bands(spark: SparkSession, d: str) -> DataFrame:
    found = propose_bands(_scored(spark, d), n_boot=0)
    rows = [(k, b["cut"], b["band_below"], b["pinned"], found["degenerate"]) for k, b in enumerate(found["boundaries"])]
    return spark.createDataFrame(rows, "position int, cut double, band_below string, pinned boolean, degenerate boolean")


def confusion(spark: SparkSession, d: str) -> DataFrame:
    return stats.confusion(_scored(spark, d), "gt_bucket", "model_bucket")


def bucket_metrics(spark: SparkSession, d: str) -> DataFrame:
    argmax = F.when(F.size("probs") > 0, numeric.argmax("probs")).otherwise(F.col("model_bucket"))
    found = stats.agreement(_scored(spark, d).withColumn("top", argmax), "gt_bucket", "model_bucket", "top")
    return _round(found, "bucket_accuracy", "bucket_accuracy_argmax", "adjacent_accuracy", "bucket_mae")


def per_gt_describe(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.describe(_scored(spark, d), "model_score", "gt_bucket"), *DESCRIBED, places=9)


def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.calibration_bins(_scored(spark, d), "model_score", "gt_bucket"), "mean_score", "mean_gt")


def ece(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.ece(_scored(spark, d), "probs", "gt_bucket"), "ece")


def worst_disagreements(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.worst(_scored(spark, d), "gt_bucket", "model_bucket", "model_score", "sample_id")
    return rows.select("sample_id", "gt_bucket", "model_bucket", "model_score")


def compare_runs(spark: SparkSession, d: str) -> DataFrame:
    both = detect_both(_docs(spark, d), LengthStub(SCALE), LengthStub(STEEP))
    pairs = both.select(*[F.col(x)[c].alias(k + x) for x in "ab" for k, c in (("s", "score"), ("b", "bucket"), ("r", "reliable"))])
    return _round(stats.compare_columns(pairs), "score_mae", "max_delta", "bucket_flip_rate")


def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "events").select(F.abs("value").alias("latency"), F.lit(100).alias("words"))
    return _round(stats.latency_summary(rows, "latency", "words"), "p50_s", "p95_s", "words_per_s", places=4)


def seeded_sample(spark: SparkSession, d: str) -> DataFrame:
    return stats.seeded_sample(_t(spark, d, "documents", "doc_id", "lang"), "doc_id", 100, seed=7)


def bootstrap_cis(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.bootstrap_cis(_scored(spark, d)), "low", "high")


def bootstrap_cuts(spark: SparkSession, d: str) -> DataFrame:
    scored = Workspace(spark).save(_scored(spark, d).select("sample_id", "gt_bucket", "model_score"), "scored")
    return _round(stats.bootstrap_cuts(scored, {"human": 1, "light": 2, "top": 3}), "low", "high")


def markdown(spark: SparkSession, d: str) -> DataFrame:
    results = _turns(spark, d).withColumn("label", F.concat_ws("/", "conv_id", "turn"))
    results = results.withColumn("skipped", F.lit(False)).withColumn("reason", F.lit(None).cast("string"))
    return markdown_rows(results, "conv_id", order="turn").select("conv_id", "turn", "line")


def diff_view(spark: SparkSession, d: str) -> DataFrame:
    results = _turns(spark, d).withColumn("label", F.concat_ws("/", "conv_id", "turn"))
    results = results.withColumn("skipped", F.lit(False)).withColumn("reason", F.lit(None).cast("string"))
    return diff_rows(results, "conv_id", order="turn").select("conv_id", "turn", "line")


#: Emoji and sequences with the names that they should get.
MARKS = (
    ("✨", ":sparkles:"), ("🎉", ":party_popper:"), ("❤️", ":red_heart:"), ("plain", "plain"), ("👍🏽", ":thumbs_up_medium_skin_tone:"),
    ("👨‍👩‍👧", ":family_man_woman_girl:"), ("🇩🇪", ":flag_DE:"), ("5️⃣", ":keycap_5:"), ("👩🏿‍🚀", ":woman_astronaut_dark_skin_tone:"),
    ("🏃‍♀️", ":woman_running:"), ("😃", ":grinning_face_with_big_eyes:"), ("©", ":copyright:"), ("🏳️‍🌈", ":rainbow_flag:"), ("5", "5"),
)


def emoji_names(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with emoji put in by number, so that the name rules have something to act on."""
    k = ((F.col("conv_id") * 7 + F.col("turn")) % len(MARKS) + 1).cast("int")
    mark = F.element_at(F.array(*[F.lit(m) for m, _ in MARKS]), k)
    rows = _t(spark, d, "conversations", "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", F.md5(text.normalize_emoji(F.concat(F.lit("a"), mark, F.lit(" "), F.col("text")))).alias("text_md5"))


def think_tag(spark: SparkSession, d: str) -> DataFrame:
    """Conversations with up to three end-of-thinking marks put in by turn."""
    tagged = F.concat(F.lit("a "), F.array_join(F.array_repeat(F.concat(F.col("text"), F.lit("</think> ")), (F.col("turn") % 4).cast("int")), ""), F.col("text"))
    rows = _t(spark, d, "conversations", "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", F.md5(text.remove_think_tag(tagged)).alias("text_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        clean_text, word_windows, window_regroup, reliability_filter, word_counts, chunk_scores, chunk_heatmap, detect_documents,
        most_ai_chunk, decode_logits, decode_confidence, logits_scorer, document_probs, band_lookup, band_range_join,
        score_to_bucket, describe_overall, describe_by_source, fp_table, gate_over, diff_vs_first, prose_resolution,
        generic_strip, scored_targets, rankdata, spearman, auroc, balacc_sweep, proposed_bands, confusion, bucket_metrics,
        per_gt_describe, calibration_bins, ece, worst_disagreements, compare_runs, latency_summary,
        seeded_sample, bootstrap_cis, bootstrap_cuts, markdown, diff_view, emoji_names, think_tag,
    )
}
