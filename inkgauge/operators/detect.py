"""From texts to one scored, banded result per document.

The windows of a document stay in one array in its row, so scoring and assembling need no shuffle at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let_sql, quoted
from ..functions.numeric import round_exact, round_sql
from ..functions.text import PREVIEW_CHUNK, PREVIEW_WIRE_CHUNK, clean_text, preview, words
from ..scorers import ExpressionScorer, add_scores
from .bands import DEFAULT, UNRELIABLE, Band, band_label, band_sql
from .windows import WINDOW_WORDS, window_array

MIN_WORDS = 50

DETECTION_COLUMNS = (
    "score", "band", "bucket", "n_words", "n_chunks", "reliable", "confidence", "truncated", "model", "calibrated",
    "most_ai_chunk", "chunks",
)
WIRE_CHUNK = ("index", "score", "band", "n_words", "word_start", "word_end", "confidence", "truncated", "preview")


def _weighted(chunks: str, name: str) -> str:
    """Mean of a chunk field by words, as SQL; summed in the order of the chunks so that it is the same everywhere."""
    total = f"aggregate(c, 0D, (t, x) -> t + x.{name} * x.n_words)"
    return let_sql("c", chunks, f"try_divide({total}, CAST(aggregate(c, 0, (t, x) -> t + x.n_words) AS DOUBLE))")


def chunk_sql(windows: str, scores: str, bands: Sequence[Band]) -> str:
    """Windows and their scores as chunk results: band from the score as it is, numbers rounded to 4 places."""
    fields = {
        "index": "w.index", "score": round_sql("s.score", 4), "bucket": "s.bucket", "band": band_sql("s.score", bands),
        "n_words": "w.n_words", "word_start": "w.word_start", "word_end": "w.word_end", "confidence": round_sql("s.confidence", 4),
        "truncated": "s.truncated", "probs": f"transform(s.probs, p -> {round_sql('p', 4)})", "preview": f"substring(w.text, 1, {PREVIEW_CHUNK})",
    }
    return f"zip_with({windows}, {scores}, (w, s) -> named_struct({', '.join(f'{quoted(k)}, {v}' for k, v in fields.items())}))"


def chunk_array(windows: str, scores: str, bands: Sequence[Band]) -> Column:
    """:func:`chunk_sql` of two columns."""
    return F.expr(chunk_sql(f"`{windows}`", f"`{scores}`", bands))


def chunk_rows(scored: DataFrame, *keys: str, bands: Sequence[Band] = DEFAULT) -> DataFrame:
    """One row per chunk, from rows with windows and scores: the fields of :func:`chunk_array` without probabilities."""
    pairs = scored.select(*keys, F.explode_outer(F.arrays_zip("windows", "scores")).alias("z")).select(*keys, "z.windows.*", "z.scores.*")
    pairs = pairs.filter(F.col("index").isNotNull())  # behind the generator: see explode_windows
    return pairs.select(
        *keys,
        "index",
        round_exact("score", 4).alias("score"),
        "bucket",
        band_label("score", bands).alias("band"),
        "n_words",
        "word_start",
        "word_end",
        round_exact("confidence", 4).alias("confidence"),
        "truncated",
        F.substring("text", 1, PREVIEW_CHUNK).alias("preview"),
    )


def windowed(docs: DataFrame, *, text_col: str = "text", window_words: int = WINDOW_WORDS) -> DataFrame:
    """Add n_words and windows (an array) to the rows."""
    # each step is a projection of its own: the cleaned text is computed once
    step = docs.withColumn("__words", words(clean_text(F.coalesce(F.col(text_col), F.lit("")))))
    return step.withColumn("n_words", F.size("__words")).withColumn("windows", window_array("__words", window_words)).drop("__words")


def scored_windows(docs: DataFrame, scorer: Any, *, text_col: str = "text", window_words: int = WINDOW_WORDS) -> DataFrame:
    """Add n_words, windows and scores (arrays) to the rows."""
    return add_scores(windowed(docs, text_col=text_col, window_words=window_words), scorer, "windows", "scores")


def _own(docs: DataFrame, text_col: str, *taken: str) -> tuple[list[str], DataFrame]:
    """The row's own columns in a struct, whatever they are called, and its text."""
    keys = [c for c in docs.columns if c != text_col and c not in taken]
    return keys, docs.select(F.struct(F.lit(0).alias("__"), *keys).alias("__own"), F.col(text_col).alias("__text"))


def _results(step: DataFrame, scorer: Any, scores: str, bands: Sequence[Band], min_words: int) -> DataFrame:
    """Add ``r``: a struct of DETECTION_COLUMNS and latency_s, from windows and their scores."""
    step = step.withColumn("__chunks", chunk_array("windows", scores, bands))
    means = {f"__{k}": F.expr(f"coalesce({_weighted('__chunks', v)}, 0D)") for k, v in (("score", "score"), ("sure", "confidence"))}
    step = step.withColumns(means)
    # the position of the largest score is the index of its first chunk
    first_top = let_sql("t", "transform(__chunks, x -> x.score)", "CAST(array_position(t, array_max(t)) AS INT) - 1")
    # without windows a model takes no time, but an expression has none even then
    timed = f"size({scores}) > 0" if isinstance(scorer, ExpressionScorer) else "true"
    fields = {
        "score": round_sql("__score", 4),
        "band": f"CASE WHEN n_words >= {min_words} THEN {band_sql('__score', bands)} ELSE {quoted(UNRELIABLE)} END",
        "bucket": f"CAST(rint(__score * {scorer.n_buckets - 1}) AS INT)",
        "n_words": "n_words",
        "n_chunks": "size(__chunks)",
        "reliable": f"n_words >= {min_words}",
        "confidence": round_sql("__sure", 4),
        "truncated": "exists(__chunks, x -> x.truncated)",
        "model": quoted(scorer.name),
        "calibrated": str(bool(scorer.calibrated)).lower(),
        "most_ai_chunk": first_top,
        "chunks": "__chunks",
        "latency_s": f"CASE WHEN {timed} THEN aggregate({scores}, 0D, (t, x) -> t + x.latency_s) END",
    }
    found = F.expr(f"named_struct({', '.join(f'{quoted(k)}, {v}' for k, v in fields.items())})")
    return step.withColumn("r", found).drop("__chunks", "__score", "__sure")


def detect(
    docs: DataFrame,
    scorer: Any,
    *,
    text_col: str = "text",
    bands: Sequence[Band] = DEFAULT,
    window_words: int = WINDOW_WORDS,
    min_words: int = MIN_WORDS,
    with_latency: bool = False,
) -> DataFrame:
    """One result per row: the row's columns without the text, and DETECTION_COLUMNS (and ``preview`` of the text).

    Columns of these names in ``docs`` are replaced. Null text counts as empty.

    The score is the mean of the rounded chunk scores by words; bucket and band come from it before it is rounded. A
    document of fewer than ``min_words`` words is unreliable; one without words has score 0 and no chunks.
    ``with_latency`` adds latency_s: the model's time for the document's windows (null where a scorer is an expression).
    """
    shown = (*DETECTION_COLUMNS, "latency_s") if with_latency else DETECTION_COLUMNS
    keys, step = _own(docs, text_col, *shown, "preview")
    step = scored_windows(step, scorer, text_col="__text", window_words=window_words)
    step = _results(step, scorer, "scores", bands, min_words)
    return step.select(*[F.col("__own").getField(k).alias(k) for k in keys], *[F.col("r")[c].alias(c) for c in shown], preview("__text").alias("preview"))


def detect_both(docs: DataFrame, one: Any, two: Any, *, text_col: str = "text", bands: Sequence[Band] = DEFAULT) -> DataFrame:
    """The results of two scorers side by side, as structs ``a`` and ``b``: texts are cleaned and cut once, nothing is joined."""
    keys, step = _own(docs, text_col, "a", "b", "preview")
    step = windowed(step, text_col="__text")
    for name, scorer in (("a", one), ("b", two)):
        step = _results(add_scores(step, scorer, "windows", "scores"), scorer, "scores", bands, MIN_WORDS).drop("scores").withColumnRenamed("r", name)
    return step.select(*[F.col("__own").getField(k).alias(k) for k in keys], "a", "b", preview("__text").alias("preview"))


def weighted_probs(chunks: str) -> Column:
    """Mean of the chunks' probability vectors by words; empty array without chunks. ``chunks``: a column or a path of one."""
    total = "CAST(aggregate(c, 0, (t, x) -> t + x.n_words) AS DOUBLE)"
    summed = "aggregate(c, array_repeat(0D, coalesce(size(get(c, 0).probs), 0)), (t, x) -> zip_with(t, x.probs, (a, p) -> a + p * x.n_words))"
    shares = let_sql("n", total, f"transform({summed}, v -> v / n)")
    return F.expr(let_sql("c", chunks, f"CASE WHEN size(c) > 0 THEN {shares} ELSE CAST(array() AS ARRAY<DOUBLE>) END"))


def wire(results: DataFrame) -> DataFrame:
    """Chunks as they are handed out: without bucket and probabilities, previews shortened."""
    if "chunks" not in results.columns:
        return results
    short = lambda c: F.struct(*[(F.substring(c[n], 1, PREVIEW_WIRE_CHUNK) if n == "preview" else c[n]).alias(n) for n in WIRE_CHUNK])
    return results.withColumn("chunks", F.transform("chunks", short))


def gate(results: DataFrame, threshold: float) -> DataFrame:
    """One row: over (reliable results with a score above the threshold), scored (reliable ones), exit_code 0, 3 or 4."""
    counted = (~F.coalesce(F.col("skipped"), F.lit(False)) & F.col("reliable")) if "skipped" in results.columns else F.col("reliable")
    counted = F.coalesce(counted, F.lit(False))
    sums = results.agg(F.count_if(counted & (F.col("score") > threshold)).alias("over"), F.count_if(counted).alias("scored"))
    code = F.when(F.col("scored") == 0, 4).when(F.col("over") > 0, 3).otherwise(0)
    return sums.withColumn("exit_code", code.cast("int"))
