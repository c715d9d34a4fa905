"""Results as text: lines as expressions over result rows, and reports as a tree of named values.

JSON keys, the glyphs of the strip and of the bar, and the columns of the Markdown table are fixed values; layout and wording
are this engine's own.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import percent
from ..operators.detect import MIN_WORDS
from ..operators.prose import delta_from_first

#: Fixed values.
GLYPHS = "▁▂▃▄▅▆▇█"
DASH = "—"
#: What is said about a result, by the condition that holds.
NOTES = {
    "truncated": "some window was longer than the model reads",
    "unreliable": f"fewer than {MIN_WORDS} words say little",
    "uncalibrated": "bands were made for another model, take them roughly",
}


# --- parts of lines ----------------------------------------------------------------------------------------------------


def heatmap(chunks: Column | str) -> Column:
    """One glyph per chunk, as high as its score."""
    c = F.col(chunks) if isinstance(chunks, str) else chunks
    height = lambda x: F.least(F.lit(len(GLYPHS) - 1), F.floor(x["score"] * len(GLYPHS))).cast("int") + 1
    return F.array_join(F.transform(c, lambda x: F.substr(F.lit(GLYPHS), height(x), F.lit(1))), "")


def bar(score: Column, width: int = 16) -> Column:
    filled = F.rint(score * width).cast("int")
    return F.concat(F.repeat(F.lit("•"), filled), F.repeat(F.lit("·"), F.lit(width) - filled))


def signed(points: Column) -> Column:
    """Whole points with their sign, halves to even; a value that rounds to 0 from below keeps its minus."""
    n = F.rint(points).cast("int")
    return F.concat(F.when(points >= 0, "+").when(n == 0, "-").otherwise(""), n.cast("string"))


def _points(score: Column | str) -> Column:
    return F.concat(percent(score).cast("string"), F.lit("%"))


def note_names() -> Column:
    """The names of NOTES that hold for a result, in that order, joined by commas; empty for none."""
    holds = {"truncated": F.col("truncated"), "unreliable": ~F.col("reliable"), "uncalibrated": ~F.col("calibrated")}
    return F.array_join(F.array_compact(F.array(*[F.when(holds[name], F.lit(name)) for name in NOTES])), ", ")


def _skipped() -> Column:
    return F.concat(F.lit("not scored: "), F.coalesce("reason", F.lit("")))


def padded(results: DataFrame, *columns: str) -> DataFrame:
    """Add ``<column>_padded``: filled with spaces to the longest value of all rows (one broadcast row of lengths)."""
    widths = results.agg(*[F.coalesce(F.max(F.char_length(c)), F.lit(0)).alias(f"__w{k}") for k, c in enumerate(columns)])
    out = results.crossJoin(F.broadcast(widths))
    return out.withColumns({f"{c}_padded": F.rpad(F.coalesce(c, F.lit("")), F.col(f"__w{k}"), " ") for k, c in enumerate(columns)}).drop(*[f"__w{k}" for k in range(len(columns))])


# --- lines of many results ---------------------------------------------------------------------------------------------


def json_lines(results: DataFrame) -> DataFrame:
    """One JSON object per result, without the preview, nulls written out."""
    return results.select(F.to_json(F.struct(*[c for c in results.columns if c not in ("preview", "ordinal")]), {"ignoreNullFields": "false"}).alias("value"))


def json_array(results: DataFrame, order: str = "ordinal") -> str:
    """All results as one JSON array; for results that a person asked for, not for a corpus."""
    lines = json_lines(results.orderBy(order) if order in results.columns else results)
    return "[" + ", ".join(r[0] for r in lines.collect()) + "]"


def list_rows(results: DataFrame) -> DataFrame:
    """Add ``line``: percent, band (as wide as the longest one), label, and in brackets what to bear in mind."""
    shown = padded(results.withColumn("__band", F.when(F.col("skipped"), F.lit(DASH)).otherwise(F.col("band"))), "__band")
    notes = F.when(F.col("skipped"), _skipped()).otherwise(note_names())
    tail = F.when(notes != "", F.concat(F.lit("  ("), notes, F.lit(")"))).otherwise("")
    points = F.lpad(F.when(F.col("skipped"), F.lit(DASH)).otherwise(_points("score")), 4, " ")
    return shown.withColumn("line", F.concat(points, F.lit("  "), F.col("__band_padded"), F.lit("  "), F.col("label"), tail)).drop("__band", "__band_padded")


def card_rows(results: DataFrame) -> DataFrame:
    """Add ``lines``: all about a result, as an array of lines."""
    size = F.concat(F.col("n_words").cast("string"), F.lit(" words, "), F.col("n_chunks").cast("string"), F.lit(" windows, model "), F.col("model"))
    sure = F.concat(F.lit("  certainty "), _points("confidence"))
    top = F.get("chunks", F.col("most_ai_chunk"))["score"]
    strip = F.concat(F.lit("  windows "), heatmap("chunks"), F.lit(", highest is number "), F.col("most_ai_chunk").cast("string"), F.lit(" at "), _points(top))
    told = F.from_json(F.lit(json.dumps(NOTES)), "map<string,string>")
    notes = F.transform(F.filter(F.split(note_names(), ", "), lambda n: n != ""), lambda n: F.concat(F.lit("  "), n, F.lit(": "), F.try_element_at(told, n)))
    full = F.concat(
        F.array(F.concat(F.col("label"), F.lit(": "), F.col("band"), F.lit(", "), _points("score")), F.concat(F.lit("  "), bar(F.col("score"))), F.concat(F.lit("  "), size)),
        F.array_compact(F.array(F.when(F.col("confidence").isNotNull(), sure), F.when(F.col("n_chunks") > 1, strip))),
        notes,
    )
    return results.withColumn("lines", F.when(F.col("skipped"), F.array(F.concat(F.col("label"), F.lit(": "), _skipped()))).otherwise(full))


def chunk_lines(results: DataFrame) -> DataFrame:
    """Add ``lines``: one per chunk, with its words, score and start; none for skipped results."""

    def line(c: Column) -> Column:
        words = F.concat(F.lit("words "), c["word_start"].cast("string"), F.lit("-"), c["word_end"].cast("string"))
        cut = F.when(c["truncated"], ", truncated").otherwise("")
        head = F.concat(F.lit("  "), c["index"].cast("string"), F.lit(": "), bar(c["score"], 10), F.lit(" "), _points(c["score"]), F.lit(" "), c["band"])
        return F.concat(head, F.lit(" ("), words, F.lit(", certainty "), _points(c["confidence"]), cut, F.lit(") "), F.substring(c["preview"], 1, 60))

    return results.withColumn("lines", F.when(F.col("skipped") | F.col("chunks").isNull(), F.array().cast("array<string>")).otherwise(F.transform("chunks", line)))


def markdown_rows(results: DataFrame, *keys: str, order: str = "ordinal", deltas: bool = True) -> DataFrame:
    """Add ``line``: each result as a row of a table of target, score, band, words, (difference,) note."""
    if deltas:
        results = delta_from_first(results, *keys, order=order)
    skipped, none = F.col("skipped"), F.lit(DASH)
    notes = F.array_compact(F.array(F.when(~F.col("reliable"), "unreliable"), F.when(F.col("truncated"), "truncated")))
    cells = [
        F.col("label"),
        F.when(skipped, none).otherwise(_points("score")),
        F.when(skipped, none).otherwise(F.col("band")),
        F.when(skipped, none).otherwise(F.col("n_words").cast("string")),
    ]
    if deltas:
        cells.append(F.when(skipped, none).otherwise(F.coalesce(signed(F.col("delta")), F.lit(""))))
    cells.append(F.when(skipped, F.concat(F.lit("skipped: "), F.col("reason"))).otherwise(F.array_join(notes, ", ")))
    return results.withColumn("line", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))


def diff_rows(results: DataFrame, *keys: str, order: str = "ordinal") -> DataFrame:
    """Add ``line``: label, bar, percent, band and the points from the first scored result."""
    results = delta_from_first(results, *keys, order=order)
    moved = F.coalesce(F.concat(F.lit(" ("), signed(F.col("delta")), F.lit(" points)")), F.lit(""))
    doubt = F.when(F.col("reliable"), "").otherwise(", unreliable")
    shown = F.concat(F.col("label"), F.lit(": "), bar(F.col("score"), 12), F.lit(" "), _points("score"), moved, F.lit(" "), F.col("band"), doubt)
    return results.withColumn("line", F.when(F.col("skipped"), F.concat(F.col("label"), F.lit(": "), _skipped())).otherwise(shown))


# --- views of a few results --------------------------------------------------------------------------------------------


def plain(results: DataFrame) -> list[dict]:
    """Results as dicts, in order; for a handful of targets."""
    rows = [r.asDict(recursive=True) for r in results.collect()]
    return sorted(rows, key=lambda r: r["ordinal"]) if "ordinal" in results.columns else rows


def _shown(results: DataFrame, column: str) -> list[Any]:
    return [r[column] for r in results.select("ordinal", column).orderBy("ordinal").collect()]


def view(results: DataFrame, kind: str, *, deltas: bool = False) -> str:
    """A few results in one form: list, card, chunks, diff, md, json or jsonl.

    ``results`` should be at hand (collected or saved): a view reads them in the order of their ordinals.
    """
    if kind == "json":
        return json_array(results)
    if kind == "jsonl":
        return "\n".join(r[0] for r in json_lines(results.orderBy("ordinal")).collect())
    if kind == "md":
        header = ["target", "score", "band", "words", *["Δ"] * deltas, "note"]
        return "\n".join([_cells(header), _cells(["---"] * len(header)), *_shown(markdown_rows(results, deltas=deltas), "line")])
    if kind in ("card", "chunks"):
        rows = _shown((card_rows if kind == "card" else chunk_lines)(results), "lines")
        return "\n".join(line for lines in rows for line in lines)
    return "\n".join(_shown((diff_rows if kind == "diff" else list_rows)(results), "line"))


def _cells(cells: Sequence[str]) -> str:
    return f"| {' | '.join(cells)} |"


# --- reports -----------------------------------------------------------------------------------------------------------


def fixed(x: float | None, places: int = 3) -> str:
    """Fixed decimals; a dash for what is undefined."""
    return DASH if x is None or math.isnan(x) else f"{x:.{places}f}"


def facts(report: Any, path: str = "") -> Iterator[tuple[str, Any]]:
    """(path, value) of all single values of a report, in their order; paths join names and positions by dots."""
    if isinstance(report, DataFrame):
        return
    if isinstance(report, dict):
        for key, value in report.items():
            yield from facts(value, f"{path}.{key}" if path else str(key))
    elif isinstance(report, (list, tuple)):
        for k, value in enumerate(report):
            yield from facts(value, f"{path}.{k}")
    else:
        yield path, report


def fact_rows(spark: SparkSession, report: dict) -> DataFrame:
    """The facts of a report as rows (item, value, text): value holds numbers and flags, text all others."""
    rows = []
    for item, x in facts(report):
        number = float(x) if isinstance(x, (int, float)) and not (isinstance(x, float) and math.isnan(x)) else None
        rows.append((item, number, x if isinstance(x, str) else None))
    return spark.createDataFrame(rows, "item string, value double, text string")


def _told(x: Any) -> str:
    if isinstance(x, bool):
        return "yes" if x else "no"
    return fixed(x) if isinstance(x, float) or x is None else str(x)


def report_view(report: dict) -> str:
    """Any report: single values first, then a block per part, with the interval of a value behind it."""
    lines = [f"{report['mode']} report"]
    lines += [f"{k}: {_told(v)}" for k, v in report.items() if k != "mode" and not isinstance(v, (dict, list, DataFrame))]
    for part, value in report.items():
        if not isinstance(value, (dict, list)) or not value:
            continue
        ends = value.get("cis") or value.get("cut_cis") or {} if isinstance(value, dict) else {}
        found = [(k, v) for k, v in facts(value) if k.split(".")[0] not in ("cis", "cut_cis")]
        width = max((len(k) for k, _ in found), default=0)
        lines += ["", f"{part}:"]
        for k, v in found:
            span = f"  ({fixed(ends[k][0])} to {fixed(ends[k][1])})" if k in ends else ""
            lines.append(f"  {k.ljust(width)}  {_told(v)}{span}")
    return "\n".join(lines)


#: The headline numbers of a labeled report.
HEADLINE = ("bucket_accuracy", "adjacent_accuracy", "spearman_score", "auroc_human")


def benchmark_view(report: dict, command: str) -> str:
    """One row of headline numbers as a Markdown table, and the command that makes it."""
    m = report["metrics"]
    span = lambda k: f" ({fixed(m['cis'][k][0])} to {fixed(m['cis'][k][1])})" if k in m["cis"] else ""
    row = [report["model"], str(report["n_used"]), *[fixed(m[k]) + span(k) for k in HEADLINE], fixed(report["latency"].get("p50_s"))]
    header = ["model", "n", *HEADLINE, "p50_s"]
    return "\n".join([_cells(header), _cells(["---"] * len(header)), _cells(row), "", f"Made by: {command}"])


def to_json(value: Any, indent: int | None = None) -> str:
    """JSON of a report; NaN and infinity become null, DataFrames their rows."""

    def tidy(x: Any) -> Any:
        if isinstance(x, DataFrame):
            return [tidy(r.asDict(recursive=True)) for r in x.collect()]
        if isinstance(x, float) and not math.isfinite(x):
            return None
        if isinstance(x, dict):
            return {str(k): tidy(v) for k, v in x.items()}
        return [tidy(v) for v in x] if isinstance(x, (list, tuple)) else x

    return json.dumps(tidy(value), indent=indent, ensure_ascii=False)
