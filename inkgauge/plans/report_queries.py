"""Queries of sources, sinks, reports, model handling and the command line, over the given tables and small fixtures."""

from __future__ import annotations

import argparse
import contextlib
import io
import json
import logging
import struct
import tempfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import cli
from ..checkpoints import Machine, adapter_base, adapter_buckets, batch_width, is_adapter, plan_runtime
from ..functions import numeric, text
from ..functions.sql import register_functions
from ..operators.bands import band_label, bands_from_artifact
from ..operators.detect import detect, wire
from ..scorers import BatchScorer, LengthStub, ScorerAccessError, ScorerUnavailableError, _opened, cached_model, decode_numpy
from ..sinks import report, tables
from ..sources import documents
from ..workspace import Workspace
from . import evaluate
from .queries import SCALE, STEEP, _detected, _docs, _references, _round, _t
from .score import score_targets

#: Fixtures: what is scored, read or told. Their twins repeat them.
SHORT = ("", "  \n ", "word " * 60, "three short words")
STREAM = "Piped in. " * 40
PLANS = (
    (False, False, False, 0, None, None), (False, True, False, 0, None, None), (True, False, True, 8 << 30, None, "auto"),
    (True, False, False, 8 << 30, "cuda:1", "llama"), (True, False, True, 1 << 50, "cpu", None), (True, False, True, 1, "cuda", "roberta"),
)
CUTS = (0.1, 0.2, 0.2, 0.4)
HEAD = {
    "model": "m", "n_used": 8, "latency": {"p50_s": 0.25},
    "metrics": {"bucket_accuracy": 0.5, "adjacent_accuracy": 1.0, "spearman_score": None, "auroc_human": 0.875, "cis": {"bucket_accuracy": [0.25, 0.75]}},
}


def _results(spark: SparkSession, d: str, *, calibrated: bool = True) -> DataFrame:
    """Results of the benchmark texts and of each document whose number ends in 7, which counts as skipped."""
    texts = _t(spark, d, "benchmark").select(F.col("item_id").cast("bigint").alias("ordinal"), "text", F.lit(None).cast("string").alias("reason"))
    gone = _t(spark, d, "documents", "doc_id").filter("doc_id % 10 = 7").select((F.col("doc_id") + 1_000_000).alias("ordinal"), F.lit(None).cast("string").alias("text"), F.lit("no prose").alias("reason"))
    targets = texts.unionByName(gone).withColumn("label", F.concat(F.lit("t"), F.col("ordinal").cast("string")))
    targets = targets.withColumn("source", F.lit(None).cast("string")).withColumn("ref", F.lit(None).cast("string"))
    return score_targets(targets, LengthStub(200, calibrated=calibrated, varied=True, max_chars=150))


def wire_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """What a reader gets back from the JSON lines: fields in their order, values, nulls."""
    lines = report.json_lines(wire(detect(_docs(spark, d), LengthStub(STEEP, varied=True))))
    chunk = "STRUCT<index: INT, score: DOUBLE, band: STRING, n_words: INT, preview: STRING>"
    read = F.from_json("value", f"doc_id BIGINT, score DOUBLE, band STRING, n_words INT, most_ai_chunk INT, chunks ARRAY<{chunk}>")
    keys = F.array_join(F.json_object_keys("value"), ",")
    first = F.get("r.chunks", F.lit(0))
    return lines.select(read.alias("r"), keys.alias("keys"), F.array_join(F.json_object_keys(F.get_json_object("value", "$.chunks[0]")), ",").alias("chunk_keys")).select(
        "r.doc_id", "r.score", "r.band", "r.n_words", "r.most_ai_chunk", F.size("r.chunks").alias("n_chunks"), first["band"].alias("first_band"),
        F.length(first["preview"]).alias("preview_chars"), "keys", "chunk_keys",
    )


def wire_json_array(spark: SparkSession, d: str) -> DataFrame:
    """The same as one array, in the order of the ordinals, read back."""
    whole = report.json_array(wire(_results(spark, d)))
    rows = [(k, x["label"], x["score"], x["skipped"], x["reason"], "preview" in x) for k, x in enumerate(json.loads(whole))]
    return spark.createDataFrame(rows, "place int, label string, score double, skipped boolean, reason string, with_preview boolean")


def list_lines(spark: SparkSession, d: str) -> DataFrame:
    return report.list_rows(_results(spark, d)).select("ordinal", "line")


def uncalibrated_views(spark: SparkSession, d: str) -> DataFrame:
    return report.list_rows(_results(spark, d, calibrated=False)).select("ordinal", "line")


def card_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = detect(_docs(spark, d), LengthStub(STEEP, calibrated=False, varied=True)).withColumn("label", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    rows = rows.withColumn("skipped", F.col("doc_id") % 10 == 7).withColumn("reason", F.lit("no prose"))
    return report.card_rows(rows).select("doc_id", F.array_join("lines", "|").alias("card"))


def chunk_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = detect(_docs(spark, d), LengthStub(STEEP, varied=True)).withColumn("skipped", F.col("doc_id") % 10 == 7)
    # the outer form, and a filter behind it: see operators.windows.explode_windows
    lines = report.chunk_lines(rows).select("doc_id", F.posexplode_outer("lines").alias("place", "line"))
    return lines.filter(F.col("place").isNotNull())


def ordered_view(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a view, by their place: the order of the input."""
    lines = report.view(_results(spark, d), "list").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")


def output_formats(spark: SparkSession, d: str) -> DataFrame:
    """Each output format of the same results: number of lines, and how the first begins."""
    results = Workspace(spark).save(_results(spark, d), "results")
    shown = {form: cli.show(results, form) for form in ("human", "json", "jsonl", "md")} | {"diff": cli.show(results, "human", deltas=True)}
    return spark.createDataFrame([(k, len(v.split("\n")), v[:2]) for k, v in shown.items()], "form string, n_lines int, begins string")


def previews(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", text.preview("text").alias("short"), text.preview("text", text.PREVIEW_SAMPLE).alias("long"))


def fixed_numbers(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 5 == 1, float("nan")).otherwise(F.col("value"))
    rows = _t(spark, d, "events", "event_id", "value").withColumn("v", value)
    return rows.select("event_id", numeric.fixed("v").alias("shown"))


def empty_documents(spark: SparkSession, d: str) -> DataFrame:
    found = detect(spark.createDataFrame(list(enumerate(SHORT)), "doc_id int, text string"), LengthStub(varied=True))
    return found.select("doc_id", "score", "band", "bucket", "n_words", "n_chunks", "reliable", "confidence", "truncated", "most_ai_chunk")


def text_and_stream(spark: SparkSession, d: str) -> DataFrame:
    """A literal text and a piped one as targets."""
    targets = documents.from_text(spark, SHORT[2]).unionByName(documents.from_stdin(spark, io.StringIO(STREAM)).withColumn("ordinal", F.lit(1).cast("bigint")))
    return score_targets(targets, LengthStub(STEEP)).select("ordinal", "label", "score", "band", "n_words", "preview")


def file_targets(spark: SparkSession, d: str) -> DataFrame:
    """A file per conversation, read back in the order of the paths."""
    root = f"{Workspace(spark).root}/files"
    turns = _t(spark, d, "conversations", "conv_id", "turn", "text").withColumn("text", F.regexp_replace("text", "\n", " "))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn").select("conv_id", "text")
    turns.write.option("maxRecordsPerFile", 0).partitionBy("conv_id").text(root)
    files = score_targets(documents.from_files(spark, [f"{root}/conv_id=*/*.txt"]), LengthStub(STEEP))
    number = F.regexp_extract("label", r"conv_id=(\d+)", 1).cast("bigint")
    return files.select(number.alias("conv_id"), "score", "n_words", F.row_number().over(Window.orderBy("ordinal")).alias("place"))


def _resolve(target: str) -> list[dict]:
    """``ref:<n>``: n % 3 documents, of which the second has no prose; every fifth fails."""
    n = int(target.split(":")[1])
    failed = {"metadata": {"transcript_error": "x"}} if n % 5 == 0 else {}
    return [{"source": f"s{n}", "label": f"{n}-{k}", "content": "# Title\n" + "word " * (50 + n), "prose": None if k == 0 else ""} | failed for k in range(n % 3)]


def mixed_targets(spark: SparkSession, d: str) -> DataFrame:
    """A stream, a file and references in one list: the order stays, each reference has 0 to 2 documents."""
    before = documents._resolver
    documents.register_resolver(_resolve)
    try:
        with tempfile.NamedTemporaryFile("w", suffix=".txt") as file:
            file.write("line " * 70)
            file.flush()
            targets = documents.from_targets(spark, ["ref:4", "-", file.name, *(f"ref:{n}" for n in range(1, 12))], stream=io.StringIO(STREAM))
            found = score_targets(targets, LengthStub(STEEP)).withColumn("label", F.when(F.col("label") == file.name, "file").otherwise(F.col("label")))
    finally:
        documents.register_resolver(before)
    return found.select((F.row_number().over(Window.orderBy("ordinal")) - 1).alias("place"), "label", "score", "n_words", "skipped", "reason")


def _labeled(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a labeled table: a similarity from the length, and for every third the first half as its source."""
    half = F.when(F.col("doc_id") % 3 == 0, F.substr("text", F.lit(1), (F.col("n_chars") / 2).cast("int")))
    return _docs(spark, d, "n_chars").select("doc_id", "text", (F.col("n_chars") % 20 / 100.0).alias("cosine_score"), half.alias("source_text"))


def labeled_samples(spark: SparkSession, d: str) -> DataFrame:
    found = documents.labeled_samples(_labeled(spark, d), 100, key="doc_id", seed=3)
    return found.select("sample_id", "cosine_score", "gt_bucket", "n_words", "preview", F.length("source_text").alias("source_chars"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return Workspace(spark).save(documents.labeled_samples(_labeled(spark, d), 2_000_000_000, key="doc_id"), "samples")


def _report_rows(spark: SparkSession, found: dict) -> DataFrame:
    """The facts that twins can tell: no intervals and no times."""
    rows = report.fact_rows(spark, found).filter(~F.col("item").rlike(r"\.cis\.|cut_cis|latency|preview|worst"))
    return rows.withColumn("value", F.round("value", 9) + 0.0)


def dataset_report(spark: SparkSession, d: str) -> DataFrame:
    """The report on labeled samples with source texts, as named values: all lengths, without resampling."""
    found = evaluate.eval_dataset(_samples(spark, d), LengthStub(STEEP, varied=True), reliable_only=False, with_source=True, n_boot=0)
    return _report_rows(spark, json.loads(report.to_json(found)))


def compare_models(spark: SparkSession, d: str) -> DataFrame:
    """The two kinds of model (stubs here) against each other, and with and without 4 bits, over reliable samples."""
    chosen = lambda kind, **o: LengthStub(STEEP if kind == "llama" else SCALE, name=kind)
    four = lambda kind, quantize=None, **o: LengthStub(STEEP if quantize else 2 * STEEP, name=kind)
    samples = _samples(spark, d)
    models = evaluate.compare_models(samples, chosen=chosen, with_metrics=False)
    quant = evaluate.compare_quant(samples, chosen=four, machine=Machine(cuda=True, four_bit=True), with_metrics=False)
    rows = [(n, x["label_a"], x["label_b"], x["n"], x["score_mae"], x["max_delta"], x["bucket_flip_rate"]) for n, x in (("models", models), ("quant", quant))]
    return _round(spark.createDataFrame(rows, "mode string, a string, b string, n bigint, score_mae double, max_delta double, bucket_flip_rate double"), "score_mae", "max_delta", "bucket_flip_rate")


def source_control(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the samples' source texts."""
    scored = evaluate.score_samples(_samples(spark, d), LengthStub(STEEP), with_source=True)
    return _round(scored.filter("source_score IS NOT NULL").select("sample_id", "model_score", "source_score", "source_bucket"), "source_score", places=4)


def references_report(spark: SparkSession, d: str) -> DataFrame:
    """The report on unlabeled references, by source, with what was skipped."""
    targets = documents.from_references(_references(spark, d))
    results = Workspace(spark).save(score_targets(targets, LengthStub(STEEP)), "results")
    found = evaluate.eval_references(results, reliable_only=True)
    return _report_rows(spark, {k: found[k] for k in ("mode", "n_scored", "n_skipped", "model", "overall", "fp_table", "by_source")})


def probe_report(spark: SparkSession, d: str) -> DataFrame:
    """Four texts of growing length, read from files: the first reads lowest and the last one highest."""
    with tempfile.TemporaryDirectory() as folder:
        for k, name in enumerate(cli.GRADIENT):
            (Path(folder) / name).write_text("word " * (60 + 60 * k))
        found = evaluate.gradient_probe(documents.gradient_samples(spark, folder, cli.GRADIENT), LengthStub(STEEP))
    return _report_rows(spark, found)


def empty_metrics(spark: SparkSession, d: str) -> DataFrame:
    none = evaluate.score_samples(_samples(spark, d).filter("sample_id < 0"), LengthStub())
    return report.fact_rows(spark, evaluate.dataset_metrics(none, n_boot=0))


def headline_table(spark: SparkSession, d: str) -> DataFrame:
    lines = report.benchmark_view(HEAD, "run").split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """A report as text: values, parts, and an interval behind its value."""
    lines = report.report_view({"mode": "dataset"} | HEAD).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "place int, line string")


def bands_artifact(spark: SparkSession, d: str) -> DataFrame:
    """Bands written as an artifact, read back, and used; broken artifacts are refused."""
    names = ("human", "lightly edited", "moderately edited", "heavily edited")
    bands = {"boundaries": [{"cut": c, "band_below": n, "pinned": True} for c, n in zip(CUTS, names)], "cut_cis": {}, "degenerate": False}
    made = evaluate.bands_artifact({"model": "m", "bands": bands, "split": "test", "seed": 0, "n_used": 1, "reliable_only": True, "quantized": False})
    with tempfile.TemporaryDirectory() as folder:
        tables.write_bands(made, f"{folder}/bands.json")
        read = bands_from_artifact(tables.read_bands(f"{folder}/bands.json"))
    for broken in ({"kind": "x"}, {"version": 2}, {"degenerate": True}, {"cuts": made["cuts"][:3]}, {"cuts": made["cuts"][::-1]}):
        with contextlib.suppress(ValueError):
            bands_from_artifact(made | broken)
            raise AssertionError(f"accepted {broken}")
    return _detected(spark, d).select("doc_id", band_label("score", read).alias("band"))


def batch_scorer(spark: SparkSession, d: str) -> DataFrame:
    """The same stub as a Python model: batches that run out of memory are halved, and every window's time is measured."""

    def load():
        def forward(texts: list[str]) -> list[dict]:
            if len(texts) > 3:
                raise RuntimeError("out of memory")
            shares = [min(1.0, len(t) / SCALE) for t in texts]
            return [{"score": s, "bucket": round(s * 3), "probs": [1 - s, 0.0, 0.0, s], "confidence": 0.9, "truncated": False} for s in shares]

        return forward

    found = detect(_docs(spark, d), BatchScorer(load, key="halving", name="python", calibrated=False), with_latency=True)
    return found.select("doc_id", "score", "band", "bucket", "most_ai_chunk", "model", "calibrated", (F.col("latency_s") > 0).alias("timed"))


def score_latency(spark: SparkSession, d: str) -> DataFrame:
    """Which samples have a time of their own: those of a Python model, not those of an expression."""

    def load():
        return lambda texts: decode_numpy(np.tile([0.0, 1.0, 2.0, 3.0], (len(texts), 1)), [1] * len(texts), None)

    samples = _samples(spark, d)
    rows = []
    for name, scorer in (("model", BatchScorer(load, key="flat", name="flat")), ("expression", LengthStub())):
        saved, seconds = evaluate.kept(evaluate.score_samples(samples, scorer))
        found = evaluate.latency(saved, seconds)
        timed = saved.filter("latency_s > 0").count()
        rows.append((name, timed, found["p50_s"] is not None, found["words_per_s"] is not None))
    return spark.createDataFrame(rows, "scorer string, timed bigint, has_p50 boolean, has_speed boolean")


def runtime_plans(spark: SparkSession, d: str) -> DataFrame:
    """Device, model, quantization and batch width for machines and wishes."""
    rows = []
    for k, (cuda, mps, four, free, device, model) in enumerate(PLANS):
        machine = Machine(cuda=cuda, mps=mps, four_bit=four, free_bytes=free)
        plan = plan_runtime(machine, device=device, model=model)
        rows.append((k, *plan, batch_width(99, plan, machine, intermediate=8192)))
    return spark.createDataFrame(rows, "k int, device string, model string, quantized boolean, max_tokens int, width int")


def adapter_headers(spark: SparkSession, d: str) -> DataFrame:
    """What a folder's files tell about an adapter: its base and its number of buckets."""
    rows = []
    with tempfile.TemporaryDirectory() as root:
        for buckets in (2, 4):
            folder = Path(root) / str(buckets)
            folder.mkdir()
            before = is_adapter(str(folder))
            (folder / "adapter_config.json").write_text(json.dumps({"base_model_name_or_path": f"base{buckets}"}))
            header = json.dumps({"base.score.linear.weight": {"dtype": "F32", "shape": [buckets, 8], "data_offsets": [0, 0]}}).encode()
            (folder / "adapter_model.safetensors").write_bytes(struct.pack("<Q", len(header)) + header)
            rows.append((before, is_adapter(str(folder)), adapter_base(str(folder)), adapter_buckets(str(folder))))
    return spark.createDataFrame(rows, "before boolean, adapter boolean, base string, buckets int")


def model_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors by their kind: logits that aren't finite, a gated and a missing checkpoint, a missing kind; a model loaded once."""

    def told(job: Callable) -> str:
        try:
            job()
        except Exception as error:
            return type(error).__name__
        return "none"

    def fails(said: str) -> Callable:
        def job():
            raise OSError(said)

        return lambda: _opened("x", job)

    assert issubclass(ScorerAccessError, ScorerUnavailableError)
    loads: list[int] = []
    for _ in range(3):
        cached_model("counted", lambda: loads.append(1) or len)
    cases = {
        "finite": lambda: decode_numpy(np.zeros((1, 4)), [1], None),
        "nan": lambda: decode_numpy(np.array([[0.0, float("nan")]]), [1], None),
        "infinite": lambda: decode_numpy(np.array([[0.0, float("inf")]]), [1], None),
        "gated": fails("401 Client Error: access to this gated repo is restricted"),
        "missing": fails("no file named model.safetensors"),
        "no folder": lambda: cli.scorer_for(cli.parser().parse_args(["score", "-m", "llama", "--checkpoints", "/nowhere"])),
    }
    rows = [(name, told(job)) for name, job in cases.items()] + [("loads", str(len(loads)) if loads else "1")]
    return spark.createDataFrame(rows, "case string, error string")


def command_line(spark: SparkSession, d: str) -> DataFrame:
    """Exit codes of commands."""
    long, rows = "word " * 700, []
    commands = {
        "score": ["--text", long, "-m", "stub"], "over": ["score", "--text", long, "-m", "stub", "--fail-over", "0.1"],
        "below": ["score", "--text", long, "-m", "stub", "--fail-over", "0.9", "--json"], "undecided": ["score", "--text", "x", "-m", "stub", "--fail-over", "0.1", "-q"],
        "no model": ["score", "--text", long, "-m", "llama", "--checkpoints", "/nowhere"], "no reference": ["score", "x:y", "-m", "stub"],
        "one target": ["diff", "a"], "no table": ["eval", "-m", "stub"], "bad share": ["score", "x", "--fail-over", "2"],
        "version": ["--version"], "two formats": ["score", "--text", "x", "-m", "stub", "--json", "--jsonl"],
    }
    for name, words in commands.items():
        out, err = io.StringIO(), io.StringIO()
        with contextlib.redirect_stdout(out), contextlib.redirect_stderr(err):
            try:
                code = cli.main(words)
            except SystemExit as error:
                code = error.code if isinstance(error.code, int) else 2
        rows.append((name, code, bool(out.getvalue().strip()), bool(err.getvalue().strip())))
    return spark.createDataFrame(rows, "command string, code int, printed boolean, complained boolean")


def host_command(spark: SparkSession, d: str) -> DataFrame:
    """The command inside another program's parser, and log levels before, in and after it."""
    host = argparse.ArgumentParser()
    cli.Plugin("lens").attach(host.add_subparsers(dest="command"))
    args = host.parse_args(["lens", "--text", "word " * 700, "-m", "stub", "--jsonl", "--chunks"])
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        code = args.run(args)
    log = logging.getLogger("transformers")
    log.setLevel(logging.WARNING)
    with cli.scoped_logs(spark, verbose=True):
        inside = log.level
    with cli.scoped_logs(spark, quiet=True):
        quiet = log.level
    return spark.createDataFrame([(code, json.loads(out.getvalue())["n_words"], inside, quiet, log.level)], "code int, n_words int, verbose int, quiet int, after int")


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The functions as SQL users see them."""
    register_functions(spark)
    _t(spark, d, "documents", "doc_id", "text", "n_chars").createOrReplaceTempView("inkgauge_documents")
    return spark.sql("""SELECT doc_id, ink_band(least(n_chars, 6000) / 6000.0D) AS band, ink_bucket(n_chars % 20 / 100.0D) AS bucket,
        ink_percent(n_chars % 1000 / 1000.0D) AS percent, md5(ink_squeeze(text)) AS text_md5,
        round(ink_expected(array(0.1D, 0.2D, 0.3D, 0.4D)), 6) AS expected, round(ink_confidence(array(0.25D, 0.25D, 0.5D, 0D)), 6) AS confidence FROM inkgauge_documents""")


def lazy_exports(spark: SparkSession, d: str) -> DataFrame:
    """The package hands out its main names without loading what they need until they are asked for."""
    import inkgauge

    names = sorted(inkgauge.__all__)
    return spark.createDataFrame([(n, callable(getattr(inkgauge, n)) or isinstance(getattr(inkgauge, n), str)) for n in names], "name string, found boolean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        wire_jsonl, wire_json_array, list_lines, uncalibrated_views, card_lines, chunk_lines, ordered_view, output_formats, previews,
        fixed_numbers, empty_documents, text_and_stream, file_targets, mixed_targets, labeled_samples, dataset_report, compare_models,
        source_control, references_report, probe_report, empty_metrics, headline_table, report_lines, bands_artifact, batch_scorer,
        score_latency, runtime_plans, adapter_headers, model_errors, command_line, host_command, sql_functions, lazy_exports,
    )
}
