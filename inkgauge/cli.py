"""Command line: ``score`` (the default), ``diff`` and ``eval``.

Exit codes: 0 fine, 1 a model or input is missing, 2 wrong use, 3 the gate tripped, 4 the gate found nothing reliable.
"""

from __future__ import annotations

import argparse
import logging
import sys
import warnings
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import __version__
from .operators.bands import DEFAULT, bands_from_artifact
from .operators.detect import gate
from .plans import evaluate
from .plans.score import score_targets
from .scorers import ScorerUnavailableError, chosen_scorer
from .sinks import report, tables
from .sources import documents
from .workspace import Workspace

COMMANDS = ("score", "diff", "eval")
GATE_TRIPPED, GATE_UNDECIDED = 3, 4
GRADIENT = ("human.txt", "edit_light.txt", "edit_vivid.txt", "edit_rewrite.txt")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="inkgauge", description="Score texts for the extent of AI editing.")
    top.add_argument("--version", action="version", version=__version__)
    kinds = top.add_subparsers(dest="command", required=True)
    model = argparse.ArgumentParser(add_help=False)
    model.add_argument("-m", "--model", default="auto", help="auto, llama, roberta, stub (scores by length), or a checkpoint that transformers can load")
    model.add_argument("--checkpoints", help="folder with a folder per kind of model (or INKGAUGE_CHECKPOINTS)")
    model.add_argument("--base", help="tokenizer or base checkpoint, if another one")
    model.add_argument("--device", help="device of the workers: cuda, cuda:N, mps, cpu")
    model.add_argument("--no-quantize", action="store_true", help="no 4-bit weights")
    model.add_argument("-q", "--quiet", action="store_true", help="say nothing beside the result")
    model.add_argument("-v", "--verbose", action="store_true", help="show the log of Spark and of the model's libraries")
    form = argparse.ArgumentParser(add_help=False)
    form.add_argument("-f", "--format", choices=("json", "jsonl", "md"))
    form.add_argument("--json", action="store_true")
    form.add_argument("--jsonl", action="store_true")
    form.add_argument("--split", action="store_true", help="score prose of several authors, too")

    score = kinds.add_parser("score", parents=[model, form])
    score.add_argument("targets", nargs="*", help="files, references, or - for standard input")
    score.add_argument("--text", help="score this text")
    score.add_argument("--chunks", action="store_true")
    score.add_argument("--bands", help="a calibration artifact to band by")
    score.add_argument("--fail-over", type=share, help="exit 3 if a reliable score is above this")

    diff = kinds.add_parser("diff", parents=[model, form])
    diff.add_argument("targets", nargs="+")

    ev = kinds.add_parser("eval", parents=[model])
    ev.add_argument("targets", nargs="*", help="references for the unlabeled reading; none: the labeled table")
    ev.add_argument("--table", help="labeled table (Parquet: text, cosine_score, perhaps source_text)")
    ev.add_argument("--key", default="doc_id")
    ev.add_argument("-n", "--samples", type=int, default=200)
    ev.add_argument("--seed", type=int, default=0)
    ev.add_argument("--split", default="test", help="name of the split, for the report")
    ev.add_argument("--split-authors", action="store_true")
    pair = ev.add_mutually_exclusive_group()
    pair.add_argument("--against", help="a second model, for a paired comparison")
    pair.add_argument("--compare-quant", dest="compare", action="store_const", const="quant", help="compare with and without 4-bit weights")
    pair.add_argument("--compare-models", dest="compare", action="store_const", const="models", help="compare the two kinds of model")
    ev.add_argument("--boot", type=int, default=1000, help="resamplings for the intervals")
    ev.add_argument("--all", action="store_true", help="short texts, too")
    ev.add_argument("--with-source", action="store_true")
    ev.add_argument("--write-bands")
    ev.add_argument("--markdown", action="store_true")
    ev.add_argument("--smoke", metavar="FOLDER", help="probe with the sample texts of a folder")
    ev.add_argument("--json", action="store_true")
    return top


def with_default_command(args: Sequence[str]) -> list[str]:
    """``score`` stands before arguments that don't begin with a command or an option of the top level."""
    first = args[0] if args else ""
    return list(args) if first in (*COMMANDS, "-h", "--help", "--version") else ["score", *args]


def share(text: str) -> float:
    """A number from 0 to 1."""
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError(f"{text} is not between 0 and 1")
    return value


def scorer_for(args: argparse.Namespace, name: str | None = None) -> Any:
    quantize = False if args.no_quantize else None
    return chosen_scorer(name or args.model, checkpoints=args.checkpoints, base=args.base, device=args.device, quantize=quantize)


@contextmanager
def scoped_logs(spark: Any, *, verbose: bool = False, quiet: bool = False) -> Iterator[None]:
    """Log levels and warnings of this process for one command; what was set before comes back after it."""
    root = logging.getLogger("transformers")
    before, level = root.level, logging.INFO if verbose else logging.ERROR
    shown = spark.conf.get("spark.log.level", None) or "WARN"
    spark.sparkContext.setLogLevel("INFO" if verbose else "OFF" if quiet else "ERROR")
    root.setLevel(level)
    with warnings.catch_warnings():
        if not verbose:
            warnings.simplefilter("ignore")
        try:
            yield
        finally:
            root.setLevel(before)
            spark.sparkContext.setLogLevel(shown)


def chosen_format(args: argparse.Namespace) -> str:
    chosen = {x for x in (args.format, "json" if args.json else None, "jsonl" if args.jsonl else None) if x}
    if len(chosen) > 1:
        raise SystemExit("pick one of --format, --json and --jsonl")
    return chosen.pop() if chosen else "human"


def show(results: DataFrame, form: str, *, chunks: bool = False, deltas: bool = False) -> str:
    """Results in exactly one format."""
    if form != "human":
        return report.view(results, form, deltas=deltas)
    if deltas:
        return report.view(results, "diff")
    parts = [report.view(results, "card" if results.count() == 1 else "list"), chunks and report.view(results, "chunks")]
    return "\n".join(p for p in parts if p)


def gate_code(results: DataFrame, threshold: float) -> tuple[int, str]:
    """Exit code and what to say: skipped and unreliable results never trip the gate."""
    found = gate(results, threshold).first()
    if not found["scored"]:
        return GATE_UNDECIDED, f"gate at {threshold}: no reliable score to decide by"
    return found["exit_code"], f"gate at {threshold}: {found['over']} of {found['scored']} above"


def run_eval(spark: Any, args: argparse.Namespace) -> str:
    if args.smoke:
        found = evaluate.gradient_probe(documents.gradient_samples(spark, args.smoke, GRADIENT), scorer_for(args))
    elif args.targets:
        results = score_targets(documents.from_targets(spark, args.targets, split=args.split_authors), scorer_for(args))
        found = evaluate.eval_references(Workspace(spark).save(results, "results"), reliable_only=not args.all)
    else:
        if not args.table:
            raise FileNotFoundError("eval needs --table, references, or --smoke")
        samples = documents.labeled_samples(spark.read.parquet(args.table), args.samples, key=args.key, seed=args.seed)
        samples = Workspace(spark).save(samples, "samples")
        against = scorer_for(args, args.against) if args.against else args.compare
        found = evaluate.eval_dataset(
            samples, scorer_for(args), against=against, reliable_only=not args.all, with_source=args.with_source, split=args.split,
            seed=args.seed, n_boot=args.boot,
        )
        if args.write_bands:
            tables.write_bands(evaluate.bands_artifact(found, dataset=args.table), args.write_bands)
        if args.markdown:
            return report.benchmark_view(found, f"inkgauge eval --table {args.table} -n {found['n_total']} --seed {args.seed} --split {args.split} --model {args.model}")
    return report.to_json(found) if args.json else report.report_view(found)


def main(argv: Sequence[str] | None = None) -> int:
    return execute(parser().parse_args(with_default_command(sys.argv[1:] if argv is None else argv)))


def execute(args: argparse.Namespace) -> int:

    if args.command == "diff" and len(args.targets) < 2:
        print("diff needs at least two targets", file=sys.stderr)
        return 2
    if args.command == "score" and args.text is None and not args.targets and sys.stdin.isatty():
        print("nothing to score: give files, references, --text, or pipe a text in", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("inkgauge").getOrCreate()
    with scoped_logs(spark, verbose=args.verbose, quiet=args.quiet):
        try:
            return run(spark, args)
        except (ScorerUnavailableError, ModuleNotFoundError, FileNotFoundError) as error:
            print(error, file=sys.stderr)
            return 1


def run(spark: Any, args: argparse.Namespace) -> int:
    """A parsed command."""
    if args.command == "eval":
        print(run_eval(spark, args))
        return 0
    form, scorer = chosen_format(args), scorer_for(args)
    raw = getattr(args, "text", None)
    if raw is not None:
        targets = documents.from_text(spark, raw)
    elif args.targets:
        targets = documents.from_targets(spark, args.targets, split=args.split)
    else:
        targets = documents.from_stdin(spark)
    artifact = getattr(args, "bands", None)
    bands = bands_from_artifact(tables.read_bands(artifact)) if artifact else DEFAULT
    # saved: several views read the results, and the model runs once
    results = Workspace(spark).save(score_targets(targets, scorer, bands=bands), "results")
    print(show(results, form, chunks=getattr(args, "chunks", False), deltas=args.command == "diff"))
    if getattr(args, "fail_over", None) is None:
        return 0
    code, said = gate_code(results, args.fail_over)
    if not args.quiet:
        print(said, file=sys.stderr)
    return code


class Plugin:
    """The ``score`` command for another program's argparse command line: ``Plugin("lens").attach(subparsers)``."""

    def __init__(self, name: str = "lens"):
        self.name = name

    def attach(self, commands: Any) -> None:
        """Add the command; the host calls ``args.run(args)`` of what it parsed, which returns the exit code."""
        own = next(a for a in parser()._actions if isinstance(a, argparse._SubParsersAction)).choices["score"]
        command = commands.add_parser(self.name, parents=[own], add_help=False, help="score texts for the extent of AI editing")
        command.set_defaults(run=self.run)

    def run(self, args: argparse.Namespace) -> int:
        return execute(argparse.Namespace(**{**vars(args), "command": "score"}))


if __name__ == "__main__":
    sys.exit(main())
