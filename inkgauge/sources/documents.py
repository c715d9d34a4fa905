"""Inputs as DataFrames with an explicit ordinal, since results keep the order of their inputs."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Mapping, Sequence
from pathlib import Path
from typing import Any, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import score_to_bucket
from ..functions.text import PREVIEW_SAMPLE, clean_text, preview, words
from ..operators.prose import label, resolve_prose
from ..operators.stats import seeded_sample
from . import references

#: One row per document to score or skip.
TARGET = "ordinal long, ref string, source string, label string, text string, reason string"
REFERENCE = "ordinal long, source string, label string, content string, prose string, prose_authors array<string>, metadata map<string,string>"
#: Longer targets are never looked up as paths.
MAX_PATH = 4096

_resolver: Callable[[str], Iterable[Mapping[str, Any]]] | None = None


class ResolverMissingError(ModuleNotFoundError):
    """A target is no file and nothing is registered that could resolve it."""


def register_resolver(resolve: Callable[[str], Iterable[Mapping[str, Any]]] | None) -> None:
    """Set what turns a reference (a URL, say) into 0 or more documents: mappings with the fields of REFERENCE."""
    global _resolver
    _resolver = resolve


def from_text(spark: SparkSession, content: str, *, name: str = "(text)") -> DataFrame:
    """One literal text."""
    return spark.createDataFrame([(0, None, None, name, content, None)], TARGET)


def from_stdin(spark: SparkSession, stream: TextIO | None = None) -> DataFrame:
    return from_text(spark, (stream or sys.stdin).read(), name="(stdin)")


def from_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One document per file or glob match; bytes that are no UTF-8 become replacement characters.

    Executors read the files. Ordinals follow the paths: only these are sorted, and texts are joined to them.
    """
    files = spark.read.format("binaryFile").load(list(paths)).select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    numbers = files.select("path").orderBy("path").withColumn("ordinal", F.monotonically_increasing_id())
    numbered = files.join(numbers, "path")
    return numbered.select("ordinal", F.col("path").alias("ref"), F.col("path").alias("source"), F.col("path").alias("label"), "text", F.lit(None).cast("string").alias("reason"))


#: Documents that one target may resolve to: a target's ordinals start at its number times this.
PER_TARGET = 1 << 32


def resolve_references(spark: SparkSession, targets: Sequence[tuple[int, str]]) -> DataFrame:
    """Resolved documents (REFERENCE) of numbered targets, resolved on the executors side by side.

    Ordinals keep the order of the numbers and of the documents of each.
    """
    if _resolver is None:
        raise ResolverMissingError(f"{targets[0][1]!r} is no file, and no resolver is registered")
    references.register(spark, _resolver)
    found = spark.read.format("references").option("targets", json.dumps([t for _, t in targets])).load()
    numbers = F.array(*[F.lit(n) for n, _ in targets])
    ordinal = F.get(numbers, F.col("target")).cast("bigint") * PER_TARGET + F.col("doc")
    return found.select(ordinal.alias("ordinal"), "source", "label", "content", "prose", "prose_authors", "metadata")


def from_references(refs: DataFrame, *, split: bool = False) -> DataFrame:
    """References as targets: text or the reason why there is none."""
    out = resolve_prose(refs, split=split)
    return out.select("ordinal", F.col("source").alias("ref"), "source", label().alias("label"), "text", F.col("skip_reason").alias("reason"))


def from_targets(spark: SparkSession, targets: Sequence[str], *, split: bool = False, stream: TextIO | None = None) -> DataFrame:
    """A mixed list: ``-`` is standard input, an existing file is read, anything else is a reference. Order is kept."""
    rows, others = [], []
    for k, target in enumerate(targets):
        if target == "-":
            rows.append((k * PER_TARGET, None, None, "(stdin)", (stream or sys.stdin).read(), None))
        elif len(target) < MAX_PATH and Path(target).is_file():
            rows.append((k * PER_TARGET, target, target, target, Path(target).read_text(errors="replace"), None))
        else:
            others.append((k, target))
    out = spark.createDataFrame(rows, TARGET)
    return out.unionByName(from_references(resolve_references(spark, others), split=split)) if others else out


def labeled_samples(df: DataFrame, n: int, *, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows of a table with text, cosine_score and perhaps source_text, with gt_bucket and n_words."""
    some = seeded_sample(df, key, n, seed)
    if "source_text" not in some.columns:
        some = some.withColumn("source_text", F.lit(None).cast("string"))
    return some.select(
        F.col(key).alias("sample_id"),
        "text",
        F.col("cosine_score").cast("double").alias("cosine_score"),
        score_to_bucket(F.col("cosine_score").cast("double")).alias("gt_bucket"),
        F.size(words(clean_text("text"))).alias("n_words"),
        preview("text", PREVIEW_SAMPLE).alias("preview"),
        "source_text",
    )


def gradient_samples(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """Bundled texts in a fixed order, from a text that was not edited to one that was rewritten."""
    missing = [n for n in names if not (Path(folder) / n).is_file()]
    if missing:
        raise FileNotFoundError(f"sample texts not found in {folder}: {', '.join(missing)}")
    return spark.createDataFrame([(k, n, (Path(folder) / n).read_text()) for k, n in enumerate(names)], "ordinal long, label string, text string")
