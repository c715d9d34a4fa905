"""Score targets: skipped ones stay with nulls, the others get a detection; ``ordinal`` keeps the order of the input."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bands import DEFAULT, Band
from ..operators.detect import DETECTION_COLUMNS, detect, wire

RESULT_COLUMNS = ("ordinal", "ref", "source", "label", *DETECTION_COLUMNS, "skipped", "reason", "preview")


def score_targets(targets: DataFrame, scorer: Any, *, bands: Sequence[Band] = DEFAULT) -> DataFrame:
    """Results with RESULT_COLUMNS for rows as the sources make them (sources.documents.TARGET).

    Skipped rows are set apart before the scorer, which only ever sees texts, and joined by a union, without a shuffle.
    Rows are not sorted here: a sort samples its input first, and so runs the model twice. Sinks order what they show.
    """
    pending = targets.filter(F.col("reason").isNull())
    found = wire(detect(pending.drop("reason"), scorer, bands=bands))
    found = found.withColumn("skipped", F.lit(False)).withColumn("reason", F.lit(None).cast("string"))
    skipped = targets.filter(F.col("reason").isNotNull()).withColumn("skipped", F.lit(True)).drop("text")
    return found.unionByName(skipped, allowMissingColumns=True).select(*RESULT_COLUMNS)


def score_documents(docs: DataFrame, scorer: Any, *, bands: Sequence[Band] = DEFAULT, text_col: str = "text") -> DataFrame:
    """A detection per document of a table, with the table's other columns; no shuffle."""
    return detect(docs, scorer, text_col=text_col, bands=bands)
