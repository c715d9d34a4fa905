"""What of a resolved reference is scored, and what a reference is called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import generic_strip

NO_LABEL = "<ref>"


def skip_reason(split: bool = False) -> Column:
    """Why a reference (prose, prose_authors, metadata) is skipped; null if it is scored. The first reason counts."""
    failed = F.coalesce(F.try_element_at(F.col("metadata"), F.lit("transcript_error")), F.lit("")) != ""
    authors = F.coalesce(F.size("prose_authors"), F.lit(0))
    several = F.lit(not split) & F.col("prose").isNotNull() & (authors > 1)
    return (
        F.when(failed, "transcription failed")
        .when(F.col("prose") == "", "no prose")
        .when(several, F.concat(authors.cast("string"), F.lit(" authors (pass --split)")))
    )


def resolve_prose(refs: DataFrame, *, split: bool = False) -> DataFrame:
    """Add ``text`` and ``skip_reason``; exactly one of them is null. Without prose the stripped content is the text."""
    out = refs.withColumn("skip_reason", skip_reason(split))
    text = F.when(F.col("skip_reason").isNull(), F.coalesce(F.col("prose"), generic_strip("content")))
    return out.withColumn("text", text)


def label() -> Column:
    """The label, or the source, or a placeholder; empty strings fall through."""
    empty = F.lit("")
    return F.coalesce(F.nullif(F.col("label"), empty), F.nullif(F.col("source"), empty), F.lit(NO_LABEL))


def delta_from_first(df: DataFrame, *keys: str, order: str, score: str = "score") -> DataFrame:
    """Add ``delta``: points from the first scored row of its group; null for that row itself and for unscored ones.

    The baseline comes from an aggregate with partial results, not from a window over a whole group.
    """
    scored = df.filter(F.col(score).isNotNull())
    agg = F.min(F.struct(order, score)).alias("__b")
    first = scored.groupBy(*keys).agg(agg) if keys else scored.agg(agg)
    joined = df.join(first, list(keys), "left") if keys else df.crossJoin(F.broadcast(first))
    base = F.when(F.col(order) != F.col("__b")[order], (F.col(score) - F.col("__b")[score]) * 100)
    return joined.withColumn("delta", base).drop("__b")
