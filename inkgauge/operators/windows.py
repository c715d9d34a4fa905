"""Tumbling word windows: by word position, without overlap, the last one may be short."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let_sql

WINDOW_WORDS = 350


def window_array(words: str, size: int = WINDOW_WORDS) -> Column:
    """Array of (index, text, n_words, word_start, word_end) from a column of words; empty for no words, null for null."""
    end = f"least(b + {size}, size(w))"
    window = (
        f"named_struct('index', CAST(i AS INT), 'text', array_join(slice(w, b + 1, {size}), ' '), 'n_words', CAST({end} - b AS INT), "
        f"'word_start', CAST(b AS INT), 'word_end', CAST({end} AS INT))"
    )
    # for no words the sequence has one start, which the slice takes away: sequence() would count downwards
    starts = f"slice(sequence(0, greatest(size(w) - 1, 0), {size}), 1, CAST(ceil(size(w) / {size}) AS INT))"
    return F.expr(let_sql("w", f"`{words}`", f"CASE WHEN w IS NOT NULL THEN transform({starts}, (b, i) -> {window}) END"))


def explode_windows(df: DataFrame, *keys: str, windows_col: str = "windows") -> DataFrame:
    """One row per window, with the named key columns.

    The outer form, and a filter behind it: for the plain form the optimizer infers a filter on the array's size and pushes
    it below the projections, so that the whole cleaning is computed twice.
    """
    return df.select(*keys, F.inline_outer(windows_col)).filter(F.col("index").isNotNull())


def regroup(df: DataFrame, *keys: str, as_col: str = "chunks") -> DataFrame:
    """Rows with an ``index`` back to one array per key, in the order of the index."""
    rest = [c for c in df.columns if c not in keys and c != "index"]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("index", *rest))).alias(as_col))
