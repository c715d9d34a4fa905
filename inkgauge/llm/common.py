"""What the operators share: text as they read it, tables of Python workers, and the engine's tables and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.skew import HOT_SHARE, lookup, split_join
from ..workspace import Workspace, shared_dir

__all__ = ["HOT_SHARE", "Workspace", "lookup", "shared_dir", "split_join", "squeeze", "text_or_empty", "worker_table"]

#: ASCII white space runs other than one plain space.
_ODD_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

_table: dict = {}


def worker_table(key, make):
    """The table of this Python worker: made once and kept for the tasks that follow, until another key is asked for.

    A worker serves the stages of several operators in turn; only the last one's table takes memory.
    """
    if key not in _table:
        _table.clear()
        _table[key] = make()
    return _table[key]


def text_or_empty(col):
    """Text as string; null counts as empty."""
    return F.coalesce(col.cast("string"), F.lit(""))


def squeeze(col):
    """Replace each run of ASCII white space by one space; a lone space needs no rewriting."""
    return F.regexp_replace(text_or_empty(col), _ODD_SPACE, " ")
