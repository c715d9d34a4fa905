"""Bind a value to a name inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column | str, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once and written once, however often the body names it.

    When the optimizer moves a filter below projections it replaces column names by their expressions; where each
    expression names its input once, a chain of projections then grows by addition and not by multiplication.
    """
    return F.get(F.transform(F.array(as_column(value)), body), F.lit(0))


def quoted(text: str) -> str:
    """A string literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let_sql(name: str, value: str, body: str) -> str:
    """The same as SQL: ``body`` with ``value`` under ``name``. One text costs one call to the JVM, a tree of Columns hundreds."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"
