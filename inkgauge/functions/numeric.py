"""Numbers: exact rounding, guarded division, decoding of bucket logits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import as_column as _col
from .binding import let, let_sql

#: Probabilities are raised to this inside the logarithm of the entropy, and only there.
ENTROPY_FLOOR = 1e-9


def round_sql(x: str, places: int) -> str:
    """Round the exact binary value, halves to even, as Python's ``round``; as SQL.

    Scaled by 10^places the value is a product p with a rounding error e, which two-part multiplication gives exactly;
    only where p lies on a half does the sign of e decide.
    """
    scale = f"{10**places}D"
    high = "(v * 134217729D - (v * 134217729D - v))"  # 2^27 + 1 cuts a double into two halves
    error = f"(({high} * {scale} - v * {scale}) + (v - {high}) * {scale})"
    low, near = f"CAST(floor(v * {scale}) AS DOUBLE)", f"rint(v * {scale})"
    exact = f"CASE WHEN {error} > 0 THEN {low} + 1 WHEN {error} < 0 THEN {low} ELSE {near} END"
    return let_sql("v", f"CAST({x} AS DOUBLE)", f"CASE WHEN v * {scale} - {low} = 0.5D THEN {exact} ELSE {near} END / {scale}")


def round_exact(c: Column | str, places: int) -> Column:
    """:func:`round_sql` of a column or expression."""
    if isinstance(c, str):
        return F.expr(round_sql(f"`{c}`", places))
    return F.call_function("get", F.transform(F.array(c.cast("double")), lambda x: _rounded(x, places)), F.lit(0))


def _rounded(x: Column, places: int) -> Column:
    scale = float(10**places)
    high = x * 134217729.0 - (x * 134217729.0 - x)
    error = (high * scale - x * scale) + (x - high) * scale
    low, near = F.floor(x * scale).cast("double"), F.rint(x * scale)
    return F.when((x * scale - low) == 0.5, F.when(error > 0, low + 1).when(error < 0, low).otherwise(near)).otherwise(near) / scale


def safe_divide(a: Column, b: Column) -> Column:
    """Null where the divisor is 0."""
    return F.try_divide(a, b)


def softmax(logits: Column | str) -> Column:
    """Probabilities of an array of logits; an error where a logit is NaN or infinite."""

    def powers(x: Column) -> Column:
        bad = F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull())
        some = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
        return F.when(bad, F.raise_error(F.lit("non-finite logits")).cast("array<double>")).otherwise(some)

    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(e, lambda v: v / total))

    return let(let(logits, powers), shares)


def expected_score(probs: Column | str) -> Column:
    """Expected bucket over the last bucket's number: 0 to 1."""
    return let(probs, lambda p: F.aggregate(F.transform(p, lambda v, i: v * i), F.lit(0.0), lambda s, v: s + v) / (F.size(p) - 1))


def confidence(probs: Column | str) -> Column:
    """One minus the entropy relative to that of the flat distribution."""
    term = lambda v: v * F.ln(F.greatest(v, F.lit(ENTROPY_FLOOR)))
    return let(probs, lambda p: 1.0 + F.aggregate(p, F.lit(0.0), lambda s, v: s + term(v)) / F.ln(F.size(p).cast("double")))


def argmax(probs: Column | str) -> Column:
    """First index of the largest value."""
    return let(probs, lambda p: (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def score_to_bucket(score: Column | str, *, low: float = 0.03, high: float = 0.15, n_buckets: int = 4) -> Column:
    """Ordinal bucket of a similarity score: ends closed, equal steps between."""
    inner = lambda s: 1 + F.floor((s - low) / (high - low) * (n_buckets - 2))
    return let(score, lambda s: F.when(s <= low, 0).when(s >= high, n_buckets - 1).otherwise(inner(s)).cast("int"))


def percent(c: Column | str) -> Column:
    """A share as whole percent, halves to even."""
    return F.rint(_col(c) * 100).cast("int")


def fixed(c: Column | str, places: int = 3) -> Column:
    """Fixed decimals, a dash for null and NaN."""
    shown = lambda x: F.format_string(f"%.{places}f", round_exact(x, places))
    return let(_col(c).cast("double"), lambda x: F.when(x.isNull() | F.isnan(x), "—").otherwise(shown(x)))
