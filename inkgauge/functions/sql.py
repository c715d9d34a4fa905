"""The scalar functions for users of SQL: temporary functions whose bodies are SQL, so that the optimizer sees through them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..operators.bands import DEFAULT, Band, band_sql
from .binding import quoted
from .numeric import ENTROPY_FLOOR
from .text import SPACE


def definitions(bands: Sequence[Band] = DEFAULT) -> dict[str, str]:
    """Name -> what follows CREATE FUNCTION: parameters, type and body."""
    return {
        "ink_band": f"(score DOUBLE) RETURNS STRING RETURN {band_sql('score', bands)}",
        "ink_bucket": "(similarity DOUBLE) RETURNS INT RETURN CASE WHEN similarity <= 0.03D THEN 0 WHEN similarity >= 0.15D THEN 3 "
        "ELSE CAST(1 + floor((similarity - 0.03D) / (0.15D - 0.03D) * 2) AS INT) END",
        "ink_percent": "(share DOUBLE) RETURNS INT RETURN CAST(rint(share * 100) AS INT)",
        "ink_squeeze": f"(raw STRING) RETURNS STRING RETURN trim(regexp_replace(raw, {quoted(SPACE + '+')}, ' '))",
        "ink_expected": "(probs ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(transform(probs, (p, i) -> p * i), 0D, (s, x) -> s + x) / (size(probs) - 1)",
        "ink_confidence": f"(probs ARRAY<DOUBLE>) RETURNS DOUBLE RETURN 1 + aggregate(probs, 0D, (s, p) -> s + p * ln(greatest(p, {ENTROPY_FLOOR!r}D))) / ln(CAST(size(probs) AS DOUBLE))",
    }


def register_functions(spark: SparkSession, bands: Sequence[Band] = DEFAULT) -> list[str]:
    """Make the functions known to ``spark.sql``; returns their names. ``bands`` are what ink_band tells."""
    for name, rest in definitions(bands).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{rest}")
    return list(definitions(bands))
