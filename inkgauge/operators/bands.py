"""Score bands: a small ordered table of upper bounds and labels."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binding import let_sql, quoted

#: Colours by position. Fixed values.
COLOURS = ("green", "yellow", "dark_orange", "red", "red")
KIND = "inkgauge-bands"


class Band(NamedTuple):
    below: float  # exclusive
    label: str
    colour: str


#: The default table. Fixed values.
DEFAULT = (
    Band(0.30, "human", "green"),
    Band(0.55, "lightly edited", "yellow"),
    Band(0.75, "moderately edited", "dark_orange"),
    Band(0.90, "heavily edited", "red"),
    Band(float("inf"), "fully AI", "red"),
)
UNRELIABLE = "unreliable"


def band_for(score: float, bands: Sequence[Band] = DEFAULT) -> Band:
    """The first band whose bound is above the score; else the last (so NaN gets the last)."""
    return next((b for b in bands if score < b.below), bands[-1])


def band_sql(score: str, bands: Sequence[Band] = DEFAULT) -> str:
    """The same as SQL; null for null. Five bounds cost less than any join."""
    cases = " ".join(f"WHEN s < {b.below!r}D AND NOT isnan(s) THEN {quoted(b.label)}" for b in bands[:-1])
    return let_sql("s", score, f"CASE WHEN s IS NULL THEN NULL {cases} ELSE {quoted(bands[-1].label)} END")


def band_label(score: str, bands: Sequence[Band] = DEFAULT) -> Column:
    """The band of a column's score."""
    return F.expr(band_sql(f"`{score}`", bands))


def band_table(spark: SparkSession, bands: Sequence[Band] = DEFAULT) -> DataFrame:
    """The bands as rows (low, high, label) with low <= score < high; null high: no bound."""
    lows = [float("-inf"), *(b.below for b in bands[:-1])]
    rows = [(low, None if b.below == float("inf") else b.below, b.label) for low, b in zip(lows, bands)]
    return spark.createDataFrame(rows, "low double, high double, label string")


def join_bands(df: DataFrame, score_col: str, bands: Sequence[Band] = DEFAULT) -> DataFrame:
    """Range join with the band table (a handful of rows, so it is broadcast): adds ``label``."""
    table = F.broadcast(band_table(df.sparkSession, bands))
    s = df[score_col]
    return df.join(table, (s >= table["low"]) & (table["high"].isNull() | (s < table["high"])), "left").drop("low", "high")


#: What a calibration artifact must hold; each entry tells what is wrong where the test fails.
_RULES = {
    "kind should end with -bands": lambda a: isinstance(a.get("kind"), str) and a["kind"].endswith("-bands"),
    "version should be 1": lambda a: a.get("version") == 1,
    "degenerate should not be set": lambda a: not a.get("degenerate"),
    f"cuts should be {len(COLOURS) - 1} pairs of lt and band": lambda a: len(_cuts(a)) == len(COLOURS) - 1 == len(a["cuts"]),
    "bounds should not fall": lambda a: (b := [x for x, _ in _cuts(a)]) == sorted(b),
}


def _cuts(artifact: dict) -> list[tuple[float, str]]:
    """The well-formed cuts of an artifact."""
    rows = artifact.get("cuts")
    rows = rows if isinstance(rows, list) else []
    return [(float(r["lt"]), str(r["band"])) for r in rows if isinstance(r, dict) and isinstance(r.get("lt"), (int, float)) and "band" in r]


def bands_from_artifact(artifact: dict) -> tuple[Band, ...]:
    """Bands from a calibration artifact; a ValueError lists all that is wrong with it."""
    faults = [rule for rule, holds in _RULES.items() if not holds(artifact)]
    if faults:
        raise ValueError(f"unusable bands artifact: {'; '.join(faults)}")
    ends = [*_cuts(artifact), (float("inf"), artifact.get("top_band", DEFAULT[-1].label))]
    return tuple(Band(bound, label, colour) for (bound, label), colour in zip(ends, COLOURS))
