"""Licence scans by canonical digests of entire texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .licence_texts import LICENCES, forms

#: Known texts up to this many are broadcast; a larger table meets the documents in a shuffle.
MAX_BROADCAST = 20_000

#: A line that only names who holds the copyright, or that reserves rights.
COPYRIGHT_LINE = (
    r"(?:^|\n)[^a-z0-9\n]*(?:(?:(?:copyright[ \t]*)?(?:\(c\)|©|copyright[ \t]+[0-9])|spdx-)[^\n]*|all rights reserved[^a-z0-9\n]*)"
)

#: Words that follow "copyright" where a licence's sentence runs on from the line above. Fixed values.
_PROSE = (
    r"(?:and|are|disclaimer|doctrines|each|holders?|if|in|interests?|laws?|licen[cs]es?|notices?|of|on|or|owners?|ownership|permissions?|"
    r"protection|resulting|statements?|treaty|under)\b|the(?:[ \t]*(?:\n|$)|[ \t]+(?:software|library|program)\b)"
)

#: The same and any other line that begins with "copyright" and names a holder. (The SQL twin, without lookahead, keeps those.)
HOLDER_LINE = rf"{COPYRIGHT_LINE}|(?:^|\n)[^a-z0-9\n]*copyright:?[ \t]+(?!{_PROSE})[^ \t\n][^\n]*"

#: Spellings that count as equal, British first (parts of words, so that endings follow). Fixed values.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authoris": "authoriz",
    "calibre": "caliber",
    "cancell": "cancel",
    "capitalis": "capitaliz",
    "catalogue": "catalog",
    "categoris": "categoriz",
    "centre": "center",
    "favour": "favor",
    "fulfil ": "fulfill ",
    "initialis": "initializ",
    "judgement": "judgment",
    "labell": "label",
    "licenc": "licens",
    "maximis": "maximiz",
    "modell": "model",
    "offence": "offense",
    "optimis": "optimiz",
    "organis": "organiz",
    "practis": "practic",
    "programme ": "program ",
    "realis": "realiz",
    "recognis": "recogniz",
    "signall": "signal",
    "sub license": "sublicense",
    "sub licens": "sublicens",
    "utilis": "utiliz",
    "whilst": "while",
    "wilful": "willful",
}


def canonical(text: Column) -> Column:
    """Case, copyright lines, punctuation, white space and equivalent spellings made alike."""
    out = F.lower(text_or_empty(text))
    out = F.regexp_replace(out, HOLDER_LINE, "\n")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    out = F.concat(out, F.lit(" "))
    for one, other in SPELLINGS.items():
        out = F.replace(out, F.lit(one), F.lit(other))
    return F.trim(out)


def known_digests(df: DataFrame, known: Mapping[str, str]) -> DataFrame:
    """Table of licence_id and canonical_sha256 of all forms; of licences with equal canonical texts the first id stays."""
    spark = df.sparkSession
    rows = spark.createDataFrame([(k, t) for k, v in sorted(known.items()) for t in forms(k, v)], "licence_id string, text string")
    rows = rows.select("licence_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    return rows.groupBy("canonical_sha256").agg(F.min("licence_id").alias("licence_id"))


def scan(docs: DataFrame, *, known: Mapping[str, str] = LICENCES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find the documents that are, as a whole, a known licence.

    The canonical text's SHA-256 is joined with the digests of the known licences in the same form, so a match is exact
    up to case, punctuation, line breaks, copyright lines, equivalent spellings and a licence's title.  The known table's size is checked:
    up to MAX_BROADCAST it is broadcast and the documents don't move.

    Returns per row: ``id_col``, licence_id (null where none matches), canonical_sha256, canonical_chars.

    Null text counts as empty; a text that is empty in canonical form matches nothing.  Null and repeated ids are kept row
    by row.  Other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col), canonical(F.col(text_col)).alias("__canonical")).select(
        id_col, F.sha2("__canonical", 256).alias("canonical_sha256"), F.char_length("__canonical").cast("bigint").alias("canonical_chars")
    )
    table = known_digests(docs, {k: v for k, v in known.items() if v and v.strip()})
    if len(known) <= MAX_BROADCAST:
        table = F.broadcast(table)
    return rows.join(table, "canonical_sha256", "left").select(id_col, "licence_id", "canonical_sha256", "canonical_chars")
