"""Text normalisation as Column functions; all stay inside the JVM."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import as_column as _col
from .binding import let
from .emoji import EMOJI_CLASS, MAYBE_EMOJI, TOKEN, emoji_names

#: The 29 code points that count as white space, as a character class for the JVM's regex.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: Openings of boilerplate first lines. Fixed values, case-sensitive, without word boundary.
BOILERPLATE = ("Sure", "Here", "Abstract", "Title", "I'm happy to help", "Certainly")

PREVIEW_RESULT, PREVIEW_SAMPLE, PREVIEW_CHUNK, PREVIEW_WIRE_CHUNK = 60, 80, 160, 120


def strip(c: Column | str) -> Column:
    """Remove white space at both ends."""
    return F.regexp_replace(F.regexp_replace(_col(c), f"^{SPACE}+", ""), f"{SPACE}+\\z", "")


def normalize_whitespace(c: Column | str) -> Column:
    """Each run of white space becomes one space; none at the ends."""
    # after the first step only plain spaces are left, so trim sees all of them
    return F.trim(F.regexp_replace(_col(c), f"{SPACE}+", " "))


def normalize_emoji(c: Column | str, more: Mapping[str, str] | None = None) -> Column:
    """Each emoji becomes ``:its_name:``; texts without any are passed on by a cheap test.

    The longest sequence counts: skin tones, joined persons, flags and keycaps have one name. A sequence without a name is
    spelled part by part. A presentation selector belongs to the emoji before it. ``more``: names that go before the rules'.
    """
    names = F.from_json(F.lit(json.dumps(emoji_names(more))), "map<string,string>")  # folded to a constant by the optimizer
    known = lambda x: F.try_element_at(names, x)

    def by_part(token: Column) -> Column:
        return F.array_join(F.transform(F.split(token, ""), lambda x: F.coalesce(known(x), x)), "")

    def named(token: Column) -> Column:
        emoji = token.rlike(f"^(?:{EMOJI_CLASS}|[\\x{{1F1E6}}-\\x{{1F1FF}}]|[0-9#*]\\x{{FE0F}}?\\x{{20E3}})")
        bare = F.regexp_replace(token, "\\x{FE0F}", "")
        return F.when(emoji, let(bare, lambda b: F.coalesce(known(b), by_part(b)))).otherwise(token)

    def spelled(text: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1)), named), "")

    there = f"{EMOJI_CLASS}|\\x{{20E3}}|[\\x{{1F1E6}}-\\x{{1F1FF}}]"
    found = lambda text: F.when(text.rlike(there), spelled(text)).otherwise(text)
    return let(_col(c), lambda text: F.when(text.rlike(MAYBE_EMOJI), found(text)).otherwise(text))


def remove_think_tag(c: Column | str) -> Column:
    """If ``</think>`` occurs, what stands between its first and second occurrence (or the end), stripped."""
    end = F.lit("</think>")
    return let(_col(c), lambda text: F.when(F.contains(text, end), strip(F.split_part(text, end, F.lit(2)))).otherwise(text))


def remove_header(c: Column | str) -> Column:
    """Drop a boilerplate first line if other non-blank lines follow; blank lines go with it.

    The first line is looked at from its first ASCII letter or digit on, without emoji.
    """

    def opens(first: Column) -> Column:
        return reduce(lambda a, b: a | b, (first.startswith(phrase) for phrase in BOILERPLATE))

    def without(text: Column, lines: Column) -> Column:
        first = F.regexp_replace(F.regexp_replace(F.get(lines, F.lit(0)), "^[^a-zA-Z0-9]*", ""), EMOJI_CLASS, "")
        return F.when((F.size(lines) > 1) & let(first, opens), F.array_join(F.slice(lines, 2, F.size(lines)), "\n")).otherwise(text)

    def looked_at(text: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))
        # few texts have such a phrase at all: test before cutting into lines
        hint = reduce(lambda a, b: a | b, (F.contains(text, F.lit(phrase)) for phrase in BOILERPLATE))
        return F.when(hint, let(lines, lambda x: without(text, x))).otherwise(text)

    return let(_col(c), looked_at)


def clean_text(c: Column | str) -> Column:
    """Emoji names, think tag, header, lower case, white space: in this order. Null stays null."""
    return normalize_whitespace(F.lower(remove_header(remove_think_tag(normalize_emoji(_col(c))))))


def count_words(c: Column | str) -> Column:
    """Number of maximal runs of letters, digits, marks of combining, or underscores."""
    return F.regexp_count(_col(c), F.lit(r"[\p{L}\p{N}_]+"))


def words(cleaned: Column | str) -> Column:
    """Words of cleaned text; empty array for empty text."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    return let(_col(cleaned), some)


def strip_frontmatter(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?s)\A---\n.*?\n---\n", "")


def strip_fenced_code(c: Column | str) -> Column:
    """Blocks between two lines of the same fence; unclosed ones stay."""
    return F.regexp_replace(_col(c), r"(?smd)^[ \t]*(```|~~~).*?^[ \t]*\1[ \t]*$", "")


def strip_headings(c: Column | str) -> Column:
    """Headings of the first two levels."""
    return F.regexp_replace(_col(c), r"(?md)^[ \t]*#{1,2}[ \t].*$", "")


def strip_image_tags(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?i)<image\b[^>]*/?>", "")


def generic_strip(c: Column | str) -> Column:
    """Prose of a marked-up text: without front matter, fenced code, headings and image tags; null becomes empty."""
    c = F.coalesce(_col(c), F.lit(""))
    return strip(strip_image_tags(strip_headings(strip_fenced_code(strip_frontmatter(c)))))


def preview(c: Column | str, width: int = PREVIEW_RESULT) -> Column:
    """The first characters of the text on one line."""
    return F.substring(normalize_whitespace(F.coalesce(_col(c), F.lit(""))), 1, width)
