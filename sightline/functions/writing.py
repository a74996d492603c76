"""Column functions that remove mere differences of writing (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The digits of the Arabic and the Eastern Arabic block.
FOREIGN_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
ASCII_DIGITS = "01234567890123456789"
# White space that Java's \s does not cover.
WIDE_SPACES = "       　"
# Character entities that listings escape, with their characters.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&#039;": "'", "&#x27;": "'", "&nbsp;": " ", "&#160;": " ", "&ndash;": "-", "&mdash;": "-", "&#8211;": "-", "&#8212;": "-"}


def ascii_digits(c: Column) -> Column:
    """Arabic-Indic digits as ASCII digits."""
    return F.translate(c, FOREIGN_DIGITS, ASCII_DIGITS)


def plain_spaces(c: Column) -> Column:
    """All kinds of white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(c, WIDE_SPACES, " " * len(WIDE_SPACES)), r"\s+", " "))


def unescape(c: Column, rounds: int = 2) -> Column:
    """Character entities decoded; ``rounds`` levels of escaping.

    The rewriting sits behind a test for '&', which most values fail.
    """
    out = c
    for _ in range(rounds):
        out = F.replace(out, F.lit("&amp;"), F.lit("&"))
    for entity, char in ENTITIES.items():
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.when(F.contains(c, F.lit("&")), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(c)


def content_only(c: Column) -> Column:
    """Letters, digits, currency signs and decimal points alone, lower case: equal for values that differ in writing only.

    Case, spacing, other punctuation (also of groups of three digits), escaping and combining
    marks vanish; null becomes ''.
    """
    kept = F.regexp_replace(F.lower(ascii_digits(unescape(c))), r"[^\p{L}\p{N}\p{Sc}.,٫]+|(?<!\d)[.,٫]|[.,٫](?!\d)|[.,٫](?=\d{3}(?!\d))", "")
    return F.coalesce(F.translate(kept, ",٫", ".."), F.lit(""))
