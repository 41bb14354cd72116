"""Text expressions. Everything here is a Column -> Column function."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end a line in Python's str.splitlines.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"

# Whitespace as Python's str.split and str.strip see it.
SPACE_CLASS = (
    "[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f"
    "\\u205f\\u3000]"
)


def fold(text: Column) -> Column:
    """Caseless form. Differs from a full case fold only for sharp s and final sigma."""
    return F.lower(text)


def lines(text: Column) -> Column:
    """Lines of a text; a final line break does not open another line, empty text has none."""
    last = F.right(text, F.lit(1))
    size = F.length(text)
    body = (
        F.when(F.right(text, F.lit(2)) == "\r\n", F.left(text, size - 2))
        .when(last.rlike(LINE_BREAK), F.left(text, size - 1))
        .otherwise(text)
    )
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(body, LINE_BREAK, -1)
    )


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE_CLASS}+$", "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE_CLASS}+", " "))


def truncate(text: Column, maximum: int) -> Column:
    """At most ``maximum`` characters; a cut text ends in a space and an ellipsis."""
    cut = F.concat(rstrip(F.substring(text, 1, maximum - 2)), F.lit(" …"))
    return F.when(F.length(text) <= maximum, text).otherwise(cut)


def answer_chunks(text: Column, maximum: int = 160, blank: bool = True) -> Column:
    """Split a text into pieces of at most ``maximum`` characters, preferring to end at a space.

    The greedy middle branch ends a piece at the last space whose index exceeds half the
    maximum; without one the piece is cut at the maximum. An empty text is one empty piece, or none
    without ``blank``.
    """
    after_half = maximum // 2 + 1
    pattern = f"(?s)(.{{1,{maximum}}}\\z|.{{{after_half},{maximum}}} |.{{{maximum}}})"
    pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(text == "", F.array(F.lit(""))).otherwise(pieces) if blank else pieces


def words(text: Column) -> Column:
    """Distinct caseless terms longer than two characters (letters, digits, underscore)."""
    parts = F.split(F.regexp_replace(fold(text), "[^\\p{L}\\p{Nd}\\p{Nl}\\p{No}_]+", " "), " ")
    return F.array_distinct(F.filter(parts, lambda term: F.length(term) > 2))


def identifiers(text: Column) -> Column:
    """Distinct caseless identifier tokens longer than three characters."""
    found = F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]+)"), F.lit(1))
    return F.array_distinct(
        F.transform(F.filter(found, lambda token: F.length(token) > 3), lambda token: fold(token))
    )


def contains_any(text: Column, needles: list[str]) -> Column:
    condition = F.lit(False)
    for needle in needles:
        condition = condition | text.contains(needle)
    return condition


def plural(count: Column, one: str, many: str) -> Column:
    return F.when(count == 1, F.lit(one)).otherwise(F.lit(many))
