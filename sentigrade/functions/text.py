"""Text columns.

The whitespace class spells out U+001C..U+001F because the JVM's Unicode ``\\s`` leaves them
out although they separate words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\s\x1c-\x1f"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c) -> Column:
    """Lower case, without links, tags and unusual characters, single-spaced; NULL becomes ''."""
    text = F.lower(F.coalesce(_col(c), F.lit("")))
    text = F.regexp_replace(text, rf"(?U)(?:http|www)[^{_SPACE}]+", "")
    text = F.regexp_replace(text, r"(?d)<.*?>", "")
    text = F.regexp_replace(text, rf"(?U)[^a-zA-Z0-9{_SPACE}.,!?'\-]", "")
    return F.trim(F.regexp_replace(text, rf"(?U)[{_SPACE}]+", " "))


def word_count(c) -> Column:
    """Number of whitespace-separated words; counts matches, so no array is built."""
    return F.coalesce(F.regexp_count(_col(c), F.lit(rf"(?U)[^{_SPACE}]+")), F.lit(0))


def longer_than(c, minimum: int = 10) -> Column:
    return F.char_length(_col(c)) > F.lit(minimum)


def normalize_name(c) -> Column:
    """Matching key of a title: lower case, letters, digits and single spaces only."""
    name = F.regexp_replace(F.lower(_col(c)), rf"(?U)[^a-z0-9{_SPACE}]", "")
    return F.trim(F.regexp_replace(name, rf"(?U)[{_SPACE}]+", " "))


def split_field(c, separator: str) -> Column:
    """Trimmed non-empty parts of a delimited string; NULL or blank gives an empty array."""
    pattern = "[" + separator + "]"
    parts = F.transform(
        F.split(F.coalesce(_col(c), F.lit("")), pattern),
        lambda part: F.regexp_replace(part, rf"(?U)^[{_SPACE}]+|[{_SPACE}]+$", ""),
    )
    return F.filter(parts, lambda part: part != "")
