"""Column functions for text. Classes are spelled out for Unicode, as the short ones know ASCII only: \\p{L}\\p{N}_ for word characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
BLANKS = r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = f"[{BLANKS}]"
WHITE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """White space off both ends, not only blanks."""
    return F.btrim(c, F.lit(WHITE))


def tokens(c: Column) -> Column:
    """Lower-case tokens of word characters, slashes, hyphens and dots."""
    cleaned = F.regexp_replace(F.lower(c), rf"[^{WORD}\s/\-.]", " ")
    return F.filter(F.split(cleaned, r"\s+"), lambda t: t != "")


def whitespace_words(c: Column) -> Column:
    return F.filter(F.split(c, rf"{SPACE}+"), lambda t: t != "")


def token_estimate(c: Column) -> Column:
    """Words times 1.3, cut to a whole number."""
    return F.floor(F.size(whitespace_words(c)) * F.lit(13) / F.lit(10)).cast("int")


def normalise_query(c: Column) -> Column:
    return F.regexp_replace(strip(c), rf"{SPACE}+", " ")


def prefix_query(c: Column, model: str) -> Column:
    """Models of the nomic family want a task prefix."""
    return F.concat(F.lit("search_query: "), c) if "nomic" in model.lower() else c


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def collection_name(prefix: str, c: Column) -> Column:
    return F.lower(F.concat(F.lit(prefix), F.regexp_replace(c, "[^a-zA-Z0-9]", "_")))


def matches_any(c: Column, phrases: list[str]) -> Column:
    """Whether the lower-case text contains one of the phrases."""
    low = F.lower(c)
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(low, p))
