"""Metadata read from text: the first match of a pattern per field, NULL without one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import DIGIT, SPACE, WORD, found

BEGINS, ENDS = f"(?<![{WORD}])", f"(?![{WORD}])"
# fixed patterns: field, pattern, group
NOTIFICATION = rf"(?i)Notification{SPACE}+No\.?{SPACE}*([{WORD}/-]+)"
DOCUMENT_FIELDS = (
    ("chapter", rf"(?i)CHAPTER{SPACE}+([IVXLC0-9]+)", 1),
    ("section", rf"(?i){BEGINS}Section{SPACE}+({DIGIT}+[A-Z]?)", 1),
    ("notification_number", NOTIFICATION, 1),
    ("hs_code", rf"{BEGINS}{DIGIT}{{4}}(?:\.{DIGIT}{{2}})?(?:\.{DIGIT}{{2}})?{ENDS}", 0),
    ("customs_section", rf"(?i){BEGINS}Section{SPACE}+({DIGIT}+[A-Z]?){SPACE}+of{SPACE}+the{SPACE}+Customs{SPACE}+Act", 1),
)
CHUNK_FIELDS = (
    ("section", rf"(?i)Section{SPACE}+({DIGIT}+[A-Z]?)", 1),
    ("chapter", rf"(?i)CHAPTER{SPACE}+({DIGIT}{{1,2}})", 1),
    ("notification", NOTIFICATION, 1),
    ("hs_code", rf"{BEGINS}{DIGIT}{{4}}\.{DIGIT}{{2}}(?:\.{DIGIT}{{2}})?{ENDS}", 0),
)


def document_fields(c: Column) -> dict[str, Column]:
    return {name: found(c, pattern, group) for name, pattern, group in DOCUMENT_FIELDS}


def chunk_fields(c: Column) -> dict[str, Column]:
    return {name: found(c, pattern, group) for name, pattern, group in CHUNK_FIELDS}


def page_number(c: Column) -> Column:
    """Number of the first page tag."""
    return F.try_to_number(found(c, rf"\[PAGE ({DIGIT}+)\]"), F.lit("999999999")).cast("int")


def enrich(docs: DataFrame, text_col: str) -> DataFrame:
    """What is found in the text takes the place of the caller's value, NULL where nothing is found."""
    return docs.withColumns(document_fields(F.col(text_col)))


def merge_metadata(caller: Column, extracted: Column) -> Column:
    """Two string maps; the extracted keys win, those with a NULL value too."""
    kept = F.map_filter(caller, lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(extracted), k), F.lit(False)))
    return F.map_concat(kept, extracted)
