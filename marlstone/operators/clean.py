"""Cleaning of extracted text: a chain of built-in regular expressions, and removal of lines repeated over a document's pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import let
from ..functions.text import BLANKS, DIGIT, LINE_END, SPACE, WORD, strip

# fixed values: pattern and replacement of each step, in order; (?d) lets only \n end a line
STEPS = (
    ("carriage_return", r"\r", "\n"),
    ("footnote_marker", rf"(?<![{WORD}]){DIGIT}{{1,2}}\[", "["),
    ("omission_stars", rf"(?md)^{DIGIT}*{SPACE}*\*[{BLANKS}*]*$", ""),
    ("number_line", rf"(?md)^{SPACE}*{DIGIT}+{SPACE}*$", ""),
    ("page_line", rf"(?imd)^{SPACE}*Page{SPACE}+{DIGIT}+{SPACE}*$", ""),
    ("separator", r"[_\-]{5,}", ""),
    ("boilerplate", r"(?id)\*Subject to verification.*", ""),
    ("soft_newline", r"(?d)(?<!\n)\n(?!\n)(?!\[PAGE)(?!.*\|)", " "),
    ("amendment_note", rf"(?imd)^{DIGIT}+\.{SPACE}+(Subs\.|Ins\.|Omitted|Inserted|Added|Renumbered).*$", ""),
    ("dated_note", rf"(?imd)^{DIGIT}+\.{SPACE}+{DIGIT}{{1,2}}(st|nd|rd|th){SPACE}+[{WORD}]+.*$", ""),
    ("blank_lines", rf"\n{SPACE}*\n{SPACE}*\n+", "\n\n"),
    ("blanks", r"[ \t]+", " "),
)


def clean(c: Column, *names: str) -> Column:
    """All steps in order, or the named ones, then white space off both ends."""
    for name, pattern, new in STEPS:
        if not names or name in names:
            c = F.regexp_replace(c, pattern, new)
    return strip(c)


def strip_tags(c: Column) -> Column:
    """Without page and sheet tags, blank lines and blanks squeezed."""
    for pattern, new in ((rf"\[PAGE {DIGIT}+\]", ""), (r"\[SHEET:[^\]]+\]", ""), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        c = F.regexp_replace(c, pattern, new)
    return strip(c)


PAGE_TAG = rf"\[PAGE{SPACE}+{DIGIT}+\]"


def _pieces(text: Column) -> Column:
    """Per piece between page tags its stripped lines, blank ones left out."""
    return F.transform(F.split(text, PAGE_TAG), lambda p: F.filter(F.transform(F.split(p, LINE_END), strip), lambda x: x != ""))


def _repeated(pieces: Column) -> Column:
    """Array of (line, on_pages): lines of 6..79 characters on at least max(3, min(0.4 of the pages, 15)) pieces."""
    short = lambda x: (F.length(x) > 5) & (F.length(x) < 80)
    need = F.greatest(F.lit(3), F.least(F.floor(F.size(pieces) * 0.4), F.lit(15))).cast("int")
    each = F.array_sort(F.flatten(F.transform(pieces, lambda p: F.array_distinct(F.filter(p, short)))))
    # equal lines stand together once sorted: a line is repeated if the one ``need - 1`` places on is the same
    often = lambda lines: let(need, lambda n: F.array_distinct(F.filter(lines, lambda x, i: F.get(lines, i + n - 1) == x)))
    return let(each, lambda lines: F.transform(often(lines), lambda x: F.struct(
        x.alias("line"), F.size(F.filter(lines, lambda y: y == x)).cast("bigint").alias("on_pages"))))


def page_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, page, pages, line): non-blank stripped lines in order; pages are the pieces between tags, numbered from 1."""
    rows = let(_pieces(F.col(text_col)), lambda ps: F.flatten(F.transform(ps, lambda p, k: F.transform(p, lambda x: F.struct(
        (k + 1).alias("page"), F.size(ps).alias("pages"), x.alias("line"))))))
    return docs.select(id_col, F.inline(rows))


def repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line, on_pages): a document's repeated lines. They are worked out inside its row, so that nothing is shuffled."""
    return docs.select(id_col, F.inline(let(_pieces(F.col(text_col)), _repeated)))


def without_repeated_lines(docs: DataFrame, id_col: str, text_col: str, fix_page_numbers: bool = False) -> DataFrame:
    """(id, text) of ``repeated_lines_out``."""
    return docs.select(id_col, repeated_lines_out(F.col(text_col), fix_page_numbers).alias("text"))


def repeated_lines_out(c: Column, fix_page_numbers: bool = False) -> Column:
    """The text's pages written again as ``[PAGE k]`` and their lines, without a blank line between pages. The piece before the first tag counts as
    a page unless ``fix_page_numbers``, which keeps the numbers of the tags and gives that piece no tag."""

    def tag(k: Column, known: Column) -> Column:
        if fix_page_numbers:
            return F.when(k > 0, F.array(F.concat(F.lit("[PAGE "), F.get(known, k - 1), F.lit("]")))).otherwise(F.array().cast("array<string>"))
        return F.array(F.concat(F.lit("[PAGE "), (k + 1).cast("string"), F.lit("]")))

    def rewrite(text: Column) -> Column:
        numbers = F.regexp_extract_all(text, F.lit(rf"\[PAGE{SPACE}+({DIGIT}+)\]"))
        gone = lambda ps: F.transform(_repeated(ps), lambda r: r["line"])
        return let(_pieces(text), lambda ps: let(gone(ps), lambda out: let(numbers, lambda known: F.array_join(F.flatten(F.transform(
            ps, lambda p, k: F.concat(tag(k, known), F.filter(p, lambda x: ~F.array_contains(out, x))))), "\n"))))

    return let(c, rewrite)


def quality(c: Column) -> dict[str, Column]:
    """Characters, page tags, blank lines, and whether a long run of odd characters occurs."""
    return {
        "chars": F.length(c).cast("bigint"), "page_tags": F.regexp_count(c, F.lit(r"\[PAGE")).cast("bigint"),
        "blank_lines": F.regexp_count(c, F.lit(r"\n\n")).cast("bigint"),
        "ocr_noise": c.rlike(r"[^" + WORD + BLANKS + r".,:;()%/\-\[\]]{15,}"),
    }


def fingerprint(c: Column) -> Column:
    return F.sha2(c, 256)
