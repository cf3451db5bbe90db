"""Splitting oversized items at natural boundaries.

Method: every position of a text has a boundary strength (legal heading, page tag, paragraph, line, sentence, clause, word, none). A sparse
table over the strengths answers range-maximum queries in constant time; each piece ends at the strongest boundary in its permissible
window (from ``min_piece`` to ``max_chars`` characters after its start), ties to the right. The next piece steps back by ``overlap``
characters from there, and on to the first boundary of a word or more; where none is ahead of the cut it begins inside a word. Pieces are exact
slices: joined without the overlaps they give the text again. Strengths are computed over windows of ``BLOCK`` characters, so a text of any
length needs bounded memory beyond itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread

# strengths of the boundary in front of a position; fixed values
LEGAL, PAGE, PARAGRAPH, LINE, SENTENCE, CLAUSE, PHRASE, WORD = 9, 8, 7, 6, 5, 4, 3, 2
BOUNDARIES = (
    (WORD, re.compile(r"\s+(?=\S)")),
    (PHRASE, re.compile(r"[,:]\s+(?=\S)")),
    (CLAUSE, re.compile(r";\s+(?=\S)|(?<= \| )")),
    (SENTENCE, re.compile(r"[.!?।][\"'”’)\]]*\s+(?=\S)")),
    (LINE, re.compile(r"\n[^\S\n]*(?=\S)")),
    (PARAGRAPH, re.compile(r"\n\s*\n\s*(?=\S)")),
    (PAGE, re.compile(r"(?=\[(?:PAGE|SHEET|ROW)\b)")),
    (LEGAL, re.compile(
        r"(?:(?<=\n)|\A)(?=\d+[A-Z]?\. |(?:Section|Rule|Article|Clause|CHAPTER|PART|SCHEDULE|ANNEXURE)\s+[\dIVXLC]"
        r"|Explanation\b|Provided (?:that|further)\b|Illustration\b)", re.IGNORECASE)),
)
BLOCK = 1 << 16


def strengths(text: str) -> np.ndarray:
    """Strength (0..9) of a cut in front of each position of ``text``."""
    s = np.zeros(len(text) + 1, np.int8)
    for strength, pattern in BOUNDARIES:
        for m in pattern.finditer(text):
            s[m.end()] = max(s[m.end()], strength)
    s[0] = s[-1] = 0
    return s


class RangeMaximum:
    """Sparse table of argmax positions for windows up to ``width``."""

    def __init__(self, values: np.ndarray, width: int):
        # the key orders by strength, then by position, so one maximum settles ties to the right
        self.n = n = len(values)
        self.table, step = [values.astype(np.int64) * (n + 1) + np.arange(n)], 1
        while 2 * step <= min(width, n):
            last = self.table[-1]
            self.table.append(np.maximum(last[:-step], last[step:]))
            step *= 2

    def rightmost(self, lo: int, hi: int) -> tuple[int, int]:
        """(position, strength) of the rightmost strongest in lo..hi."""
        level = (hi - lo + 1).bit_length() - 1
        row = self.table[level]
        strength, position = divmod(int(max(row[lo], row[hi + 1 - (1 << level)])), self.n + 1)
        return position, strength


def pieces(text: str, max_chars: int = 800, overlap: int = 120, min_piece: int | None = None) -> list[tuple[int, int]]:
    """(start, end) of each piece. The empty text has none; a text within the limit is one piece."""
    least = max(overlap + 1, max_chars // 2 if min_piece is None else min_piece)
    if not 0 <= overlap < least <= max_chars:
        raise ValueError("need 0 <= overlap < min_piece <= max_chars")
    out: list[tuple[int, int]] = []
    start, n, base, table, natural = 0, len(text), 0, None, None
    margin = max(1 << 10, 2 * max_chars)
    while start < n:
        if n - start <= max_chars:
            out.append((start, n))
            break
        if table is None or start + max_chars + 1 > base + table.n - 1 and base + table.n - 1 < n:
            base = max(0, start - overlap - 2)
            # some characters of context on the left keep boundary patterns whole
            before = min(base, 256)
            s = strengths(text[base - before:base + max(BLOCK, 4 * margin)])[before:]
            table, natural = RangeMaximum(s, max_chars), np.flatnonzero(s >= WORD)
        position, strength = table.rightmost(start + least - base, start + max_chars - base)
        end = base + position if strength else start + max_chars
        out.append((start, end))
        start = end - overlap
        if overlap:
            k = np.searchsorted(natural, start - base)
            if k < len(natural) and natural[k] < end - base:
                start = base + int(natural[k])
    return out


def split_items(items: DataFrame, id_col: str, text_col: str, max_chars: int = 800, overlap: int = 120,
                min_piece: int | None = None) -> DataFrame:
    """(id, chunk_index, start, text): every item's pieces in order. Null and empty texts have none; rows that repeat an id are split once each
    unless they are equal. Columns other than the two named play no part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["id"], batch["text"]):
                rows += [(key, i, a, text[a:b]) for i, (a, b) in enumerate(pieces(text, max_chars, overlap, min_piece))]
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "start", "text"])

    kept = (items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .where("id is not null and text is not null and text <> ''").distinct())
    kind = kept.schema["id"].dataType.simpleString()
    return spread(kept).mapInPandas(run, f"id {kind}, chunk_index int, start bigint, text string").withColumnRenamed("id", id_col)
