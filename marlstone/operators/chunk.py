"""Structure-aware chunking: legal sections, recursive splitting, page carry-forward, merging of short chunks."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..functions.text import DIGIT, SPACE, strip, token_estimate
from ..runtime import spread
from .clean import strip_tags
from .extract import chunk_fields, page_number

# fixed patterns: a line that begins with one of these opens a section
BOUNDARY = (
    rf"(?i)\n(?:{DIGIT}+[A-Z]?\.|Section{SPACE}+{DIGIT}+[A-Z]?|CHAPTER{SPACE}+[IVXLC]+|PART{SPACE}+[IVXLC]+|Rule{SPACE}+{DIGIT}+"
    rf"|Explanation\.|Provided{SPACE}+that|Provided{SPACE}+further|Illustration)"
)
MARK = "\x00\x01\x00"  # put ahead of a boundary; no text has these characters in a row
# fixed values: separators in order of preference
SEPARATORS = (
    "\nCHAPTER ", "\nSECTION ", "\nPART ", "\nSCHEDULE ", "\nANNEXURE ", "\nRule ", "\nRULE ", "\nClause ", "\nArticle ", "\nSection ",
    "\nNotification ", "\nCircular ", "\nOrder ", "\n\n", "\n", ". ", " ", "",
)


def sections(c: Column) -> Column:
    """Array of the stripped, non-empty pieces; a boundary stays with the piece behind it. Boundaries don't overlap: where a number stands on the
    line behind its keyword, the keyword's line opens the section and the number's doesn't."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, BOUNDARY, MARK + "$0"), MARK), strip), lambda x: x != "")


def _keep_with_next(text: str, separator: str) -> list[str]:
    if not separator:
        return list(text)
    parts = text.split(separator)
    return [p for p in [parts[0], *(separator + x for x in parts[1:])] if p]


def _merge(parts: Iterator[str] | list[str], size: int, overlap: int) -> list[str]:
    """Parts put together up to ``size`` characters, each result beginning with up to ``overlap`` characters of the one before."""
    out, held, total = [], deque(), 0
    for part in parts:
        if held and total + len(part) > size:
            whole = "".join(held).strip()
            if whole:
                out.append(whole)
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.popleft())
        held.append(part)
        total += len(part)
    whole = "".join(held).strip()
    return out + [whole] if whole else out


def recursive_split(text: str, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap,
                    separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Splits at the first separator that occurs; what is still too long is split by those after it."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    rest = separators[at + 1:]
    out, small = [], []
    for part in _keep_with_next(text, separators[at]):
        if len(part) < size:
            small.append(part)
            continue
        out += _merge(small, size, overlap)
        small = []
        out += recursive_split(part, size, overlap, rest) if rest else [part]
    return out + _merge(small, size, overlap)


def raw_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = SETTINGS.chunk_size, overlap: int = SETTINGS.chunk_overlap) -> DataFrame:
    """(id, chunk_index, raw): all pieces of a document's sections, numbered through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, parts in zip(batch["id"], batch["parts"]):
                n = 0
                for part in parts:
                    for piece in recursive_split(part, size, overlap):
                        rows.append((key, n, piece))
                        n += 1
            yield pd.DataFrame(rows, columns=["id", "chunk_index", "raw"])

    kind = docs.schema[id_col].dataType.simpleString()
    return (spread(docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), sections(F.col(text_col)).alias("parts")))
            .mapInPandas(run, f"id {kind}, chunk_index int, raw string").withColumnRenamed("id", id_col))


def carry_page(chunks: DataFrame, id_col: str, page: Column, order: str = "chunk_index") -> DataFrame:
    """Adds page_number: its own, else the last one before it in the document."""
    w = Window.partitionBy(id_col).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return chunks.withColumn("page_number", F.last(page, ignorenulls=True).over(w))


def merge_short(chunks: DataFrame, id_col: str, text_col: str, order: str = "chunk_index", least: int = SETTINGS.min_chunk_chars) -> DataFrame:
    """Texts shorter than ``least`` are appended to the last long one before them; those ahead of the first long one are left out. All other
    columns are the long one's."""
    long = F.length(text_col) >= least
    w = Window.partitionBy(id_col).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = [c for c in chunks.columns if c not in (id_col, text_col)]
    return (chunks.withColumn("_group", F.sum(long.cast("int")).over(w)).where("_group > 0").groupBy(id_col, "_group")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text_col).alias("t")))),
                                          lambda x: x["t"]), " ").alias(text_col),
                 *(F.min_by(c, order).alias(c) for c in rest))
            .select(*chunks.columns))


def chunk_id(doc: str, index: str) -> Column:
    """The same id whenever a chunk is made again."""
    return F.sha2(F.concat_ws("|", F.col(doc).cast("string"), F.col(index).cast("string")), 256)


def chunk_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, chunk_index, text, page_number, token_estimate, chunk_id and the fields found in the text)."""
    raw = raw_chunks(docs, id_col, text_col)
    paged = carry_page(raw, id_col, page_number(F.col("raw")))
    cleaned = paged.select(id_col, "chunk_index", "page_number", strip_tags(F.col("raw")).alias("text"))
    fields = chunk_fields(F.col("text"))
    headed = cleaned.withColumns(fields)
    merged = merge_short(headed, id_col, "text")
    return merged.withColumns({"token_estimate": token_estimate(F.col("text")), "chunk_id": chunk_id(id_col, "chunk_index")})
