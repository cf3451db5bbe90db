"""Duplicates hidden by formatting differences.

Method: dictionary encoding. A record is cut into fields: its leading ``Label: value`` lines, the cells of each
``[ROW n]`` line, and the running text between them. The distinct raw values of all fields form a dictionary, in which each
value is canonicalised once (letters and digits in lower case) and each distinct canonical value gets an integer. A
record becomes the sorted tuple of (part, integer); fields of one header or one row share a part number, so their order is
disregarded. Records are grouped by the digest of that tuple, with partial aggregation, so a content with
any number of copies is never gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, spread

LABEL = re.compile(r"[^\w\[]*[^\W\d_][^\n:|\[\]]*:\s*\S")
TAG = re.compile(r"[^\w\[]*\[\s*PAGE\s+\d+\s*\]\s*", re.IGNORECASE)
ENDS = (".", ":", ";", "?", "!", "।")
ROW = re.compile(r"[^\w\[]*\[\s*ROW\s+\d+\s*\]", re.IGNORECASE)


def fields(text: str) -> list[tuple[int, str]]:
    """(part, raw value) of a text. Its header is the first run of at least two ``Label: value`` lines (blank lines between them allowed) before any row,
    where it leads the running text: behind nothing, or with a title straight before it, a line that doesn't end a sentence. It may go on behind a page
    tag. Running text on either side is one value, whatever its line breaks."""
    lines = text.split("\n")
    start = end = -1
    i, title = 0, ""
    while i < len(lines):
        if ROW.match(lines[i]):
            break
        if LABEL.match(lines[i]):
            j, last, n = i, i, 0
            while j < len(lines) and (LABEL.match(lines[j]) or TAG.fullmatch(lines[j]) or not lines[j].strip()):
                if LABEL.match(lines[j]):
                    last, n = j, n + 1
                j += 1
            if n >= 2:
                if not title.endswith(ENDS):
                    start, end = i, last
                break
            title, i = lines[last].strip(), j
        else:
            if lines[i].strip() and not TAG.fullmatch(lines[i]):
                title = lines[i].strip()
            i += 1
    out: list[tuple[int, str]] = []
    part, body = 0, []

    def flush() -> None:
        nonlocal part, body
        if body:
            out.append((part, "\n".join(body)))
            part, body = part + 1, []

    for k, line in enumerate(lines):
        row = ROW.match(line)
        if start <= k <= end:
            if k == start:
                flush()
            if LABEL.match(line):
                out.append((part, line))
            else:
                body.append(line)  # a page tag inside the header stands behind it
            if k == end:
                part += 1
        elif row:
            flush()
            out.append((part, row.group()))
            out.extend((part, cell) for cell in line[row.end():].split("|"))
            part += 1
        else:
            body.append(line)
    flush()
    return out


def _cut_fields(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(i, p, k, v) for i, t in zip(batch["parsed_id"], batch["raw_text"]) for k, (p, v) in enumerate(fields(t))]
        yield pd.DataFrame(rows, columns=["parsed_id", "part", "place", "value"])


def content_keys(docs: DataFrame, id_col: str = "parsed_id", text_col: str = "raw_text") -> DataFrame:
    """(parsed_id, content): equal contents have equal 256-bit digests of their integer tuples. Rows delivered
    twice count once; null texts are left out; texts without a letter or digit share one content."""
    texts = (docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
             .select(F.col(id_col).alias("parsed_id"), F.col(text_col).alias("raw_text")))
    cells = cut(spread(texts).mapInPandas(_cut_fields, "parsed_id bigint, part int, place int, value string")
                .withColumn("raw_key", F.unhex(F.md5("value"))))
    # the dictionary: each distinct raw value once, its canonical form, and one integer per distinct canonical form
    canonical = F.regexp_replace(F.lower("value"), r"[^\p{L}\p{N}]+", "")
    raw = (cells.groupBy("raw_key").agg(F.first("value").alias("value"))
           .select("raw_key", F.unhex(F.sha2(canonical, 256)).alias("canonical"), (canonical == "").alias("blank")))
    numbers = cut(raw.where(~F.col("blank")).select("canonical").distinct()
                  .withColumn("value_id", F.monotonically_increasing_id()))  # written, so the numbers stay
    dictionary = raw.where(~F.col("blank")).join(numbers, "canonical").select("raw_key", "value_id")
    # parts are renumbered after blank values are gone, so that empty lines and cells make no difference
    # a set of places, so that a row delivered twice counts once
    placed = F.collect_set(F.struct("part", "value_id", "place"))
    tuples = (cells.select("parsed_id", "part", "place", "raw_key").join(dictionary, "raw_key")
              .groupBy("parsed_id").agg(F.sort_array(placed).alias("pairs")))
    parts = F.array_sort(F.array_distinct(F.transform("pairs", lambda p: p["part"])))
    digest = F.sha2(F.concat_ws(",", F.transform(
        "pairs", lambda p: F.concat_ws(":", F.array_position(F.col("parts"), p["part"]), p["value_id"]))), 256)
    keyed = tuples.withColumn("parts", parts).select("parsed_id", F.unhex(digest).alias("content"))
    return texts.select("parsed_id").distinct().join(keyed, "parsed_id", "left").withColumn(
        "content", F.coalesce("content", F.lit(b"").cast("binary")))


def collapse(docs: DataFrame, **columns: str) -> DataFrame:
    """(parsed_id, copies): one record per content, the smallest id, with its number of rows."""
    return (content_keys(docs, **columns).groupBy("content")
            .agg(F.min("parsed_id").alias("parsed_id"), F.count("*").alias("copies")).select("parsed_id", "copies"))


def copy_pairs(docs: DataFrame, **columns: str) -> DataFrame:
    """(parsed_id, copy_parsed_id): the smallest id of each content with each of its copies."""
    keys = cut(content_keys(docs, **columns))
    heads = keys.groupBy("content").agg(F.min("parsed_id").alias("head"), F.count("*").alias("n")).where("n > 1")
    return (keys.join(heads, "content").where("parsed_id <> head")
            .select(F.col("head").alias("parsed_id"), F.col("parsed_id").alias("copy_parsed_id")))
