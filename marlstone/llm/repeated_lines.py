"""Lines repeated across one site's documents.

Method: a suffix array over each source's concatenated line identifiers. A line's identifier is 64 bits of
a digest of its letters in lower case; lines with fewer than ``min_letters`` letters (blank lines, numbers, tags)
are left out of the sequence. Every position's suffix is the identifiers from there on, up to ``depth`` lines and
never past the end of its document. All suffixes are range-partitioned and sorted by (source, suffix), which is the
suffix array cut into shards of even size whatever the size of a source; one scan of a shard finds, from the common
prefix of neighbours, each block of 1..depth lines that at least ``min_docs`` documents share. A block that touches
the border of its shard is decided from the few documents on either side of the border (see ``_scan``), so a source
or a line holding a third of all rows is never gathered in one task.

A block of more than ``depth`` lines is covered by the blocks of ``depth`` lines that begin at each of its lines:
``depth`` bounds the sort key, not what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, parallelism

ID_BYTES = 8
POSITION = "parsed_id bigint, line_no int"
SCANNED = f"kind string, source string, prefix binary, {POSITION}, length int"


def line_table(docs: DataFrame, id_col: str = "parsed_id", text_col: str = "raw_text",
               source_col: str = "source_name") -> DataFrame:
    """(source, parsed_id, seq of (line_no, line id, letters)) per document; null texts and null sources are left out.
    Rows delivered twice make no difference: documents are counted as sets of ids."""
    lines = F.split(F.col(text_col), "\n", -1)
    keyed = F.transform(lines, lambda line, i: F.struct(
        (i + 1).alias("line_no"), F.regexp_replace(F.lower(line), r"[^\p{L}]+", "").alias("key")))
    return (docs.where(F.col(text_col).isNotNull() & F.col(source_col).isNotNull())
            .select(F.col(source_col).alias("source"), F.col(id_col).alias("parsed_id"), keyed.alias("lines"))
            .where("parsed_id is not null"))


def suffixes(docs: DataFrame, min_letters: int, depth: int, **columns: str) -> DataFrame:
    """One row per line of at least ``min_letters`` letters: (source, suffix, parsed_id, line_no)."""
    kept = F.filter("lines", lambda x: F.length(x["key"]) >= min_letters)
    ids = F.transform(kept, lambda x: F.unhex(F.substring(F.sha2(x["key"], 256), 1, 2 * ID_BYTES)))
    return (line_table(docs, **columns)
            .select("source", "parsed_id", kept.alias("lines"), ids.alias("ids"))
            .select("source", "parsed_id", "ids", F.posexplode("lines").alias("i", "line"))
            .select("source",
                    F.aggregate(F.slice("ids", F.col("i") + 1, F.lit(depth)), F.lit(b"").cast("binary"),
                                lambda acc, x: F.concat(acc, x)).alias("suffix"),
                    "parsed_id", F.col("line.line_no").alias("line_no")))


class _Open:
    """A block (common prefix of the suffixes since ``since``) that may still grow."""

    __slots__ = ("docs", "members", "touches_start")

    def __init__(self, touches_start: bool):
        self.docs: set[int] = set()
        self.members: list[tuple[int, int]] = []
        self.touches_start = touches_start


def _scan(min_docs: int, depth: int):
    """Scans one shard of the suffix array. Per depth one open block is kept with its first documents only: once
    ``min_docs`` are seen, rows are passed on at once, so memory doesn't grow with a block. A block touching either end of the
    shard gives 'accepted' (its prefix) if it has enough documents here, else 'open' rows: fewer than ``min_docs``
    documents' positions."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: list[_Open | None] = [None] * depth
        now: tuple[str, bytes] | None = None
        first = True
        out: list[tuple] = []

        def close(d: int, at_end: bool) -> None:
            block = blocks[d]
            if block is None:
                return
            source, prefix = now[0], now[1][: (d + 1) * ID_BYTES]
            if block.touches_start or at_end:
                if len(block.docs) >= min_docs:
                    out.append(("accepted", source, prefix, None, None, d + 1))
                else:
                    out.extend(("open", source, prefix, *m, d + 1) for m in block.members)
            blocks[d] = None

        for batch in batches:
            for source, suffix, doc, line in zip(batch["source"], batch["suffix"], batch["parsed_id"], batch["line_no"]):
                suffix = bytes(suffix)
                levels = len(suffix) // ID_BYTES
                same = 0
                if now is not None and now[0] == source:
                    old = now[1]
                    most = min(len(old), len(suffix)) // ID_BYTES
                    while same < most and old[same * ID_BYTES:(same + 1) * ID_BYTES] == suffix[same * ID_BYTES:(same + 1) * ID_BYTES]:
                        same += 1
                for d in range(same, depth):
                    close(d, False)
                longest = 0
                for d in range(levels):
                    block = blocks[d]
                    if block is None:
                        block = blocks[d] = _Open(first)
                    if len(block.docs) >= min_docs:
                        longest = d + 1
                        continue
                    block.docs.add(doc)
                    block.members.append((doc, line))
                    if len(block.docs) >= min_docs:
                        out.extend(("found", source, None, *m, d + 1) for m in block.members)
                        block.members = []
                if longest:
                    out.append(("found", source, None, doc, line, longest))
                now, first = (source, suffix), False
            if out:
                yield _frame(out)
                out = []
        if now is not None:
            for d in range(depth):
                close(d, True)
        if out:
            yield _frame(out)

    return scan


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["kind", "source", "prefix", "parsed_id", "line_no", "length"])
    return frame.astype({"parsed_id": "Int64", "line_no": "Int32", "length": "int32"})


def repeated_blocks(docs: DataFrame, min_docs: int = 8, min_letters: int = 20, depth: int = 8, **columns: str) -> DataFrame:
    """(parsed_id, line_no, length): at the line begins a block of ``length`` lines of the sequence that at least ``min_docs`` documents
    of its source share; the longest block per position. Empty tables give no rows."""
    shards = parallelism(docs.sparkSession)
    array = (suffixes(docs, min_letters, depth, **columns)
             .repartitionByRange(shards, "source", "suffix", "parsed_id")
             .sortWithinPartitions("source", "suffix", "parsed_id"))
    scanned = cut(array.mapInPandas(_scan(min_docs, depth), SCANNED))
    border = scanned.where("kind <> 'found'")
    decided = (border.groupBy("source", "prefix")
               .agg(F.max(F.col("kind") == "accepted").alias("accepted"), F.countDistinct("parsed_id").alias("docs"))
               .where(F.col("accepted") | (F.col("docs") >= min_docs)).select("source", "prefix"))
    late = border.where("kind = 'open'").join(decided, ["source", "prefix"], "left_semi")
    return (scanned.where("kind = 'found'").unionByName(late)
            .groupBy("parsed_id", "line_no").agg(F.max("length").alias("length")))


def repeated_line_positions(docs: DataFrame, min_docs: int = 8, min_letters: int = 20, depth: int = 8, **columns: str) -> DataFrame:
    """(parsed_id, line_no) of every line of at least ``min_letters`` letters inside a repeated block."""
    # a line inside a block of n lines begins itself a block of at least one line that the same documents share
    return repeated_blocks(docs, min_docs, min_letters, depth, **columns).select("parsed_id", "line_no")


def without_repeated_lines(docs: DataFrame, min_docs: int = 8, min_letters: int = 20, depth: int = 8) -> DataFrame:
    """(parsed_id, clean_text, removed_lines): the texts without lines of repeated blocks, all other lines as they were. A null text stays null."""
    found = (repeated_line_positions(docs, min_docs, min_letters, depth)
             .groupBy("parsed_id").agg(F.collect_set("line_no").alias("gone")))
    lines = F.split(F.col("raw_text"), "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.coalesce(F.array_contains("gone", i + 1), F.lit(False)))
    return (docs.select("parsed_id", "raw_text").dropDuplicates(["parsed_id"]).join(found, "parsed_id", "left")
            .select("parsed_id",
                    F.when(F.col("gone").isNull(), F.col("raw_text")).otherwise(F.concat_ws("\n", kept)).alias("clean_text"),
                    F.coalesce(F.size("gone"), F.lit(0)).alias("removed_lines")))
