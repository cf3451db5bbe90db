"""Ingestion as one batch: duplicates told by content hash, chunks, status rows; codecs of stored metadata."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS
from ..runtime import cut, parallelism
from . import chunk, clean, extract


def new_documents(docs: DataFrame, recorded: DataFrame, id_col: str, hash_col: str = "document_hash") -> DataFrame:
    """Documents whose hash isn't recorded, one per hash: the smallest id. The first of a batch is found by aggregation, so that a content with any number of
    copies isn't gathered."""
    first = docs.groupBy(hash_col).agg(F.min(id_col).alias(id_col))
    known = recorded.where(F.col(hash_col).isNotNull()).select(hash_col).distinct()
    return docs.join(first, [hash_col, id_col], "left_semi").join(known, hash_col, "left_anti")


def prepared(docs: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """Cleaned text without the lines repeated over its pages, its fields and its hash. All of it is worked out inside the row."""
    cleaned = docs.withColumn(text_col, clean.repeated_lines_out(clean.clean(F.col(text_col))))
    return extract.enrich(cleaned, text_col).withColumn("document_hash", clean.fingerprint(F.col(text_col)))


@dataclass(frozen=True)
class Ingestion:
    """What one batch of documents gives."""

    documents: DataFrame  # the new ones: cleaned, enriched, with their hash
    chunks: DataFrame  # theirs, with embeddings
    status: DataFrame  # (id, status, chunk_count, error): one row per document of the batch


def run(docs: DataFrame, recorded: DataFrame, id_col: str, embed: Callable[[DataFrame], DataFrame], text_col: str = "raw_text", error_col: str | None = None) -> Ingestion:
    """Clean, enrich, skip duplicates, chunk, embed. recorded(document_hash) are contents ingested before, by the hash of the cleaned text.

    A document without text failed, with the message in ``error_col`` if there is one. A content that is recorded, or that a smaller id of the batch has,
    is complete as "Duplicate document", without chunks. Documents are told apart by id, so that a file that is read again is one document."""
    message = F.coalesce(F.col(error_col), F.lit("No text")) if error_col else F.lit("No text")
    failed = docs.where(F.col(text_col).isNull()).select(id_col, F.lit("failed").alias("status"), F.lit(0).alias("chunk_count"), message.alias("error"))
    ready = cut(prepared(docs.where(F.col(text_col).isNotNull()), text_col))
    new = cut(new_documents(ready, recorded, id_col))
    chunks = cut(embed(chunk.chunk_documents(new, id_col, text_col)))
    counts = chunks.groupBy(id_col).agg(F.count("*").cast("int").alias("chunk_count"))
    known = new.select(id_col, F.lit(True).alias("_new"))
    done = ready.select(id_col).join(known, id_col, "left").join(counts, id_col, "left").select(
        id_col, F.lit("completed").alias("status"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        F.when(F.col("_new").isNull(), "Duplicate document").alias("error"))
    return Ingestion(new, chunks, done.unionByName(failed))


def batches(rows: DataFrame, group: str, order: str, size: int = SETTINGS.embed_batch) -> DataFrame:
    """Adds batch: every ``size`` rows of a group in order. Rows are numbered within ranges of (group, order), and ranges of a group follow one another, so
    that a group of any size is spread over many tasks."""
    placed = cut(rows.repartitionByRange(parallelism(rows.sparkSession), group, order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_of")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_group").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = placed.join(sizes.select("_group", "_of", before.alias("_before")), F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_of")))
    place = F.row_number().over(Window.partitionBy(group, "_range").orderBy(order)) + F.col("_before")
    return joined.withColumn("batch", F.ceil(place / size).cast("int")).select(*rows.columns, "batch")


def totals(attempts: DataFrame) -> DataFrame:
    """Per status: attempts and chunks."""
    return attempts.groupBy("status").agg(F.count("*").alias("attempts"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def encode_sentinels(df: DataFrame, numbers: list[str], texts: list[str], lists: list[str]) -> DataFrame:
    """For stores of plain scalars: NULL numbers as -1, NULL texts as '', lists as JSON."""
    return df.withColumns({**{c: F.coalesce(c, F.lit(-1)) for c in numbers}, **{c: F.coalesce(c, F.lit("")) for c in texts},
                           **{c: F.to_json(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in lists}})


def decode_sentinels(df: DataFrame, numbers: list[str], texts: list[str], lists: list[str]) -> DataFrame:
    return df.withColumns({**{c: F.nullif(c, F.lit(-1)) for c in numbers}, **{c: F.nullif(c, F.lit("")) for c in texts},
                           **{c: F.from_json(c, "array<string>") for c in lists}})


def ingested_order(c: Column) -> Column:
    """ISO times with or without fraction and zone as one comparable timestamp."""
    return F.try_to_timestamp(F.regexp_replace(c, "Z$", "")).cast("timestamp_ntz")
