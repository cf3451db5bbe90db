"""Incremental ingestion: new files of a folder as a stream, in batches that skip contents already recorded. An extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..schemas import INGEST_RECORD
from ..sources import files


def recorded(spark: SparkSession, records_path: str, batch: int) -> DataFrame:
    """(document_hash) of contents that other batches completed. A failed document isn't recorded as known, so it is tried again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(records_path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "document_hash string")
    rows = spark.read.schema(INGEST_RECORD + ", batch bigint").option("recursiveFileLookup", False).json(records_path)
    return rows.where((F.col("batch") != batch) & (F.col("status") == "completed")).select("document_hash").distinct()


def ingest_batch(parsed: DataFrame, batch: int, chunks_path: str, records_path: str, embed: Callable[[DataFrame], DataFrame] = lambda chunks: chunks) -> None:
    """Chunks and records of a batch of parsed files, each in a folder of the batch, which replaces what an earlier attempt at the batch left there: a failure
    anywhere, and running a batch again, neither loses nor doubles a row. Files that can't be read give failed records."""
    docs = parsed.withColumn("doc_id", F.sha2("path", 256))
    made = ingest.run(docs, recorded(parsed.sparkSession, records_path, batch), "doc_id", embed, error_col="error")
    made.chunks.write.mode("overwrite").parquet(f"{chunks_path.rstrip('/')}/batch={batch}")
    known = made.documents.select("doc_id", "document_hash")
    rows = (made.status.join(known, "doc_id", "left").join(docs.select("doc_id", "filename", "page_count", "file_size_kb"), "doc_id")
            .withColumn("ingested_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))
    rows.write.mode("overwrite").json(f"{records_path.rstrip('/')}/batch={batch}")


def ingest_stream(spark: SparkSession, folder: str, chunks_path: str, records_path: str, checkpoint: str, pdf=None) -> StreamingQuery:
    """Ingests what is new in the folder and stops."""
    stream = spark.readStream.format("binaryFile").schema(files.FILES).load(folder)
    handle = lambda batch, n: ingest_batch(files.parse_files(batch, pdf), n, chunks_path, records_path)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
