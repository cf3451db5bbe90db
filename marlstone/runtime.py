"""Session helpers: table reading, checkpointing, task counts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``root`` (a file or a folder of files)."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not configured and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="marlstone-checkpoint-"))
        current = sc._jsc.sc().getCheckpointDir()
    return configured or current.get()


_written: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a compressed table to the shared checkpoint folder and reads it again: its lineage ends there, so that a lost
    executor costs a re-read and not a recomputation of all stages before it. The tables go when the program ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_remove)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove() -> None:
    for spark, path in _written:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may have ended before
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def parallelism(spark: SparkSession) -> int:
    """Partitions for CPU-bound stages: at least the shuffle partitions, at least two per core."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin over all cores ahead of a CPU-bound Python stage, where a scan of few files has fewer tasks than cores. Behind a
    shuffle nothing is done: adaptive execution already keeps a partition per core there. Only plans are looked at, no job is run."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    if df.rdd.getNumPartitions() >= df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(parallelism(df.sparkSession))
