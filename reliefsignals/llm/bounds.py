"""Broadcasts behind a measured bound, and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 1_000_000


def broadcast_if_few(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it has at most so many (narrow) rows.

    Counting stops at the bound. Beyond it the hint is left out and Spark shuffles.
    """
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


#: Rows of whole texts that go to a Python worker at once.
ARROW_ROWS = 1_000


def with_small_batches(spark: SparkSession) -> SparkSession:
    """Send texts to Python in batches of ``ARROW_ROWS``: ten times the rows take ten times the memory on both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark


def with_small_reads(spark: SparkSession) -> SparkSession:
    """``with_small_batches``, and texts are read in such batches too: a scan holds one batch in arrays that double as they fill."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", ARROW_ROWS)
    return with_small_batches(spark)


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is not set: it names the folder all executors share")
        base = tempfile.mkdtemp(prefix="training-data-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: cuts its lineage and survives lost executors."""
    path = run_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def free_name(frame: DataFrame, name: str) -> str:
    """A column name that does not clash with those of the frame, whatever their case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
