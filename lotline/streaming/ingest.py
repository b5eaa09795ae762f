"""Incoming warehouse extracts as a file-source stream (S11, re-aimed).

The reference waits for an export file to stop growing and then reads it.
Here the exports land in a folder (writers move finished files in with an
atomic rename), and a Structured Streaming file source picks up every new
file exactly once: the checkpoint records which files were read, so a
restarted job (or a lost executor) neither skips nor repeats a file.
``availableNow`` processes everything present and stops, which suits a
scheduled daily run; a long-running trigger works the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lotline.session import checkpoint_dir


def extract_stream(spark: SparkSession, src_dir: str, schema: T.StructType, fmt: str = "csv",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame over the files of ``src_dir`` (schema is
    required: no inference on a stream). Adds the source file name."""
    r = spark.readStream.schema(schema)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.format(fmt).load(src_dir).withColumn("source_file", F.col("_metadata.file_name"))


def ingest_extracts(spark: SparkSession, src_dir: str, schema: T.StructType, out_path: str,
                    name: str = "extracts", fmt: str = "csv", checkpoint: str | None = None,
                    transform: Callable[[DataFrame], DataFrame] | None = None,
                    max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Append every new extract file to the parquet table ``out_path``
    (optionally transformed row by row first) and stop when caught up.
    The checkpoint lives under the session's ``spark.checkpoint.dir``."""
    stream = extract_stream(spark, src_dir, schema, fmt, max_files_per_trigger)
    if transform is not None:
        stream = transform(stream)
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    return (stream.writeStream.format("parquet").option("path", out_path)
                  .option("checkpointLocation", ckpt).outputMode("append")
                  .trigger(availableNow=True).start())


def ingest_with(spark: SparkSession, src_dir: str, schema: T.StructType,
                handle: Callable[[DataFrame, int], None], name: str = "extract_batches",
                fmt: str = "csv", checkpoint: str | None = None, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Run ``handle(batch_df, batch_id)`` on each micro-batch of new files
    (``foreachBatch``: batch operators such as the Pareto counts run on
    every batch; the handler should write idempotently by ``batch_id``)."""
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/{name}"
    return (extract_stream(spark, src_dir, schema, fmt, max_files_per_trigger).writeStream.foreachBatch(handle)
            .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
