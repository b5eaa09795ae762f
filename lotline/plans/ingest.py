"""Streaming queries (S11): extracts land as files, a file-source stream ingests them, and
the ingested table is the result; observations of export files, and which became ready."""

from __future__ import annotations

import uuid

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.operators import pareto_state
from lotline.plans.units import units
from lotline.session import checkpoint_dir
from lotline.sources.tables import read_table
from lotline.streaming import exports
from lotline.streaming.ingest import ingest_extracts, ingest_with

# Fixed columns of the landed extract files.
EXTRACT_SCHEMA = T.StructType([
    T.StructField("lot", T.StringType()),
    T.StructField("visual_id", T.StringType()),
    T.StructField("process_step", T.StringType()),
    T.StructField("devrevstep", T.StringType()),
    T.StructField("functional_bin", T.StringType()),
    T.StructField("interface_bin", T.StringType()),
    T.StructField("subflow_latest_flag", T.StringType()),
])


def q_ingest_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the unit extract as CSV files (one per scan split) in a fresh folder
    under the shared folder, ingest them with the file-source stream, and
    return the ingested table."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    landing, table = f"{root}/landing", f"{root}/table"
    cols = [f.name for f in EXTRACT_SCHEMA.fields]
    (units(spark, sf_dir).select(*cols)
        .write.option("header", True).csv(landing))
    q = ingest_extracts(spark, landing, EXTRACT_SCHEMA, table, name="ingest", checkpoint=f"{root}/state")
    q.awaitTermination()
    return spark.read.parquet(table).select(*cols)


# Export files as polls see them: one file per user, sizes that stand still for some polls,
# files that are older than the request, some polls that miss the file.
OBSERVATIONS = ["'export_' || CAST(user_id AS STRING) || '.csv' AS name",
                "CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value / 4) AS BIGINT) END AS size",
                "CASE WHEN event_type = 'error' THEN NULL WHEN user_id % 7 = 3 THEN TIMESTAMP '2023-12-01 00:00:00' ELSE ts END AS modified",
                "ts AS polled"]
REQUESTED = datetime(2024, 1, 3)
LIMIT = timedelta(days=9)
CHECKS = 3


def q_export_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the observations as a table, stream them through the stable-export rule and return the verdicts."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/verdicts-{uuid.uuid4().hex}"
    read_table(spark, sf_dir, "events").selectExpr(*OBSERVATIONS).coalesce(1).write.parquet(f"{root}/observed")
    stream = spark.readStream.schema(exports.OBSERVED).parquet(f"{root}/observed")
    query = (exports.verdicts(stream, REQUESTED, LIMIT, CHECKS, timers=False).writeStream.format("parquet").option("path", f"{root}/verdicts")
             .option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(exports.VERDICTS).parquet(f"{root}/verdicts")


#: Rows, about, of a landed file of units.
FILE_ROWS = 500_000


def land_units(rows: DataFrame, path: str) -> int:
    """Lands ``rows`` as CSV files of about FILE_ROWS rows, three at least, dealt evenly whatever they hold; returns how many."""
    files = max(3, -(-rows.count() // FILE_ROWS))
    rows.withColumn("_at", F.monotonically_increasing_id()).repartition(files, "_at").drop("_at").write.option("header", True).csv(path)
    return files


def q_pareto_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the unit extract as files, take them in two micro-batches, of two thirds and one third of
    the files, into the Pareto's state (S11, A7, A11) and return the Pareto that the state gives."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/pareto-{uuid.uuid4().hex}"
    schema = T.StructType([*EXTRACT_SCHEMA.fields, T.StructField("substructure_id", T.StringType())])
    rows = units(spark, sf_dir).select(*[f.name for f in schema.fields])
    files = land_units(rows, f"{root}/landing")
    query = ingest_with(spark, f"{root}/landing", schema, lambda batch, batch_id: pareto_state.add_batch(batch, f"{root}/state", batch_id),
                        checkpoint=f"{root}/stream", max_files_per_trigger=-(-2 * files // 3))
    query.awaitTermination()
    return pareto_state.current_pareto(spark, f"{root}/state")


QUERIES = {"pareto_batches": q_pareto_batches, "ingest_extracts": q_ingest_extracts, "export_verdicts": q_export_verdicts}
