"""Queries over what the sinks and file readers hand on: each lands a result in a
fresh folder under the shared folder with a sink and reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.operators import diff, nested, pareto, present
from lotline.operators.clean import optional_predicates
from lotline.plans import nested as nested_plans
from lotline.plans import requests, textjobs
from lotline.plans.lotperf import q_lot_performance
from lotline.plans.units import units
from lotline.session import shared_dir
from lotline.sinks import writers
from lotline.sources import adapters, documents
from lotline.sources.extracts import union_batches
from lotline.sources.files import newest_by_name
from lotline.sources.text import read_program_lines

# Fixed value: the day the time predicate counts back from.
AS_OF = "2025-06-30"
SINCE_DAYS = 600


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def q_limits_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: the limits documents as JSON files, one document per line."""
    path = fresh(spark, "limits")
    docs = documents.limit_documents(spark, sf_dir)
    # the id becomes the document's first field
    with_id = F.concat(F.lit('{"doc_id":'), F.to_json(F.struct(F.col("doc_id").alias("v"))), F.lit(","), F.expr("substring(json, 2)"))
    docs.select(with_id.alias("value")).write.text(path)
    key = T.StructType([T.StructField("v", docs.schema["doc_id"].dataType)])
    schema = T.StructType([T.StructField("doc_id", key), *documents.LIMITS_SCHEMA.fields])
    read = documents.read_nested_json(spark, path, schema, multi_line=False).drop("source_file")
    return nested.flatten_limits(read.withColumn("doc_id", F.col("doc_id.v")))


def q_program_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The programs as text files, read in splits."""
    path = fresh(spark, "programs")
    (textjobs.instance_lines(spark, sf_dir).repartition("file").sortWithinPartitions("file", "line_no")
     .select("file", F.col("line").alias("value")).write.partitionBy("file").text(path))
    lines = read_program_lines(spark, path)
    return lines.select(F.regexp_extract("file", r"/file=([^/]+)/", 1).alias("file"), F.col("line_no").cast("int").alias("line_no"), "line")


def q_union_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extract per facility; the last two lack some columns."""
    u = units(spark, sf_dir).select("visual_id", "lot", "facility", "functional_bin", "unit_tester_id", "lots_temperature")
    parts = [u.filter(F.col("facility") == f"F{i}") for i in range(3)]
    return union_batches([parts[0], parts[1].drop("lots_temperature"), parts[2].drop("unit_tester_id", "lots_temperature")])


def q_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three exports of requests under stamped names; the newest stamp wins,
    not the name that sorts last, and only that export is read."""
    path = fresh(spark, "exports")
    req = adapters.requests(spark, sf_dir).select("ordinal", "mir")
    for part, name in ((0, "MIR_Results_20250301_120000"), (1, "MIR_Results_20241231_235959"), (2, "MIR_Results_with_VPO_20260101_000000")):
        req.filter(F.col("ordinal") % 3 == part).write.option("header", True).csv(f"{path}/{name}.csv")
    newest = newest_by_name(spark, f"{path}/*", r"MIR_Results_(\d{8}_\d{6})\.csv")
    return spark.read.schema(req.schema).option("header", True).csv(newest)


def q_report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the Pareto as a CSV run folder."""
    table = pareto.bin_pareto(units(spark, sf_dir))
    target = writers.write_table(table, fresh(spark, "report"), fmt="csv", run_ts="20250101_000000")
    return spark.read.schema(table.schema).option("header", True).csv(target)


def q_class_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the limits routed to one table per leak class, all read back."""
    path = fresh(spark, "classes")
    limits = nested_plans.q_leak_class_limits(spark, sf_dir)
    writers.write_multi_table(limits, "leak_class", path)
    return spark.read.schema(limits.schema).parquet(path)


def q_report_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: the daily report's tables as one version; a first version of one table is swapped for it."""
    path = fresh(spark, "bundle")
    u = units(spark, sf_dir)
    shown = ("visual_id", "lot", "process_step", "devrevstep", "functional_bin", "interface_bin")
    details = pareto.normalized_units(u).select(*shown)
    writers.write_bundle({"exceptions": pareto.unit_exceptions(u).select(*shown)}, path)
    writers.write_bundle({"pareto": pareto.bin_pareto(u), "details": details, "exceptions": pareto.unit_exceptions(u).select(*shown)}, path)
    out = [writers.read_part(spark, path, p).withColumn("part", F.lit(p)) for p in ("pareto", "details", "exceptions")]
    return out[0].unionByName(out[1], allowMissingColumns=True).unionByName(out[2], allowMissingColumns=True)


def q_snapshot_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: two dated snapshots, the second written twice, and their change log."""
    path = fresh(spark, "snapshots")
    writers.write_snapshot(adapters.snapshot_old(spark, sf_dir), path, "20250101")
    for _ in range(2):
        writers.write_snapshot(adapters.snapshot_new(spark, sf_dir), path, "20250108")
    old, new = writers.last_two_snapshots(spark, path)
    return diff.change_log(new, old)


def q_status_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: ok and rejected requests side by side, with step and time of the job, all read back."""
    path = fresh(spark, "status")
    status = requests.status(spark, sf_dir).withColumns({"step": F.lit("zip"), "at": F.current_timestamp()})
    writers.write_status(status, path)
    back = spark.read.schema(status.schema).parquet(path).filter("at <= current_timestamp()")
    return back.select("sheet", "position", "ordinal", "id", "source_lot", "status", "reason", "step")


def q_predicate_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every predicate form, counted by operation."""
    s = adapters.test_sessions(spark, sf_dir)
    today = F.lit(AS_OF).cast("date")
    forms = {
        "like": optional_predicates(s, like={"sub_flow_step": "CLASS%"}),
        "like_any": optional_predicates(s, like_any={"sub_flow_step": ["%HOT", "PHM%"]}),
        "equals": optional_predicates(s, equals={"goodbad_flag": "B"}),
        "isin": optional_predicates(s, isin={"program_name": ["PRG0", "PRG9"]}),
        "not_in": optional_predicates(s, not_in={"sub_flow_step": ["SPH", "SCS"]}),
        "since": optional_predicates(s, since_days={"test_end_date": SINCE_DAYS}, today=today),
        "all": optional_predicates(s, like={"sub_flow_step": "CLASS%"}, equals={"goodbad_flag": "G"}, isin={"program_name": ["PRG0"]}),
    }
    out = [df.groupBy("operation").agg(F.count("*").alias("rows")).select(F.lit(n).alias("form"), "operation", "rows") for n, df in forms.items()]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def q_limits_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.limits_rank(textjobs.limits_wide(spark, sf_dir)).select("file", "category", "test_name", "rank")


def q_mode_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present.mode_rank(nested_plans.q_mode_counts(spark, sf_dir)).select("config_set", "execution_mode", "count", "rank")


def q_lot_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    perf = q_lot_performance(spark, sf_dir).select("lot", "facility", "operation", "sub_flow_step", "devrevstep", "program_name").distinct()
    return present.lot_rank(perf)


QUERIES = {
    "limits_files": q_limits_files, "program_files": q_program_files, "union_batches": q_union_batches,
    "latest_snapshot": q_latest_snapshot, "report_csv": q_report_csv, "class_tables": q_class_tables,
    "report_bundle": q_report_bundle, "snapshot_rotation": q_snapshot_rotation, "status_tables": q_status_tables,
    "predicate_forms": q_predicate_forms, "limits_rank": q_limits_rank, "mode_rank": q_mode_rank, "lot_rank": q_lot_rank,
}
