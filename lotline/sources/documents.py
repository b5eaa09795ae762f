"""Nested JSON sources (S3) and JSON documents derived from the driver tables.

Files are read with an explicit schema and ``multiLine`` so many documents
load in parallel, one task per file split; a JSON column is parsed with
``from_json`` and the same schema. The derived documents are small by
construction (a fixed number of source rows per document), so no document
grows with the table; the number of documents does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.sources.tables import read_table

LIMITS_SCHEMA = T.StructType([
    T.StructField("ConfigurationSets", T.ArrayType(T.StructType([
        T.StructField("ConfigurationName", T.StringType()),
        T.StructField("Settings", T.ArrayType(T.StructType([
            T.StructField("LimitsSettings", T.StructType([
                T.StructField("VssLimitHigh", T.DoubleType()),
                T.StructField("VssLimitLow", T.DoubleType()),
                T.StructField("VccLimitHigh", T.DoubleType()),
                T.StructField("VccLimitLow", T.DoubleType()),
            ])),
            T.StructField("LeakageElements", T.ArrayType(T.StringType())),
        ]))),
    ]))),
])

MODES_SCHEMA = T.StructType([
    T.StructField("ProcessTypes", T.ArrayType(T.StructType([
        T.StructField("UnitInfo", T.ArrayType(T.StructType([
            T.StructField("ConfigDetails", T.ArrayType(T.StructType([
                T.StructField("ConfigSetName", T.StringType()),
                T.StructField("ExecutionMode", T.StringType()),
            ]))),
        ]))),
    ]))),
])


def read_nested_json(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """S3 (one document per file, or per line without ``multi_line``): one nested JSON document per file, parsed with an explicit schema;
    the file name is kept as ``source_file``."""
    return (spark.read.schema(schema).option("multiLine", multi_line).json(path)
                 .withColumn("source_file", F.col("_metadata.file_name")))


def parse_json_column(df: DataFrame, col: str, schema: T.StructType) -> DataFrame:
    """S3 for documents stored in a column: ``from_json`` with the schema."""
    return df.withColumn("doc", F.from_json(F.col(col), schema)).select("*", "doc.*").drop("doc", col)


# Fixed rule of the derived limits documents: eight parts per document,
# one configuration set per part, two settings per set.
PARTS_PER_DOC = 8
LIMIT_DOC_EXPRS = {
    "doc_id": f"CAST(floor(p_partkey / {PARTS_PER_DOC}) AS BIGINT)",
    "name": ("upper(p_type) || '_' || upper(replace(p_name, ' ', '_')) || '_' || "
             "CASE p_size % 6 WHEN 0 THEN 'LEAKHI' WHEN 1 THEN 'LOW' WHEN 2 THEN 'HI' WHEN 3 THEN 'LEAKLO' "
             "WHEN 4 THEN 'HIGH_LOW' ELSE 'NOM' END || CASE WHEN p_retailprice > 1500 THEN '_COLD' ELSE '' END"),
    "s1_vss_high": "p_retailprice / 1000",
    "s1_vss_low": "CAST(-1 * p_size AS DOUBLE) * 1e-12",
    "s1_vcc_high": "CAST(p_size AS DOUBLE)",
    "s1_vcc_low": "CASE WHEN p_size % 4 = 0 THEN 0.0 ELSE -1 * p_retailprice / 100000 END",
    "s1_el1": "'IP::PIN_' || CAST(p_partkey AS STRING)",
    "s1_el2": "'IP_CPU::GRP::' || upper(replace(p_name, ' ', '_'))",
    "s2_vss_high": "CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END",
    "s2_vcc_low": "CAST(p_size AS DOUBLE) / 7",
    "s2_el1": "'LANE_' || CAST(p_size AS STRING)",
}


def limit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, json): limits documents, one configuration set per part."""
    e = LIMIT_DOC_EXPRS
    p = read_table(spark, sf_dir, "part").selectExpr(*[f"{v} AS {k}" for k, v in e.items()])
    s1 = F.struct(
        F.struct(F.col("s1_vss_high").alias("VssLimitHigh"), F.col("s1_vss_low").alias("VssLimitLow"),
                 F.col("s1_vcc_high").alias("VccLimitHigh"), F.col("s1_vcc_low").alias("VccLimitLow")
                 ).alias("LimitsSettings"),
        F.array("s1_el1", "s1_el2").alias("LeakageElements"))
    s2 = F.struct(
        F.struct(F.col("s2_vss_high").alias("VssLimitHigh"), F.lit(None).cast("double").alias("VssLimitLow"),
                 F.lit(None).cast("double").alias("VccLimitHigh"), F.col("s2_vcc_low").alias("VccLimitLow")
                 ).alias("LimitsSettings"),
        F.array("s2_el1").alias("LeakageElements"))
    sets = F.struct(F.col("name").alias("ConfigurationName"), F.array(s1, s2).alias("Settings"))
    docs = p.groupBy("doc_id").agg(F.collect_list(sets).alias("ConfigurationSets"))
    return docs.select("doc_id", F.to_json(F.struct("ConfigurationSets")).alias("json"))


# Fixed rule of the derived mode documents: 64 events per document, process
# types by user parity, one unit per user, one config detail per event.
EVENTS_PER_DOC = 64
MODE_DOC_EXPRS = {
    "doc_id": f"CAST(floor(event_id / {EVENTS_PER_DOC}) AS BIGINT)",
    "ptype": "user_id % 2",
    "unit": "user_id",
    "config_set": "CASE WHEN event_id % 37 = 0 THEN NULL ELSE 'C' || CAST(user_id % 10 AS STRING) END",
    "mode": "CASE WHEN event_id % 31 = 0 THEN '' ELSE event_type END",
}


def mode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, json): execution-mode documents built from events."""
    e = MODE_DOC_EXPRS
    ev = read_table(spark, sf_dir, "events").selectExpr(*[f"{v} AS {k}" for k, v in e.items()])
    detail = F.struct(F.col("config_set").alias("ConfigSetName"), F.col("mode").alias("ExecutionMode"))
    units = ev.groupBy("doc_id", "ptype", "unit").agg(F.collect_list(detail).alias("ConfigDetails"))
    ptypes = units.groupBy("doc_id", "ptype").agg(F.collect_list(F.struct("ConfigDetails")).alias("UnitInfo"))
    docs = ptypes.groupBy("doc_id").agg(F.collect_list(F.struct("UnitInfo")).alias("ProcessTypes"))
    return docs.select("doc_id", F.to_json(F.struct("ProcessTypes")).alias("json"))
