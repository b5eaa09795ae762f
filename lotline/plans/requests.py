"""Request-workflow table queries (E4 table steps) and lot lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.operators import joins, order, textjobs
from lotline.sources import adapters, programs
from lotline.sources.tables import read_table
from lotline.sources.text import read_lot_list, split_batches

# Fixed values of the sheet columns (template order) and where a request
# row's value comes from.
TEMPLATE_COLUMNS = ("vpo_number", "location_code", "source_lot", "mir", "part_type", "quantity", "eng_id", "hri")
MAPPED = {
    "vpo_number": ("id", "vpo", "vpo_number"),
    "location_code": ("operation", "location_code", "location"),
    "source_lot": ("source_lot",),
    "mir": ("mir",),
}
DEFAULTED = ("part_type", "quantity", "eng_id", "hri")
LOT_BATCH = 3


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.group_by_first_seen(adapters.requests(spark, sf_dir), "sheet", "source_lot", "ordinal")


def dashboard_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids shown on each sheet's dashboard page, newest first (T9 on pages)."""
    ids = textjobs.extract_ids(read_table(spark, sf_dir, "pages"), "page_id", "html", 'href="/')
    return ids.select(F.col("page_id").alias("sheet"), "id", "seq")


def zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.positional_zip(ordered(spark, sf_dir), dashboard_ids(spark, sf_dir), "sheet", "position", "seq")


def q_request_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(spark, sf_dir)


def q_request_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.run_spans(ordered(spark, sf_dir), "sheet", "position", ["source_lot", "part_type", "operation"])


def q_request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zipped(spark, sf_dir)


def q_request_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    defaults = joins.template_row(adapters.requests(spark, sf_dir), "sheet", "ordinal", DEFAULTED)
    return joins.fill_template(zipped(spark, sf_dir), defaults, "sheet", MAPPED, TEMPLATE_COLUMNS)


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = (F.col("id") != "") & F.col("first_seen").isNotNull()
    reason = F.when(F.col("id") == "", F.lit("no id")).otherwise(F.lit("no source lot"))
    return order.status_table(zipped(spark, sf_dir), ok, reason)


def q_request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.workflow_counts(status(spark, sf_dir), ["sheet"])


def lot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_lot_list(programs.program_lines(spark, sf_dir, "lot_list"))


def q_lot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lot_ids(spark, sf_dir)


def q_lot_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_batches(lot_ids(spark, sf_dir), LOT_BATCH)
