"""Program-text extraction queries (instances, limits, pins, resources, page ids)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.operators import joins, textjobs
from lotline.plans import nested as nested_plans
from lotline.sources import programs
from lotline.sources.tables import read_table


def instance_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs.program_lines(spark, sf_dir, "instance_program")


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.extract_instances(instance_lines(spark, sf_dir))


def q_program_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instance_lines(spark, sf_dir)


def q_extract_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances(spark, sf_dir)


def q_extract_instances_lite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.extract_instances_lite(instance_lines(spark, sf_dir))


def q_instance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.instance_counts(textjobs.extract_instance_heads(instance_lines(spark, sf_dir)))


def q_instance_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances(spark, sf_dir).groupBy("config_kind", "bypass_port", "test_type").agg(
        F.count(F.lit(1)).alias("instances"))


def limits_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.extract_limits(programs.program_lines(spark, sf_dir, "limits_program"))


def q_extract_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limits_wide(spark, sf_dir)


def q_limits_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.limits_long(limits_wide(spark, sf_dir))


def pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.extract_pin_groups(programs.program_lines(spark, sf_dir, "pin_program"))


def q_pin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pins(spark, sf_dir)


def q_pins_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.pins_per_group(pins(spark, sf_dir))


def q_pin_group_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.semi_join_groups(pins(spark, sf_dir), nested_plans.limits(spark, sf_dir))


def q_group_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.group_match_counts(pins(spark, sf_dir), nested_plans.limits(spark, sf_dir))


def q_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textjobs.extract_resources(programs.program_lines(spark, sf_dir, "resource_program"))


# Fixed value of the page-id job: links are the labelled ids.
PAGE_LABEL = 'href="/'


def q_page_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return textjobs.extract_ids(pages, "page_id", "html", PAGE_LABEL)


def q_limits_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lotline.operators import nested
    limits = nested.split_by_class(nested_plans.limits(spark, sf_dir))
    return joins.limits_left_join(instances(spark, sf_dir), limits)


def q_match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lotline.operators import nested
    limits = nested.split_by_class(nested_plans.limits(spark, sf_dir))
    return joins.match_rate(instances(spark, sf_dir), limits)
