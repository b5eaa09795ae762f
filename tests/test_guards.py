"""Errors that no plan prunes: under count, a projection of another column and a join."""

from __future__ import annotations

import pytest

from lotline.functions import guards
from lotline.operators import joins, testtime
from lotline.sources import text
from tests.conftest import rows

DURATION = ("v", "o", "d", "p", "c", "t", "l", "100")
SCHEMA = "visual_id string, operation string, devrevstep string, program_name string, dlcp string, test_name string, lot string, functional_bin string, test_result string"


def raises(spark, df, message, column):
    other = spark.range(1).withColumnRenamed("id", "_one")
    for action in (lambda: df.count(), lambda: df.select(column).collect(), lambda: df.join(other).collect(), lambda: df.write.format("noop").mode("overwrite").save()):
        with pytest.raises(Exception, match=message):
            action()


def test_empty_lot_list(spark):
    lines = spark.createDataFrame([("f", "L1\n"), ("g", "#none\n\n")], "file string, text string")
    raises(spark, text.read_lot_list(text.lines_from_text(lines)), "no lot in g", "ordinal")


def test_no_duration(spark):
    df = spark.createDataFrame([(*DURATION, "nothing"), (*DURATION, None)], SCHEMA)
    raises(spark, testtime.parse_durations(df), testtime.NO_DURATION, "lot")
    raises(spark, testtime.common_bin_durations(df), testtime.NO_DURATION, "lot")
    good = spark.createDataFrame([(*DURATION, "PRE_1.5MS_MAIN_2.0MS_ET_1.0MS")], SCHEMA)
    assert rows(testtime.parse_durations(good), "total_time") == [(3.5,)]


def test_no_matching_pin_group(spark):
    pins = spark.createDataFrame([("f", "A", "p1")], "file string, pin_group string, pin_name string")
    limits = spark.createDataFrame([("B",), (None,)], "pin_group string")
    raises(spark, joins.semi_join_groups(pins, limits), "no pin group", "file")


def test_a_guard_sees_rows_that_a_later_filter_drops(spark):
    df = spark.range(10).selectExpr("id", "id % 2 AS b")
    from pyspark.sql import functions as F

    checked = guards.require(df, F.col("id") < 9, F.concat(F.lit("bad "), F.col("id").cast("string")))
    raises(spark, checked.filter("id < 3"), "bad 9", "b")
    assert guards.require_rows(df.filter("id = 4"), "none").count() == 1
