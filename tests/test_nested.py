from __future__ import annotations

from pyspark.sql import functions as F

from lotline.functions.classify import leak_class
from lotline.operators import nested
from lotline.sources import documents
from tests.conftest import rows


def test_plain_number(spark):
    df = spark.createDataFrame([(0.0,), (1e-11,), (100.0,), (-0.5,), (12.345678912,), (None,)], "x double")
    got = [r[0] for r in df.select(nested.plain_number(F.col("x"))).collect()]
    assert got == ["0", "0.00000000001", "100", "-0.5", "12.34567891", ""]


def test_flatten_and_classes(spark):
    doc = ('{"ConfigurationSets": [{"ConfigurationName": "X_HOT_HIGH_LOW", "Settings": [{"LimitsSettings": '
           '{"VssLimitHigh": 1.5, "VccLimitLow": 0.25}, "LeakageElements": ["IP::A::B", "C"]}]}, '
           '{"ConfigurationName": "COLD_LO", "Settings": [{"LeakageElements": ["D"]}]}, '
           '{"ConfigurationName": "NONE"}]}')
    docs = documents.parse_json_column(spark.createDataFrame([(1, doc)], "doc_id int, json string"), "json",
                                       documents.LIMITS_SCHEMA)
    flat = nested.flatten_limits(docs)
    assert rows(flat, "configuration", "pin_group", "vss_limit_high", "vcc_limit_low") == [
        ("COLD_LO", "D", "", ""), ("X_HOT_HIGH_LOW", "A::B", "1.5", "0.25"), ("X_HOT_HIGH_LOW", "C", "1.5", "0.25")]
    cls = nested.split_by_class(flat)
    assert rows(cls, "leak_class", "pin_group", "test_type") == [
        ("COLD_LO", "D", "VCC"), ("HOT_HI", "A::B", "VSS"), ("HOT_HI", "C", "VSS")]


def test_leak_class_priority(spark):
    df = spark.createDataFrame([("hot_hi_lo",), ("cold_low",), ("warm_hi",), ("HOT_CLOCK",)], "c string")
    got = dict(df.select("c", leak_class(F.col("c"))).collect())
    assert got == {"hot_hi_lo": "HOT_HI", "cold_low": "COLD_LO", "warm_hi": None, "HOT_CLOCK": "HOT_LO"}


def test_mode_counts_and_shares(spark):
    d = spark.createDataFrame([("A", "x")] * 1 + [("A", "y")] * 15 + [("A", "")] + [(None, "x")] + [("B", "x")],
                              "config_set string, execution_mode string")
    out = nested.share_in_group(nested.mode_counts(d))
    got = {(r.config_set, r.execution_mode): (r["count"], r.percentage_text) for r in out.collect()}
    assert got == {("A", "x"): (1, "6.2%"), ("A", "y"): (15, "93.8%"), ("B", "x"): (1, "100.0%")}
