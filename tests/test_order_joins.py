from __future__ import annotations

from pyspark.sql import functions as F

from lotline.operators import joins, order
from tests.conftest import rows


def sheet(spark):
    return spark.createDataFrame([
        (1, 0, "A", "x"), (2, 0, "B", "x"), (3, 0, " A ", "y"), (4, 0, None, "y"), (5, 0, "B", None),
        (6, 0, "", None), (7, 1, "Q", "z")], "ordinal long, sheet long, source_lot string, part string")


def test_group_by_first_seen(spark):
    out = order.group_by_first_seen(sheet(spark), "sheet", "source_lot", "ordinal")
    got = [r.ordinal for r in out.filter("sheet = 0").orderBy("position").collect()]
    assert got == [1, 3, 2, 5, 4, 6]       # A-group, B-group, then null / blank keys in order


def test_run_spans(spark):
    out = order.run_spans(sheet(spark).filter("sheet = 0"), "sheet", "ordinal", ["part"])
    assert rows(out, "start", "length", "value", "merged") == [(1, 2, "x", True), (3, 2, "y", True),
                                                               (5, 2, None, False)]


def test_positional_zip(spark):
    rows_ = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 1)], "sheet long, position long")
    ids = spark.createDataFrame([(0, "NEW", 1), (0, "OLD", 2), (1, "A", 1), (1, "B", 2)], "sheet long, id string, seq long")
    out = joins.positional_zip(rows_, ids, "sheet", "position", "seq")
    assert rows(out, "sheet", "position", "id") == [(0, 1, "OLD"), (0, 2, "NEW"), (0, 3, ""), (1, 1, "B")]


def test_template_fill(spark):
    tmpl = spark.createDataFrame([(1, 0, None, None), (2, 0, "p", None), (3, 0, "q", "r"), (4, 0, "s", "t")],
                                 "ordinal long, sheet long, a string, b string")
    best = joins.template_row(tmpl, "sheet", "ordinal", ["a", "b"])
    assert rows(best) == [(0, "q", "r")]               # most cells, first on a tie
    data = spark.createDataFrame([(0, "  v1" + chr(10) + "x ", None), (0, None, "m")], "sheet long, vpo string, mir string")
    out = joins.fill_template(data, best, "sheet", {"vpo_number": ["vpo"], "mir": ["mir"]},
                              ["vpo_number", "mir", "a", "b"])
    got = {tuple(r) for r in out.select("vpo_number", "mir", "a", "b").collect()}
    assert got == {("v1 x", None, "q", "r"), (None, "m", "q", "r")}


def test_status_counts(spark):
    df = spark.createDataFrame([(0, "a"), (0, ""), (1, "b")], "sheet long, id string")
    st = order.status_table(df, F.col("id") != "", F.lit("no id"))
    assert rows(order.workflow_counts(st, ["sheet"])) == [(0, 2, 1, 1), (1, 1, 1, 0)]


def test_limits_join_null_keys_duplicates_and_clash(spark):
    left = spark.createDataFrame([("VSS", "C1", "a"), (None, None, "b"), ("VCC", "C9", "c")],
                                 "test_type string, configuration string, note string")
    limits = spark.createDataFrame([("VSS", "C1", "h1", "n1"), ("VSS", "C1", "h2", "n2"), (None, None, "h3", "n3")],
                                   "TestType string, configuration string, high string, note string")
    out = joins.limits_left_join(left, limits, right_keys={"test_type": "TestType"})
    assert "note_leakage" in out.columns
    got = rows(out, "note", "high", "note_leakage")
    assert got == [("a", "h1", "n1"), ("a", "h2", "n2"), ("b", "h3", "n3"), ("c", None, None)]
    rate = joins.match_rate(left, limits.withColumnRenamed("TestType", "test_type")).collect()[0]
    assert (rate.total_rows, rate.matched_rows, rate.match_rate) == (3, 2, round(2 / 3, 6))


def test_limits_join_works_out_its_left_side_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(x):
        seen.add(1)
        return x
    left = spark.createDataFrame([("VSS", f"C{i % 3}") for i in range(30)], "test_type string, c string").repartition(2)
    left = left.select("test_type", key(F.col("c")).alias("configuration"))
    limits = spark.createDataFrame([("VSS", "C1", "h")], "test_type string, configuration string, high string")
    assert joins.limits_left_join(left, limits).filter("high = 'h'").count() == 10
    assert seen.value == 30
