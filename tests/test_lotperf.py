from __future__ import annotations

from pyspark.sql import functions as F

from lotline.operators import lotperf
from tests.conftest import rows

SESS = ("lot string, visual_id string, operation string, facility string, sub_flow_step string, s_spec string, "
        "prodgroup3 string, program_name string, devrevstep string, goodbad_flag string, "
        "within_lao_sfs_latest_flag string, within_session_sequence_number int, test_time double")


def sess(spark, data):
    return spark.createDataFrame(data, SESS)


def base(lot, vid, gb, latest, seq, t, step="CLASSHOT", dev="D1"):
    return (lot, vid, "6248", "F1", step, "Q", "PG", "P", dev, gb, latest, seq, t)


def test_measures(spark):
    df = sess(spark, [
        base("A", "u1", "G", "Y", 1, 10.0),
        base("A", "u2", "B", "N", 1, 4.0),
        base("A", "u2", "G", "Y", 2, 6.0),
        base("A", "u3", "B", "Y", 1, 8.0),
        base("A", None, "G", "Y", 1, 1.0),
    ])
    r = lotperf.lot_performance(df).collect()[0]
    assert r.total_tested == 3
    assert r.tested_good == 3
    assert r.yield_ratio == 1.0 and r.yield_pct == "100.00%"
    assert r.ttg == round((10 + 6 + 1) / 3, 2)
    assert r.ttb == 6.0                      # bad time 12 / bad rows 2
    assert r.rcs_ratio == round(1 / 3, 8) and r.rcs_pct == "33.33%"
    assert r.recovery_rate == 100.0 and r.recovery_rate_pct == "100.00%"
    assert r.ett == round((r.ttg * 1.0 + 6.0 * (1 - 1.0 + r.rcs_ratio)) / (1 + r.rcs_ratio), 2)


def test_null_rules(spark):
    df = sess(spark, [base("B", "u1", "B", "Y", 1, 3.0), base("C", "u9", "G", "Y", 1, 2.0)])
    got = {r.lot: r for r in lotperf.lot_performance(df).collect()}
    assert got["B"].ttg is None and got["B"].ett is None          # no good unit
    assert got["B"].recovery_rate is None and got["B"].recovery_rate_pct is None  # none retested
    assert got["C"].ttb == 0.0                                     # no final bad


def test_excluded_sub_flows_and_two_device_steps(spark):
    df = sess(spark, [base("A", "u1", "G", "Y", 1, 1.0, step="SPH"), base("A", "u2", "G", "Y", 1, 1.0, step=None),
                      base("A", "u3", "G", "Y", 1, 1.0, dev="D1"), base("A", "u4", "G", "Y", 1, 1.0, dev="D2")])
    out = lotperf.lot_performance(df)
    assert rows(out, "sub_flow_step", "devrevstep", "total_tested") == [("CLASSHOT", "D1", 2), ("CLASSHOT", "D2", 2)]


def test_null_device_step_is_a_row(spark):
    df = sess(spark, [base("A", "u1", "G", "Y", 1, 1.0, dev="D1"), base("A", "u2", "G", "Y", 1, 1.0, dev=None)])
    assert rows(lotperf.lot_performance(df), "devrevstep", "total_tested") == [("D1", 2), (None, 2)]


def test_step_rank(spark):
    df = spark.createDataFrame([(" classhot ",), ("PHMCOLD",), ("ZZZ",), (None,)], "s string")
    got = dict(df.select("s", lotperf.step_rank(F.col("s")).alias("r")).collect())
    assert got == {" classhot ": 0, "PHMCOLD": 3, "ZZZ": 4, None: 999}


def test_forward_fill(spark):
    df = spark.createDataFrame([("s1", 1, "6248", "A"), ("s1", 2, None, None), ("s1", 3, None, "B"),
                                ("s1", 4, "7820", None), ("s2", 1, None, "C"), ("s2", 2, "9", None)],
                               "sheet string, ordinal int, operation string, sub_flow_step string")
    out = lotperf.forward_fill(df, ["operation", "sub_flow_step"])
    assert rows(out) == [("s1", 1, "6248", "A"), ("s1", 2, "6248", "A"), ("s1", 3, "6248", "B"),
                         ("s1", 4, "7820", "B"), ("s2", 1, None, "C"), ("s2", 2, "9", "C")]


def test_target_lookup_wildcards_and_first(spark):
    facts = spark.createDataFrame([
        ("6248", "CLASSHOT", "D1"),     # exact
        ("6248", None, "D1"),           # wildcard sub flow -> first of two rows
        (" ", None, None),              # blank / null keys: no key at all -> no match
        ("6248", "CLASSHOT", "D9"),     # no target
    ], "operation string, sub_flow_step string, devrevstep string")
    targets = spark.createDataFrame([
        (1, "6248.0", "CLASSCOLD", "D1", "0.9", 10.0, "5%"),
        (2, "6248", "CLASSHOT", "D1", "0.8", 11.0, "6%"),
        (3, "6248", "CLASSHOT", "D1", "0.7", 12.0, "7%"),
    ], "ordinal int, operation string, sub_flow_step string, devrevstep string, yield_target string, "
       "ttg_target double, rcs_target string")
    out = {(r.operation, r.sub_flow_step, r.devrevstep): r.yield_target
           for r in lotperf.target_lookup(facts, targets).collect()}
    assert out[("6248", "CLASSHOT", "D1")] == "0.8"
    assert out[("6248", None, "D1")] == "0.9"
    assert out[(" ", None, None)] is None
    assert out[("6248", "CLASSHOT", "D9")] is None


def test_target_status_equality(spark):
    from lotline.functions.classify import normalise_rate, target_status
    df = spark.createDataFrame([(80.0, 80.0), (81.0, 80.0), (None, 1.0)], "v double, t double")
    out = df.select(target_status(F.col("v"), F.col("t"), True).alias("y"),
                    target_status(F.col("v"), F.col("t"), False).alias("g"))
    assert [tuple(r) for r in out.collect()] == [("bad", "good"), ("good", "bad"), (None, None)]
    r = spark.createDataFrame([("0.753",), ("75.3%",), ("1",), ("x",)], "s string")
    assert [x[0] for x in r.select(normalise_rate(F.col("s"))).collect()] == [75.3, 75.3, 100.0, None]
