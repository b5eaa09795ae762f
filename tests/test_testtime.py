from __future__ import annotations

from lotline.operators import testtime
from tests.conftest import rows

SCHEMA = ("visual_id string, operation string, devrevstep string, program_name string, dlcp string, "
          "test_name string, test_result string, lot string, functional_bin string")


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_parse_rules(spark):
    df = frame(spark, [
        ("u1", "o", "d", "P", "1", "T", "PRE_1.25MS_MAIN_10.50MS_ET_12.00MS", "L", "100"),
        ("u2", "o", "d", "P", "1", "T", "xx PRE_2.00MS_MAIN_1.00MS_ET_1.00MS yy", "L", "100"),
        ("u3", "o", "d", "P", "1", "T", "PRE_1MS_MAIN_10.50MS_ET_12.00MS", "L", "100"),   # integer: no match
        ("u4", "o", "d", "P", "1", "T", "PRE_1.25MS_MAIN_10.50MS", "L", "100"),           # no ET: no match
        ("u5", "o", "d", "P", "1", "T", None, "L", "100"),
    ])
    got = rows(testtime.parse_durations(df), "visual_id", "pre_time", "main_time", "total_time")
    assert got == [("u1", 1.25, 10.5, 11.75), ("u2", 2.0, 1.0, 3.0)]


def test_common_bin_tie_is_smaller(spark):
    df = frame(spark, [("u", "o", "d", "P", "1", "T", "PRE_1.00MS_MAIN_1.00MS_ET_1.00MS", "L", b)
                       for b in ["7", "5", "7", "5", None, None, None]])
    assert rows(testtime.most_common_bin(testtime.parse_durations(df))) == [("5",)]


def _prog(family, i):
    # 10th character decides the family
    return f"TPX0A0B1C{'H' if family == 'CCG' else 'E'}{i}"


def test_program_delta_thresholds(spark):
    data = []
    for u in range(6):
        data.append((f"u{u}", "o", "d", _prog("CCG", 1), "1", "T1", f"PRE_1.00MS_MAIN_{u}.00MS_ET_0.00MS", "L", "1"))
        data.append((f"v{u}", "o", "d", _prog("EDGE", 1), "1", "T1", f"PRE_2.00MS_MAIN_{u}.00MS_ET_0.00MS", "L", "1"))
    for u in range(4):   # only 4 units of one family in T2 -> dropped
        data.append((f"w{u}", "o", "d", _prog("CCG", 1), "1", "T2", "PRE_1.00MS_MAIN_1.00MS_ET_0.00MS", "L", "1"))
        data.append((f"x{u}", "o", "d", _prog("EDGE", 2), "1", "T2", "PRE_1.00MS_MAIN_1.00MS_ET_0.00MS", "L", "1"))
    out = testtime.program_delta(testtime.parse_durations(frame(spark, data))).collect()
    assert [(r.test_name, r.delta, r.ccg_sample_count, r.edge_sample_count, r.program_count) for r in out] == [
        ("T1", 1.0, 6, 6, 2)]


def test_lot_ttg_scopes(spark):
    data = [("u1", "o", "d", "P", "1", "T", "PRE_1.00MS_MAIN_1.00MS_ET_0.00MS", "A", "1"),
            ("u1", "o", "d", "P", "1", "T", "PRE_3.00MS_MAIN_1.00MS_ET_0.00MS", "B", "1")]
    parsed = testtime.parse_durations(frame(spark, data))
    assert rows(testtime.lot_ttg(parsed, "group"), "lot", "ttg_ms") == [("A", 2.0), ("B", 4.0)]
    assert rows(testtime.lot_ttg(parsed, "global"), "lot", "ttg_ms") == [("A", 6.0), ("B", 6.0)]
