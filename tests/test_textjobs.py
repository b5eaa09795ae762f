from __future__ import annotations

from lotline.operators import textjobs
from lotline.sources.text import lines_from_text
from tests.conftest import rows

PROGRAM = """Version 1.0;
Test PrimeDcLeakageTestMethod A1
{
    TestType = "VSS";
    ConfigurationFile = "x.json";
    # Configuration = "COMMENTED";
    Configuration = "REAL";
    BypassPort = 1;
}
# Test PrimeDcLeakageTestMethod SKIPPED
{
    TestType = "VCC";
}
  Test PrimeDcLeakageTestMethod INDENTED
{
    BypassPort = 7;
}
Test TraceAnalyticsDcLeakage B2
Test PrimeDcLeakageTestMethod C3
{
    Configuration =
        My_Rules.Temp("H1", "C1",
            "P1", "A1");
    BypassPort = -1 ;
}
Test OtherMethod D4
{
    TestType = "VCC";
}
"""


def lines(spark, text=PROGRAM, name="p.mtpl"):
    return lines_from_text(spark.createDataFrame([(name, text)], "file string, text string"))


def test_instances(spark):
    out = {r.test_instance_name: r for r in textjobs.extract_instances(lines(spark)).collect()}
    assert set(out) == {"A1", "B2", "C3"}            # commented and indented heads are not instances
    a = out["A1"]
    # commented field lines still match, first match wins; ConfigurationFile does not count
    assert (a.configuration, a.test_type, a.bypass_port, a.config_kind) == ("COMMENTED", "VSS", "1", "hardcoded")
    # the line right after a head never ends its window: B2 runs on through C3's block
    b = out["B2"]
    assert (b.bypass_port, b.config_kind, b.configuration) == ("-1", "rule", "H1")
    c = out["C3"]
    assert (c.configuration, c.cold_config, c.phmhot_config, c.all_config) == ("H1", "C1", "P1", "A1")
    assert (c.test_type, c.bypass_port, c.test_method) == ("UNKNOWN", "-1", "PrimeDcLeakageTestMethod")


def test_instances_lite_stops_at_next_test(spark):
    out = {r.instance_name: r.bypass_port for r in textjobs.extract_instances_lite(lines(spark)).collect()}
    assert out == {"A1": "1", "B2": "UNKNOWN", "C3": "-1"}


def test_field_far_down_the_block(spark):
    text = "Test PrimeDcLeakageTestMethod Z\n" + "\n" * 199 + "TestType = \"VSS\";\n" + "x\n" * 20 + \
        "BypassPort = 4;\nConfiguration =\n" + "  part\n" * 30 + "  \"REAL\";\n" + "Test Other O\nBypassPort = 9;\n"
    for chunk in (3, 50_000):
        r = textjobs.extract_instances(lines(spark, text), chunk_lines=chunk).collect()[0]
        assert (r.test_type, r.bypass_port) == ("VSS", "4") and r.configuration.endswith("REAL")
        lite = textjobs.extract_instances_lite(lines(spark, text), chunk_lines=chunk).collect()
        assert [x.bypass_port for x in lite] == ["4"]


def test_configuration_does_not_cross_the_block_end(spark):
    text = "Test PrimeDcLeakageTestMethod Z\n{\nConfiguration =\nTest Other O\n\"X\";\n"
    assert textjobs.extract_instances(lines(spark, text)).collect()[0].configuration == "UNKNOWN"


def test_instance_counts(spark):
    got = rows(textjobs.instance_counts(textjobs.extract_instances(lines(spark))))
    assert got == [("bypass_port", "-1", 2), ("bypass_port", "1", 1),
                   ("test_method", "PrimeDcLeakageTestMethod", 2), ("test_method", "TraceAnalyticsDcLeakage", 1)]


LIMITS = """Test iCShopsTest UPPERDIODE_A
{
    upper_diode_limit_high = Some.Func("1", "2", "3", "4", "5");
}
#Test iCShopsTest LOWERDIODE_SKIP
{
    lower_diode_limit_low(9, 9, 9, 9, 9)
}
Test iCShopsTest LOWERDIODE_B
{
    lower_diode_limit_low( -0.650, 2, 3, 4, 5 )
}
  # Test iCShopsTest UPPERDIODE_GONE
{
    upper_diode_limit_high = F("7", "7", "7", "7", "7");
}
Test iCShopsTest X_FF
{
}
Test iCShopsTest UPPERDIODE_A
{
    upper_diode_limit_low = TPI_SHOPS_Rules.Selector_UPPERDIODE_limit_low_EVG("a", "b", "c", "d", "e");
}
"""


def test_limits(spark):
    out = {r.test_name: r for r in textjobs.extract_limits(lines(spark, LIMITS, "l.mtpl")).collect()}
    assert set(out) == {"UPPERDIODE_A", "LOWERDIODE_B"}
    a = out["UPPERDIODE_A"]                           # the later block wins
    assert (a.category, a.PHMCOLD_high, a.PHMCOLD_low, a.ALL_low) == ("UPPERDIODE", "N/A", "a", "e")
    b = out["LOWERDIODE_B"]
    assert (b.category, b.PHMCOLD_low, b.PHMHOT_low, b.PHMCOLD_high) == ("LOWERDIODE", "-0.650", "2", "N/A")
    long = rows(textjobs.limits_long(textjobs.extract_limits(lines(spark, LIMITS, "l.mtpl"))),
                "test_name", "condition", "low_limit")
    assert ("LOWERDIODE_B", "ALL", "5") in long and len(long) == 10


def test_limits_are_per_file(spark):
    df = spark.createDataFrame([("a", LIMITS), ("b", LIMITS.replace('"1"', '"8"')), ("none", "x\n" * 50)], "file string, text string")
    wide = textjobs.extract_limits(lines_from_text(df))
    assert rows(wide, "file", "test_name") == [(f, t) for f in "ab" for t in ("LOWERDIODE_B", "UPPERDIODE_A")]
    assert textjobs.limits_long(wide).count() == 20


def test_limit_heads_over_two_lines(spark):
    text = ("#\n  Test iCShopsTest UPPERDIODE_GONE\nupper_diode_limit_high(1, 1, 1, 1, 1)\n"
            "Test iCShopsTest\n\n  LOWERDIODE_NEXT\n{\nlower_diode_limit_low(2, 3, 4, 5, 6)\n}\n")
    for chunk in (2, 50_000):
        got = textjobs.extract_limits(lines(spark, text, "l.mtpl"), chunk_lines=chunk)
        assert rows(got, "test_name", "PHMCOLD_low", "ALL_low") == [("LOWERDIODE_NEXT", "2", "6")]


PINS = """header
Group LANE_A
{
    PIN_ONE;
    #PIN_TWO,
    PIN_X__SFX
    pin_lower
}
PIN_OUTSIDE;
Group LANE_B
    PIN_THREE;
Group LANE_C
  PIN_FOUR
"""


def test_pins(spark):
    got = rows(textjobs.extract_pin_groups(lines(spark, PINS, "pins.txt")), "pin_group", "pin_name")
    assert got == [("LANE_A", "#PIN_TWO"), ("LANE_A", "PIN_ONE"), ("LANE_A", "PIN_X__SFX"),
                   ("LANE_B", "PIN_THREE"), ("LANE_C", "PIN_FOUR")]


SOC = """    IP_EARLY 1.5;
Resource R1
    IP_A 0.005;
    IP_B [x]0.25;
    IP_C -3.25;
    IP_D 0;
Resource R2
    IP_E 150;
    IP_F 1:2;
    IP_G 0.0025;
"""


def test_resources(spark):
    got = rows(textjobs.extract_resources(lines(spark, SOC, "soc.txt")), "resource", "pin_name", "distinctive_value")
    assert got == [("", "IP_EARLY", "1500"), ("R1", "IP_A", "5"), ("R1", "IP_B", "250"), ("R1", "IP_C", "-3250"),
                   ("R1", "IP_D", ""), ("R2", "IP_E", ""), ("R2", "IP_F", ""), ("R2", "IP_G", "2")]


def test_ids_first_seen_distinct(spark):
    df = spark.createDataFrame([(1, "VPO  A1 x VPO B2 VPO A1 VPO C3 VPO D4 " + " ".join(f"VPO E{i}" for i in range(40)))], "k int, t string")
    got = rows(textjobs.extract_ids(df, "k", "t", "VPO"), "seq", "id")
    assert len(got) == 44 and {(1, "A1"), (2, "B2"), (3, "C3"), (4, "D4"), (44, "E39")} <= set(got)


def test_pins_per_group_by_file(spark):
    df = spark.createDataFrame([("a", PINS), ("b", PINS)], "file string, text string")
    got = rows(textjobs.pins_per_group(textjobs.extract_pin_groups(lines_from_text(df))), "file", "pin_group", "pin_count")
    assert got == [(f, g, n) for f in "ab" for g, n in (("LANE_A", 3), ("LANE_B", 1), ("LANE_C", 1))]


def test_small_chunks_give_same_results(spark):
    """Chunk boundaries must not change any result."""
    big = PROGRAM * 3
    ls = lines(spark, big)
    for fn in (textjobs.extract_instances, textjobs.extract_instances_lite):
        assert rows(fn(ls, chunk_lines=4)) == rows(fn(ls))
    limits = lines(spark, LIMITS * 2, "l.mtpl")
    assert rows(textjobs.extract_limits(limits, chunk_lines=3)) == rows(textjobs.extract_limits(limits))
    pins = lines(spark, PINS * 2, "pins.txt")
    assert rows(textjobs.extract_pin_groups(pins, chunk_lines=2)) == rows(textjobs.extract_pin_groups(pins))
    soc = lines(spark, SOC * 2, "soc.txt")
    assert rows(textjobs.extract_resources(soc, chunk_lines=3)) == rows(textjobs.extract_resources(soc))


def test_split_line_numbers(spark, tmp_path):
    from pyspark.sql import functions as F

    from lotline.sources.text import read_program_lines, read_whole_files
    p = tmp_path / "prog.mtpl"
    p.write_text(PROGRAM * 200)
    (tmp_path / "small.mtpl").write_text("one\ntwo\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")     # several splits per file
    try:
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        a = read_program_lines(spark, str(tmp_path))
        b = read_whole_files(spark, str(tmp_path)).select("file", F.col("line_no").cast("long"), "line")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        assert a.count() == len((PROGRAM * 200).splitlines()) + 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_many_open_configuration_lines(spark):
    """Open lines one after the other up to one ';': the first gives the value, in one span."""
    from lotline.operators import textjobs

    n = 20_000
    body = ["Test PrimeDcLeakageTestMethod A1", "{"] + [f'  Configuration {i}' for i in range(n)] + ['  = "HOT_1";', "}"]
    body += ["Test PrimeDcLeakageTestMethod B2", "{", '  Configuration = "COLD_2";', "}"]
    out = {r.test_instance_name: r.configuration for r in textjobs.extract_instances(lines(spark, "\n".join(body) + "\n")).collect()}
    assert set(out) == {"A1", "B2"} and out["B2"] == "COLD_2"
    heads = rows(textjobs.instance_counts(textjobs.extract_instance_heads(lines(spark, "\n".join(body) + "\n"))))
    assert heads == rows(textjobs.instance_counts(textjobs.extract_instances(lines(spark, "\n".join(body) + "\n"))))
