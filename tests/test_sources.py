from __future__ import annotations

import os
import tempfile

from pyspark.sql import types as T

from lotline.sources import files, programs, text
from tests.conftest import rows


def test_lines_like_splitlines(spark):
    df = spark.createDataFrame([("a", "x\r\ny\n\n\n"), ("b", "only")], "file string, text string")
    got = rows(text.lines_from_text(df))
    assert got == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, ""), ("a", 3, ""), ("b", 0, "only")]
    assert len("x\r\ny\n\n\n".splitlines()) == 4


def test_lot_list_and_batches(spark):
    df = spark.createDataFrame([("f", "  L1 \n\n# L9\nL2\nL1\nL3\nL4\n")], "file string, text string")
    ids = text.read_lot_list(text.lines_from_text(df))
    assert rows(ids, "lot", "ordinal") == [("L1", 0), ("L2", 3), ("L3", 5), ("L4", 6)]
    b = text.split_batches(ids, 3)
    assert rows(b, "lot", "batch_id") == [("L1", 0), ("L2", 0), ("L3", 0), ("L4", 1)]
    assert {r.batch_id for r in text.split_batches(ids, None).collect()} == {0}


def test_lot_list_strips_tabs_and_refuses_empty_lists(spark):
    import pytest
    ids = text.read_lot_list(text.lines_from_text(spark.createDataFrame([("f", "\tL1\t\n\t#x\n")], "file string, text string")))
    assert rows(ids, "lot", "ordinal") == [("L1", 0)]
    bad = spark.createDataFrame([("f", "L1\n"), ("g", "#none\n\n")], "file string, text string")
    with pytest.raises(Exception, match="no lot in g"):
        text.read_lot_list(text.lines_from_text(bad)).collect()


def test_read_files_and_encodings(spark):
    d = tempfile.mkdtemp(prefix="lotline-src-", dir="/tmp")
    with open(os.path.join(d, "a.csv"), "w", encoding="utf-8-sig") as f:
        f.write("SourceLot,Part\nL1,é\n")
    with open(os.path.join(d, "b.csv"), "wb") as f:
        f.write("SourceLot,Part\nL2,é\n".encode("latin-1"))
    schema = T.StructType([T.StructField("SourceLot", T.StringType()), T.StructField("Part", T.StringType())])
    got = rows(files.read_delimited(spark, d, schema), "SourceLot", "Part")
    assert got == [("L1", "é"), ("L2", "é")]
    prog = os.path.join(d, "progs")
    os.makedirs(prog)
    with open(os.path.join(prog, "p.txt"), "w") as f:
        f.write("a\nb\n\n")
    assert rows(text.read_program_lines(spark, prog), "line_no", "line") == [(0, "a"), (1, "b"), (2, "")]


def test_latest_by_name(spark):
    d = tempfile.mkdtemp(prefix="lotline-latest-", dir="/tmp")
    for name, v in [("MIR_Results_20250101_000000.csv", "old"), ("MIR_Results_20250301_000000.csv", "new"),
                    ("MIR_Results_with_VPO_20250101_000000.csv", "other")]:
        with open(os.path.join(d, name), "w") as f:
            f.write(f"v\n{v}\n")
    df = spark.read.option("header", True).csv(d)
    out = files.latest_by_name(df, r"^MIR_Results_(\d{8}_\d{6})\.csv$")
    assert rows(out, "v") == [("new",)]


def test_gbk_when_allowed(spark):
    d = tempfile.mkdtemp(prefix="lotline-gbk-", dir="/tmp")
    with open(os.path.join(d, "g.csv"), "wb") as f:
        f.write("SourceLot,Part\nL3,测试\n".encode("gbk"))
    with open(os.path.join(d, "l.csv"), "wb") as f:
        f.write("SourceLot,Part\nL4,é\n".encode("latin-1"))
    schema = T.StructType([T.StructField("SourceLot", T.StringType()), T.StructField("Part", T.StringType())])
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        got = rows(files.read_delimited(spark, d, schema), "SourceLot", "Part")
    finally:
        spark.conf.set("spark.sql.legacy.javaCharsets", "false")
    assert got == [("L3", "测试"), ("L4", "é")]


def test_sniffed_separators(spark):
    d = tempfile.mkdtemp(prefix="lotline-sep-", dir="/tmp")
    for name, body in (("a.csv", "SourceLot;Part\nL1;x\n"), ("b.csv", "SourceLot|Part\nL2|y\n"),
                       ("c.csv", "SourceLot,Part\nL3,z\n")):
        with open(os.path.join(d, name), "w") as f:
            f.write(body)
    schema = T.StructType([T.StructField("SourceLot", T.StringType()), T.StructField("Part", T.StringType())])
    assert rows(files.read_delimited(spark, d, schema, sep=None), "SourceLot", "Part") == [
        ("L1", "x"), ("L2", "y"), ("L3", "z")]


def test_texts_are_put_together_in_tasks_that_follow_their_lines(spark, tmp_path, monkeypatch):
    orders = [(k, k % 30) for k in range(1000)] + [(5, 7), (5, 7), (None, 3), (None, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(programs, "TASK_LINES", 100)
    texts = programs.program_texts(spark, str(tmp_path), "lot_list")
    assert texts.rdd.getNumPartitions() == 21  # 1004 orders of two lines
    want = {}
    for r in programs.template_lines(spark, str(tmp_path), "lot_list").collect():
        want.setdefault(r.file, []).append((r.line_no is not None, r.line_no or 0, r.line is not None, r.line or "", r.line))
    want = {f: "\n".join(x[-1] for x in sorted(rs, key=lambda x: x[:-1]) if x[-1] is not None) for f, rs in want.items()}
    assert {r.file: r.text for r in texts.collect()} == want and len(want) == 6
