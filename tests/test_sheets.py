"""Sheets with headers of their own, quoted line breaks and rows that do not fit."""

from __future__ import annotations

import csv
import io
import random

import pytest
from pyspark.sql import types as T

from lotline.plans import files as plans_files
from lotline.sources import sheets
from tests.conftest import rows

SCHEMA = T.StructType([T.StructField("lot", T.StringType()), T.StructField("qty", T.IntegerType()), T.StructField("part", T.StringType())])
ALIASES = {"lot": ["LOT", "SOURCE LOT"], "qty": ["QTY", "QUANTITY"], "part": ["PART"]}


def land(folder, **files):
    for name, body in files.items():
        (folder / f"{name}.csv").write_bytes(body if isinstance(body, bytes) else body.encode())
    return f"{folder}/*.csv"


@pytest.fixture
def tiny_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "16b", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_each_file_is_mapped_by_its_own_header(spark, tmp_path):
    path = land(tmp_path, a="﻿Lot,Qty,Part\nL1,1,x\n", b="part;SOURCE LOT;note;quantity\né;K1;n;7\n".encode("latin-1"),
                c='QUANTITY|Lot|"LOT"|Part\n3|first|second|y\n', d="Lot\tPart\tQty\n", e="")
    got = rows(sheets.read_sheets(spark, path, SCHEMA, ALIASES), "lot", "qty", "part", "status")
    assert got == [("K1", 7, "é", "ok"), ("L1", 1, "x", "ok"), ("first", 3, "y", "ok")]


def test_a_file_without_a_required_column_fails_by_name(spark, tmp_path):
    path = land(tmp_path, good="Lot,Qty,Part\nL1,1,x\n", bad="Lot,Part\nL1,x\n")
    df = sheets.read_sheets(spark, path, SCHEMA, ALIASES)
    for action in (lambda: df.count(), lambda: df.select("lot").collect(), lambda: df.join(spark.range(1)).collect()):
        with pytest.raises(Exception, match=r"missing columns \[qty\] in .*bad.csv"):
            action()
    optional = sheets.read_sheets(spark, path, SCHEMA, ALIASES, required=["lot"])
    assert rows(optional, "lot", "qty", "part") == [("L1", 1, "x"), ("L1", None, "x")]


BAD = 'Lot,Qty,Part\nL1,1,"a\nb ""q"", c"\nL2,,x\n\nL3,2\nL4,3,y,z\nL5,q,y\n"L6"b,1,c\n,,\nL7,5,"a"\nL9,1,"open\n'


def test_rows_that_do_not_fit_come_with_place_and_reason(spark, tmp_path):
    df = sheets.read_sheets(spark, land(tmp_path, a=BAD), SCHEMA, ALIASES)
    got = rows(df.filter("status = 'rejected'"), "line", "reason", "record")
    assert sorted(got) == [(5, "short row", "L3,2"), (6, "long row", "L4,3,y,z"), (7, "bad qty", "L5,q,y"),
                           (8, "misplaced quote", '"L6"b,1,c'), (11, "unclosed quote", 'L9,1,"open')]
    assert sorted(rows(df.filter("status = 'ok'"), "line", "lot", "qty", "part")) == [
        (1, "L1", 1, 'a\nb "q", c'), (3, "L2", None, "x"), (9, None, None, None), (10, "L7", 5, "a")]
    with pytest.raises(Exception, match="rejected row in .*a.csv line 5 short row"):
        sheets.good_rows(sheets.read_sheets(spark, land(tmp_path, a="Lot,Qty,Part\nL1,1,x\n\n\n\nL3,2\n"), SCHEMA, ALIASES)).count()


def test_records_across_splits_equal_one_reader(spark, tmp_path, tiny_splits, monkeypatch):
    """Quoted breaks wherever the splits cut, against a reader that takes the file whole."""
    monkeypatch.setattr(sheets, "CHUNK", 3)
    rng = random.Random(4)
    cells = [["lot", "qty", "part"]] + [[rng.choice(["L1", 'a"b', "x,y", "one\ntwo", "\n\n", "é,\n\"q\""]), str(rng.randrange(9)), rng.choice(["p", "a\nb", ""])]
                                        for _ in range(60)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(cells)
    df = sheets.read_sheets(spark, land(tmp_path, a=out.getvalue()), SCHEMA, ALIASES)
    assert df.rdd.getNumPartitions() >= 1 and len(out.getvalue()) > 16 * 20
    expected = [(a or None, int(b), c or None) for a, b, c in list(csv.reader(io.StringIO(out.getvalue())))[1:]]
    assert rows(df, "lot", "qty", "part") == sorted(expected, key=lambda t: tuple(str(x) for x in t))
    assert {r.status for r in df.collect()} == {"ok"}


def test_rejects_and_good_rows_go_out_in_one_pass(spark, tmp_path):
    from lotline.sinks.writers import write_status

    (tmp_path / "in").mkdir()
    write_status(sheets.read_sheets(spark, land(tmp_path / "in", a=BAD), SCHEMA, ALIASES), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("status=*")) == ["status=ok", "status=rejected"]
    back = spark.read.parquet(str(tmp_path / "out" / "status=rejected"))
    assert back.count() == 5 and back.filter("read_at is null or source_file is null").count() == 0


def test_reader_by_extension(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"lot": "L1", "qty": 1}\n{"lot": "L2"}\n')
    (tmp_path / "b.json").write_text('[{"lot": "L3",\n "qty": 1}]')
    (tmp_path / "c.tsv").write_text("qty\tlot\tpart\n1\tL4\t\n")
    assert [r.lot for r in sheets.read_any(spark, str(tmp_path / "a.jsonl"), SCHEMA).orderBy("lot").collect()] == ["L1", "L2"]
    assert rows(sheets.read_any(spark, str(tmp_path / "b.json"), SCHEMA), "lot", "qty") == [("L3", 1)]
    assert rows(sheets.read_any(spark, str(tmp_path / "c.tsv"), SCHEMA), "lot", "qty", "part") == [("L4", 1, None)]
    with pytest.raises(ValueError, match="unsupported"):
        sheets.read_any(spark, "x.xlsx")


def test_files_are_opened_once(spark, tmp_path):
    body = ["Lot,Qty,Part", "L1,1,\"a", "b\"", "L2,2,c"]
    df = sheets.read_sheets(spark, land(tmp_path, a="\n".join(body).encode(), b="Lot;Qty;Part\né;3;d\n".encode("latin-1")), SCHEMA, ALIASES)
    assert rows(df, "lot", "qty", "part", "line", "status") == [("L1", 1, "a\nb", 1, "ok"), ("L2", 2, "c", 3, "ok"), ("é", 3, "d", 1, "ok")]
    assert "FileScan text" not in df._jdf.queryExecution().executedPlan().toString()


def test_sheets_land_in_tasks_that_follow_their_number(spark, tmp_path, monkeypatch):
    customers = [(i, i % 25, "SEG", 1.0) for i in range(2000)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double").write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(plans_files, "TASK_REQUESTS", 100)
    root = plans_files.land(spark, str(tmp_path), plans_files.PLAIN)
    names = spark.read.text(root).select("_metadata.file_name", "sheet").distinct().collect()
    assert len({r.sheet for r in names}) == 40 == len(names)
    assert len({r.file_name.split("-")[1] for r in names}) > 8  # one writing task each
