from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import types as T

from lotline.operators import diff
from lotline.sinks import writers
from lotline.streaming import ingest
from tests.conftest import rows


def test_multi_table_and_snapshots(spark):
    d = tempfile.mkdtemp(prefix="lotline-sink-", dir="/tmp")
    df = spark.createDataFrame([("HOT", 1), ("COLD", 2), ("HOT", 3)], "table string, v int")
    writers.write_multi_table(df, "table", f"{d}/multi")
    assert sorted(p for p in os.listdir(f"{d}/multi") if p.startswith("table=")) == ["table=COLD", "table=HOT"]
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    b = spark.createDataFrame([("y",), ("z",)], "k string")
    writers.write_snapshot(a, f"{d}/snap", "20250101")
    writers.write_snapshot(b, f"{d}/snap", "20250108")
    writers.write_snapshot(b, f"{d}/snap", "20250108")          # a re-run replaces its partition only
    assert writers.snapshot_dates(spark, f"{d}/snap") == ["20250101", "20250108"]
    old, new = writers.last_two_snapshots(spark, f"{d}/snap")
    assert rows(diff.change_log(new, old, ["k"])) == [("Added", "z"), ("Removed", "x")]
    target = writers.write_table(df, f"{d}/runs", fmt="csv", run_ts="20250101_000000")
    assert os.path.isdir(target)


def test_stream_reads_each_file_once(spark):
    d = tempfile.mkdtemp(prefix="lotline-stream-", dir="/tmp")
    src, out, ck = f"{d}/in", f"{d}/out", f"{d}/ckpt"
    os.makedirs(src)
    schema = T.StructType([T.StructField("lot", T.StringType()), T.StructField("n", T.IntegerType())])

    def land(name, body):
        tmp = f"{d}/{name}.tmp"
        with open(tmp, "w") as f:
            f.write(body)
        shutil.move(tmp, f"{src}/{name}")      # atomic rename into the watched folder

    land("a.csv", "lot,n\nL1,1\nL2,2\n")
    ingest.ingest_extracts(spark, src, schema, out, checkpoint=ck).awaitTermination()
    land("b.csv", "lot,n\nL3,3\n")
    ingest.ingest_extracts(spark, src, schema, out, checkpoint=ck).awaitTermination()
    got = rows(spark.read.parquet(out), "lot", "n", "source_file")
    assert got == [("L1", 1, "a.csv"), ("L2", 2, "a.csv"), ("L3", 3, "b.csv")]


def test_bundle_and_status(spark):
    d = tempfile.mkdtemp(prefix="lotline-bundle-", dir="/tmp")
    a = spark.createDataFrame([(1,)], "v int")
    b = spark.createDataFrame([("x", "ok"), ("y", "rejected")], "k string, status string")
    writers.write_bundle({"pareto": a, "details": b}, f"{d}/report")
    assert rows(writers.read_part(spark, f"{d}/report", "pareto")) == [(1,)]
    writers.write_status(b, f"{d}/status")
    assert sorted(p for p in os.listdir(f"{d}/status") if p.startswith("status=")) == ["status=ok", "status=rejected"]


def test_foreach_batch_handler_sees_each_file_once(spark):
    d = tempfile.mkdtemp(prefix="lotline-fb-", dir="/tmp")
    src = f"{d}/in"
    os.makedirs(src)
    schema = T.StructType([T.StructField("lot", T.StringType()), T.StructField("n", T.IntegerType())])
    for name, body in (("a.csv", "lot,n\nL1,1\n"), ("b.csv", "lot,n\nL2,2\nL3,3\n")):
        with open(f"{d}/{name}.tmp", "w") as f:
            f.write(body)
        shutil.move(f"{d}/{name}.tmp", f"{src}/{name}")
    out = f"{d}/batches"

    def handle(batch, batch_id):
        # idempotent per batch id: one folder per batch, overwritten on a retry
        batch.groupBy("source_file").count().write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    ingest.ingest_with(spark, src, schema, handle, checkpoint=f"{d}/ckpt").awaitTermination()
    ingest.ingest_with(spark, src, schema, handle, checkpoint=f"{d}/ckpt").awaitTermination()  # nothing new
    got = rows(spark.read.parquet(out).groupBy("source_file").sum("count"))
    assert got == [("a.csv", 1), ("b.csv", 2)]


def test_csv_with_bom(spark):
    import glob
    d = tempfile.mkdtemp(prefix="lotline-bom-", dir="/tmp")
    df = spark.createDataFrame([("L1", 1)], "lot string, n int")
    target = writers.write_table(df, d, fmt="csv", run_ts="r1", bom=True)
    part = sorted(glob.glob(f"{target}/part-*.csv"))[0]
    assert open(part, "rb").read(3) == b"\xef\xbb\xbf"
    back = spark.read.option("header", True).csv(target)
    assert back.columns == ["lot", "n"] and rows(back) == [("L1", "1")]


def test_a_version_appears_whole_or_not_at_all(spark):
    import pytest
    from pyspark.sql import functions as F

    from lotline.sinks import versions

    d = tempfile.mkdtemp(prefix="lotline-version-", dir="/tmp")
    with pytest.raises(versions.NoVersionError):
        versions.parts(spark, d)
    old = spark.createDataFrame([("old",)], "v string")
    assert writers.write_bundle({"pareto": old, "details": old}, d) == 1
    bad = old.select(F.raise_error(F.lit("lost")).cast("string").alias("v"))
    with pytest.raises(Exception, match="lost"):
        writers.write_bundle({"pareto": old.select(F.lit("new").alias("v")), "details": bad}, d)
    assert [rows(writers.read_part(spark, d, p)) for p in ("pareto", "details")] == [[("old",)], [("old",)]]
    writers.write_bundle({"pareto": old.select(F.lit("new").alias("v"))}, d)
    assert rows(writers.read_part(spark, d, "pareto")) == [("new",)] and set(versions.parts(spark, d)) == {"pareto"}


def test_failed_rerun_keeps_the_snapshot_and_writers_do_not_lose_each_other(spark):
    import pytest
    from pyspark.sql import functions as F

    from lotline.sinks import versions

    d = tempfile.mkdtemp(prefix="lotline-rerun-", dir="/tmp")
    a = spark.createDataFrame([("x",)], "k string")
    writers.write_snapshot(a, d, "20250101")
    with pytest.raises(Exception, match="lost"):
        writers.write_snapshot(a.select(F.raise_error(F.lit("lost")).cast("string").alias("k")), d, "20250101")
    assert rows(spark.read.parquet(f"{d}/{versions.parts(spark, d)['20250101']}")) == [("x",)]
    # the number is taken: the claim fails, the second writer starts from the first's version
    assert not versions._claim(spark, d, 1, "{}")
    writers.write_snapshot(a, d, "20250108")
    assert writers.snapshot_dates(spark, d) == ["20250101", "20250108"]


def test_newest_export_by_listing(spark):
    import pytest

    from lotline.sources.files import newest_by_name

    d = tempfile.mkdtemp(prefix="lotline-newest-", dir="/tmp")
    for i in range(10_000):
        open(f"{d}/MIR_Results_2024{i:04d}_000000.csv", "w").close()
    for name in ("MIR_Results_20250301_000000.csv", "MIR_Results_with_VPO_20260101_000000.csv", "MIR_Results_20250301_000000.csv.tmp"):
        open(f"{d}/{name}", "w").close()
    assert newest_by_name(spark, f"{d}/*", r"MIR_Results_(\d{8}_\d{6})\.csv").endswith("/MIR_Results_20250301_000000.csv")
    with pytest.raises(FileNotFoundError, match="no export"):
        newest_by_name(spark, f"{d}/*", r"none_(\d+)")
