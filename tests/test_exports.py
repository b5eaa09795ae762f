"""When an export is complete: growing, stale, absent and good files."""

from __future__ import annotations

import os
import threading
import time
from datetime import datetime, timedelta, timezone

import pytest

from lotline.streaming import exports
from tests.conftest import rows

START = datetime(2025, 1, 1, 12)


def at(minutes):
    return START + timedelta(minutes=minutes)


def test_rule_on_observations(spark, tmp_path):
    """The stream over a table of polls, in one micro-batch."""
    seen = {"good": [5, 5, 5, 5], "growing": [1, 2, 3, 4, 5, 6, 7, 8], "back": [5, 5, 6, 6, 6, 6], "absent": [None] * 4, "gap": [5, None, 5, 5, None, 5]}
    polls = [(n, s, at(0) if s else None, at(i)) for n, sizes in seen.items() for i, s in enumerate(sizes)]
    polls += [("stale", 5, at(-60), at(i)) for i in range(5)] + [("renewed", 5, at(-60 if i < 3 else 1), at(i)) for i in range(8)]
    polls += [(n, 99, at(0), at(30)) for n in (*seen, "stale", "renewed")] + [("open", 5, at(0), at(1))]
    spark.createDataFrame(polls, exports.OBSERVED).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = exports.verdicts(spark.readStream.schema(exports.OBSERVED).parquet(f"{tmp_path}/in"), START, timedelta(minutes=20), 3, timers=False)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = {r.name: (r.verdict, r.size) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"good": ("ready", 5), "growing": ("late", None), "back": ("ready", 6), "absent": ("absent", None), "gap": ("ready", 5),
                   "stale": ("stale", None), "renewed": ("ready", 5)}


def test_waits_for_a_file_that_grows(spark, tmp_path):
    folder = tmp_path / "exports"
    folder.mkdir()
    (folder / "done.csv").write_text("a\n")
    begun = datetime.now(timezone.utc).replace(tzinfo=None) - timedelta(seconds=5)

    def grow():
        for i in range(4):
            with open(folder / "late.csv", "a") as f:
                f.write(f"{i}\n")
            time.sleep(0.7)

    writer = threading.Thread(target=grow)
    writer.start()
    names = exports.await_exports(spark, str(folder), ["done.csv", "late.csv"], begun, timedelta(seconds=90), checks=2, interval=0.5)
    assert names == ["done.csv", "late.csv"] and not writer.is_alive()
    writer.join()


def test_fails_by_name_at_the_limit(spark, tmp_path):
    folder = tmp_path / "exports"
    folder.mkdir()
    for name in ("good.csv", "old.csv"):
        (folder / name).write_text("a\n")
    os.utime(folder / "old.csv", (1, 1))
    begun = datetime.now(timezone.utc).replace(tzinfo=None) - timedelta(seconds=5)
    with pytest.raises(exports.ExportError, match="none.csv absent, old.csv stale"):
        exports.await_exports(spark, str(folder), ["good.csv", "old.csv", "none.csv"], begun, timedelta(seconds=20), checks=2, interval=0.5)
    assert rows(spark.range(1)) == [(0,)]
