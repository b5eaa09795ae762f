"""When an export file is complete (S11): a stateful stream over observations of a folder.

Every poll lists the folder's files (names, sizes, times; no content) and appends the
listing, with the requested names, to a folder of observations. A stream reads them, keyed
by file: an export is ready after ``checks`` polls in a row that find the size of the
poll before; a file older than the request is a left-over and does not count; at the
limit, or by a processing-time timer when no poll comes any more, it is late, stale (only
left-overs were seen) or absent. State is one row per requested file.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lotline.session import checkpoint_dir

OBSERVED = "name string, size long, modified timestamp, polled timestamp"
VERDICTS = "name string, verdict string, size long, polls long"
_STATE = "size long, equal int, fresh boolean, polls long, done boolean"


class ExportError(RuntimeError):
    pass


def observe(spark: SparkSession, folder: str, names: Sequence[str], into: str) -> None:
    """One poll: the wanted files that ``folder`` holds and, without a size, those that it lacks."""
    listed = spark.read.format("binaryFile").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    wanted.join(listed, "name", "left").withColumn("polled", F.current_timestamp()).coalesce(1).write.mode("append").parquet(into)


def verdicts(observed: DataFrame, requested: datetime, limit: timedelta, checks: int = 3, timers: bool = True) -> DataFrame:
    """One row per file as soon as it is decided: ready, or late, stale or absent at the limit.

    ``observed``: OBSERVED, a stream or a table. Observations of one file count in the order of
    ``polled`` within a micro-batch; those after its verdict are ignored. ``timers=False``: only
    a poll after the limit decides (a query with timers never runs out of batches, so a
    stream over what is there, ``availableNow``, goes without).
    """
    start, deadline = pd.Timestamp(requested), pd.Timestamp(requested + limit)

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        size, equal, fresh, polls, done = state.get if state.exists else (-1, 0, False, 0, False)
        found = None
        if state.hasTimedOut and not done:
            found = "late"
        else:
            for row in pd.concat(list(frames)).sort_values("polled").itertuples():
                if done or found:
                    break
                if row.polled >= deadline:
                    found = "late"
                    break
                polls += 1
                if pd.isna(row.size_) or row.modified < start:
                    size = size if fresh else (-1 if pd.isna(row.size_) and size == -1 else -2)
                    continue
                equal = equal + 1 if fresh and row.size_ == size else 0
                size, fresh = int(row.size_), True
                found = "ready" if equal >= checks else None
        if found == "late" and not fresh:
            found = "stale" if size == -2 else "absent"
        if found and not done:
            done = True
            yield pd.DataFrame({"name": [key[0]], "verdict": [found], "size": pd.array([size if found == "ready" else None], "Int64"), "polls": [polls]})
        state.update((size, equal, fresh, polls, done))
        if timers and not done:
            left = deadline.tz_localize(timezone.utc) - pd.Timestamp.now(timezone.utc) if deadline.tz is None else deadline - pd.Timestamp.now(timezone.utc)
            state.setTimeoutDuration(max(1, int(left.total_seconds() * 1000)))

    keyed = observed.withColumnRenamed("size", "size_").groupBy("name")
    return keyed.applyInPandasWithState(judge, VERDICTS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout)


def await_exports(spark: SparkSession, folder: str, names: Sequence[str], requested: datetime, limit: timedelta,
                  checks: int = 3, interval: float = 1.0) -> list[str]:
    """Waits until every requested file of ``folder`` is ready and returns their names; ExportError
    names the files that are late, stale or absent at the limit. The folder must exist;
    ``names`` is a request, so its size is bounded by what was asked for."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/exports-{uuid.uuid4().hex}"
    observe(spark, folder, names, f"{root}/observed")
    observed = spark.readStream.schema(OBSERVED).parquet(f"{root}/observed")
    query = (verdicts(observed, requested, limit, checks).writeStream.format("parquet").option("path", f"{root}/verdicts")
             .option("checkpointLocation", f"{root}/state").outputMode("append").trigger(processingTime=f"{interval} seconds").start())
    try:
        last = requested.replace(tzinfo=timezone.utc) + limit + timedelta(seconds=30 + 10 * interval)
        while True:
            found = {r.name: r.verdict for r in spark.read.schema(VERDICTS).parquet(f"{root}/verdicts").collect()} if _started(spark, f"{root}/verdicts") else {}
            if len(found) == len(set(names)) or datetime.now(timezone.utc) > last or query.exception():
                break
            time.sleep(interval)
            observe(spark, folder, names, f"{root}/observed")
    finally:
        query.stop()
    bad = {n: found.get(n, "undecided") for n in names if found.get(n) != "ready"}
    if bad:
        raise ExportError(f"exports not ready in {folder}: " + ", ".join(f"{n} {v}" for n, v in sorted(bad.items())))
    return sorted(names)


def _started(spark: SparkSession, path: str) -> bool:
    """Whether the stream has committed anything to ``path``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_spark_metadata")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0
