"""Sinks (K1-K5): partitioned, append-only outputs; bundles and snapshots by manifest.

Every writer takes a DataFrame and a target folder on a shared file system
(HDFS, object store); a run is one partition (``run_ts=...``), so a failed
run leaves the earlier runs untouched and a re-run never overwrites them.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from lotline.sinks.versions import NoVersionError, parts, publish, read_part

__all__ = ["last_two_snapshots", "read_part", "run_stamp", "snapshot_dates", "write_bundle", "write_multi_table", "write_snapshot", "write_status", "write_table"]


def run_stamp(now: datetime | None = None) -> str:
    return (now or datetime.now(timezone.utc)).strftime("%Y%m%d_%H%M%S")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", run_ts: str | None = None,
                mode: str = "errorifexists", bom: bool = False) -> str:
    """K1: one run of a result under ``path/run_ts=<stamp>`` (csv with a
    header, or parquet). ``bom=True`` starts every CSV part file with the
    UTF-8 byte-order mark (put before the first header name), as some
    spreadsheet tools expect. Returns the folder written."""
    target = f"{path.rstrip('/')}/run_ts={run_ts or run_stamp()}"
    if fmt == "csv" and bom and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(target)
    else:
        w.format(fmt).save(target)
    return target


def write_multi_table(df: DataFrame, table_col: str, path: str, fmt: str = "parquet",
                      mode: str = "errorifexists") -> None:
    """K2: one result routed to many tables in one pass: ``table_col`` names
    the table of each row and becomes the partition folder. A table with no
    rows gets no folder."""
    df.write.mode(mode).partitionBy(table_col).format(fmt).save(path)


def write_bundle(tables: Mapping[str, DataFrame], path: str) -> int:
    """K3: a report bundle (Pareto tables, details, exceptions) as the next version of ``path``: its
    tables appear together or not at all. Returns the version's number; read with ``read_part``."""
    return publish(path, tables)


def write_snapshot(df: DataFrame, path: str, snapshot_dt: str) -> None:
    """K4: a catalogue snapshot as the part ``snapshot_dt`` of ``path`` (replaces the old/backup file
    rotation; nothing is renamed or deleted). A re-run of a date swaps that part when it
    is written, and touches no other; until then, and if it fails, readers see the old one."""
    publish(path, {snapshot_dt: df}, keep=True)


def snapshot_dates(spark: SparkSession, path: str) -> list[str]:
    """Dates of a snapshot table, from its manifest (no data is read)."""
    try:
        return sorted(parts(spark, path))
    except NoVersionError:
        return []


def last_two_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(previous, latest) snapshots, both of one version; no other is read."""
    found = parts(spark, path) if snapshot_dates(spark, path) else {}
    if len(found) < 2:
        raise ValueError(f"need two snapshots under {path}, found {sorted(found)}")
    return tuple(spark.read.parquet(f"{path.rstrip('/')}/{found[d]}") for d in sorted(found)[-2:])


def write_status(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """K5: the ok and rejected rows of one job side by side (partition by
    ``status``), so rejects are kept next to the results."""
    df.write.mode(mode).partitionBy("status").parquet(path)
