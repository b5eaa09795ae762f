"""Spark session helpers.

Cluster settings (executor sizes, ``spark.checkpoint.dir``) come from the
cluster; these helpers only fill in what is missing so that tests and the
local bench run the same code.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes
# (a shuffle side that turns out small becomes a broadcast), coalesces
# small shuffle partitions and splits skewed ones.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    # remove checkpoint files of intermediates once they are garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "lotline", driver_memory: str | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and bench
    (in local mode the driver's memory is the whole engine's)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _DEFAULTS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the cluster's ``spark.checkpoint.dir``
    or, where that is unset, a folder of the warehouse, which every session has
    and a cluster keeps on shared storage. A cluster whose warehouse is the driver's own
    disk must set it."""
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        return current.rstrip("/")
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    own_disk = base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local")
    if own_disk:
        raise RuntimeError(f"set spark.checkpoint.dir: the warehouse {base} is the driver's own disk, which executors do not share")
    return base + "/.scratch"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``checkpoint()`` usable: sets the checkpoint folder only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    return shared_dir(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for landed files and stream state."""
    return shared_dir(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to a fresh Parquet table of the shared folder, for steps
    that read them several times."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
