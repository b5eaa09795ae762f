"""Tables that appear all at once (K3, K4): staged folders and a manifest that readers follow.

The parts of a version are written to fresh folders; only when all are there does the next
manifest appear, by a rename that fails if another writer was first. A reader takes the
manifest with the highest number, so a job that fails between parts leaves the version
before it readable, and a re-run swaps the pointer instead of deleting anything.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

MANIFESTS = "_manifests"


class NoVersionError(FileNotFoundError):
    pass


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _latest(spark: SparkSession, path: str) -> int:
    """Number of the newest manifest, 0 where there is none (names only, nothing is read)."""
    fs, p, _ = _fs(spark, f"{path.rstrip('/')}/{MANIFESTS}")
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max([int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()], default=0)


def parts(spark: SparkSession, path: str) -> dict[str, str]:
    """Part name -> folder (under ``path``) of the current version; NoVersionError where there is none."""
    number = _latest(spark, path)
    if not number:
        raise NoVersionError(f"no version under {path}")
    fs, p, jvm = _fs(spark, f"{path.rstrip('/')}/{MANIFESTS}/{number:010d}.json")
    stream = fs.open(p)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A part of the current version."""
    return spark.read.parquet(f"{path.rstrip('/')}/{parts(spark, path)[part]}")


def publish(path: str, tables: Mapping[str, DataFrame], keep: bool = False, partition_by: Mapping[str, list[str]] | None = None) -> int:
    """Writes ``tables`` and makes them the current version of ``path``; ``keep``: beside the parts
    of the version before (those of the same name are replaced). Returns its number. Where
    another writer publishes meanwhile, kept parts are taken from that writer's version."""
    spark = next(iter(tables.values())).sparkSession
    base, staged = path.rstrip("/"), f"versions/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{base}/{staged}/{name}")
    mine = {name: f"{staged}/{name}" for name in tables}
    while True:
        number = _latest(spark, base)
        before = parts(spark, base) if keep and number else {}
        if _claim(spark, base, number + 1, json.dumps(before | mine, sort_keys=True)):
            return number + 1


def _claim(spark: SparkSession, base: str, number: int, content: str) -> bool:
    """The manifest under its number, whole or not at all; False where the number is taken."""
    fs, tmp, jvm = _fs(spark, f"{base}/{MANIFESTS}/.{uuid.uuid4().hex}")
    out = fs.create(tmp)
    out.write(bytearray(content.encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(f"{base}/{MANIFESTS}/{number:010d}.json")
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(tmp), fs.makeQualified(target), none)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        fs.delete(tmp, False)
        return False
