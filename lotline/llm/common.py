"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotline.session import shared_dir

#: Copies of the small side of a join whose other side may have a hot key.
SALTS = 16


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), as
    ``--py-files`` would, so that tasks can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    bundle = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(bundle, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(bundle))
    _shipped.add(sc.applicationId)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, or
    the warehouse where that is unset (an error where it is the driver's own disk)."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once to the shared folder and
    the lineage ends there, so a lost executor costs a re-read, not a re-run."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The same as :func:`cut`, as a compressed Parquet table."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], spread: Column,
                how: str = "inner") -> DataFrame:
    """Equi-join of ``many`` with ``few`` (at most one row per key) in which the
    rows of one key of ``many`` are dealt over SALTS tasks by ``spread``."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    # sizes are judged before the copies are made, so no broadcast of them
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


#: A key of 1/HEAVY or more of all rows is dealt over several tasks; at most HEAVY keys are.
HEAVY = 512
#: ... unless it has fewer rows than this.
FEW_ROWS = 20_000


def dealt_join(many: DataFrame, few: DataFrame, keys: list[str], spread: Column, weight: str,
               how: str = "inner") -> DataFrame:
    """Equi-join of ``many`` with ``few``, a table of one row per key (no null keys) whose column
    ``weight`` says how many rows of ``many`` have the key. Only heavy keys are dealt over
    tasks, by ``spread`` and over a number that follows their weight; the list of
    them, at most HEAVY rows, is broadcast. ``few`` is read three times (a written table)."""
    limit = max(FEW_ROWS, (few.agg(F.sum(weight)).first()[0] or 0) // HEAVY)
    shares = F.ceil(F.col(weight) / limit).cast("int")
    heavy = few.filter(F.col(weight) > limit).select(*keys, shares.alias("_of"))
    left = many.join(F.broadcast(heavy), keys, "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("_of")).cast("int"), F.lit(0))).drop("_of")
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col(weight) > limit, shares - 1).otherwise(0))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (src, dst: long): one row
    (node, component_id) per node, component_id the smallest node reachable.

    Alternates the large-star and the small-star step until the edges are stars
    around their smallest node; the number of rounds grows with the logarithm
    of the longest path. A node with very many edges is dealt over SALTS tasks.
    Self-loops and edges with a null end are left out.
    """
    e = cut(edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
            .filter("src is not null and dst is not null and src <> dst").distinct())
    state = _state(e)
    while state[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (salted_join(both, least, ["u"], F.col("v"))
                 .filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
                 .filter("hi <> lo").distinct())
        large = cut(large)
        small_min = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = salted_join(large, small_min, ["hi"], F.col("lo"))
        small = (joined.select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
                                                 F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))
                               .alias("x")).select("x.hi", "x.lo").filter("hi <> lo").distinct())
        e = cut(small)
        before, state = state, _state(e)
        if state == before:
            break
    members = e.select(F.col("hi").alias("node"), F.col("lo").alias("component_id"))
    roots = e.select(F.col("lo").alias("node"), F.col("lo").alias("component_id")).distinct()
    return members.unionByName(roots)


def _state(e: DataFrame) -> tuple[int, int]:
    """Row count and order-free checksum of an edge table."""
    r = e.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("hi", "lo"), F.lit(1 << 40))).alias("s")).first()
    return r["n"], r["s"] or 0


#: Bits of a bit field; its size does not depend on the data.
FIELD_BITS = 1 << 26


def bit_rows(df: DataFrame, place: Column) -> DataFrame:
    """Bit field of FIELD_BITS bits with the bits set whose number ``place`` gives, as
    rows (bucket, bits) of 4 KB, at most FIELD_BITS / 32768 of them."""
    at = place.bitwiseAND(F.lit(FIELD_BITS - 1)) + 1
    return (df.groupBy(F.bitmap_bucket_number(at).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")))


def bit_field(df: DataFrame, place: Column) -> np.ndarray:
    """The same in one array of bytes."""
    out = np.zeros(FIELD_BITS // 8, np.uint8)
    for r in bit_rows(df, place).toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["bucket"] - 1) * len(part):r["bucket"] * len(part)] = part
    return out


def _marked(df: DataFrame, few: DataFrame, key: str) -> tuple[DataFrame, Column]:
    """``df`` with the bits of its keys' bucket, and whether its key may be among those of ``few``."""
    at = F.xxhash64(key).bitwiseAND(F.lit(FIELD_BITS - 1)) + 1
    bits = bit_rows(few, F.xxhash64(key)).select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))
    out = df.withColumn("__at", at).join(F.broadcast(bits), F.bitmap_bucket_number("__at") == F.col("__bucket"), "left")
    held = F.expr("shiftright(cast(conv(hex(substring(__bits, cast((__at - 1) % 32768 div 8 + 1 as int), 1)), 16, 10) as int), "
                  "cast((__at - 1) % 8 as int)) & 1 = 1")
    return out, F.coalesce(held, F.lit(False))


def maybe_in(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among those of ``few``: all that are, and of the
    others only such as share a bit with one. The broadcast has FIELD_BITS bits at most."""
    out, held = _marked(df, few, key)
    return out.filter(held).select(*df.columns)


def without(df: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not among those of ``few``, exactly; only rows that share a
    bit with one of these are shuffled. ``df`` is read twice."""
    out, held = _marked(df, few, key)
    never = out.filter(~held).select(*df.columns)
    return never.unionByName(maybe_in(df, few, key).join(few.select(key), key, "left_anti").select(*df.columns))


def crc32_of(col: Column) -> Column:
    """Unsigned crc32 of a value written as text."""
    return F.crc32(col.cast("string").cast("binary"))
