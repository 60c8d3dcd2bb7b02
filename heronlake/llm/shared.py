"""Shared-folder staging: cuts lineage in files every executor can read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where the setting is absent in a local session (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write once to the shared folder as Parquet and read back; the files replace the lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def stage_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``stage`` with the rows of one key in one bucket: grouping by ``key`` reads the files without moving them again."""
    spark = df.sparkSession
    path, table = fresh_path(spark, name), f"staged_{uuid.uuid4().hex}"
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    out = spark.table(table)
    out.staged_at = path
    return out


def unstage(*tables: DataFrame | None) -> None:
    """Delete the files of staged tables that nothing lazy reads any more."""
    for t in tables:
        if t is not None and "staged_at" in vars(t):
            remove(t.sparkSession, t.staged_at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through Hadoop's file system, wherever it lives."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release() -> None:
    """Give memory that a task no longer needs back to the system, so that a worker kept for later stages stays small."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no such call in this C library
        pass


#: 32-bit words of a bitmap that a task packs at once, as a power of two: 128 KB.
BITMAP_BLOCK = 15


def bitmap(slots: DataFrame, bits: int) -> bytes:
    """The bitmap of ``bits`` (a power of two of at least 32) bits whose places stand in the column ``slot``.

    Spark ORs the bits and packs them in tasks, so the driver gets a row for each 128 KB, however many places there are.
    """
    import zlib

    import numpy as np
    import pandas as pd

    words = slots.select(F.shiftright("slot", 5).cast("int").alias("at"), F.expr("shiftleft(1L, cast(slot & 31 AS int))").alias("bit"))
    words = words.groupBy("at").agg(F.bit_or("bit").alias("word")).withColumn("block", F.shiftright("at", BITMAP_BLOCK))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << BITMAP_BLOCK, "<u4")
        own[pdf["at"].to_numpy() & (len(own) - 1)] = pdf["word"].to_numpy().astype("<u4")
        return pd.DataFrame({"block": [key[0]], "packed": [zlib.compress(own.tobytes(), 1)]})

    out = np.zeros(bits // 32, "<u4")
    for row in words.groupBy("block").applyInPandas(pack, "block int, packed binary").collect():
        own = np.frombuffer(zlib.decompress(row["packed"]), "<u4")[: len(out)]
        out[row["block"] << BITMAP_BLOCK :][: len(own)] = own
    return out.tobytes()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underlines added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str, nulls_first: bool) -> DataFrame:
    """``docs`` with a long column ``name`` that tells rows apart and rises with doc_id.

    It is the doc_id where each row has one of its own. Else the rows are sorted by doc_id, null ids first or last,
    numbered and written, so that every later read sees the same numbers.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    rows, own = ids.agg(F.count("*"), F.countDistinct("id")).first()
    if rows == own:
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    order = F.col("doc_id").cast("long")
    ordered = docs.orderBy(order.asc_nulls_first() if nulls_first else order.asc_nulls_last())
    return stage(ordered.withColumn(name, F.monotonically_increasing_id()), "numbered")


#: Keys that join_skewed sends to every task, at most.
HOT_KEYS = 1_000


def join_skewed(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each key and, as ``count``, the number of ``rows`` of that key.

    Keys with more than a thousandth of all rows, of which there are at most a thousand, are broadcast, so that the rows
    of a hot key stay where they are; the others are joined by a shuffle. Both inputs are read twice.
    """
    least = (table.agg(F.sum(count)).first()[0] or 0) / HOT_KEYS
    hot, other = table.where(F.col(count) > least), table.where(F.col(count) <= least)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(other, key))


def ascii_lower(col):
    """Lower-case A-Z only. Pure-ASCII text takes the built-in lower, which is the same there and faster."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.char_length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, letters, letters.lower()))


def running_start(df: DataFrame, order: list[str], amount: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all rows before this one in ``order``.

    Rows are range-partitioned by ``order``; only one total per partition meets in a single task.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranged = stage(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("_part").agg(F.sum(amount).alias("_total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    # one row per shuffle partition: bounded by that setting, not by the data
    return (
        ranged.join(F.broadcast(bases), "_part")
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(amount).over(within), F.lit(0)))
        .drop("_part", "_base")
    )
