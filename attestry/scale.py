"""Helpers that keep plans safe at cluster scale: lineage cuts and shared intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local master, as in tests, gets a folder of its own; a cluster is an error, since its
    executors could not read each other's files."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables and stream state."""
    _checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the result as a table in the checkpoint folder and read it back.

    It survives executor loss and is not recomputed.  A columnar table is used rather than ``checkpoint()``,
    whose row-serialised blocks have to be read whole: later scans of the table prune columns and push filters.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    with _shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs run within delete their shuffle files at their end.

    Otherwise these stay until the driver happens to collect its garbage, so that the steps of a query add up on disk.
    A job that has written its result is never run again, so nothing reads them later."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition into the configured number of shuffle partitions before a CPU-bound stage.

    The explicit number keeps AQE from merging small but expensive partitions."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def salted_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, most: int = 20_000) -> DataFrame:
    """Inner join on ``key`` in which a key with more than ``most`` right rows is dealt to as many tasks as it needs.

    The right rows of such a key are split by a hash of ``spread_by``, its left rows repeated for each part; a key
    within the limit has one part and is not repeated."""
    parts = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(
        key, F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    n = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = right.join(parts, key, "left").withColumn("_part", F.pmod(F.hash(spread_by), n)).drop("_parts")
    repeated = left.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), n - 1))).drop("_parts")
    return repeated.join(dealt, [key, "_part"]).drop("_part")


_SHARED: dict[tuple, object] = {}


def shared(spark: SparkSession, key: tuple, build, cut: bool = True):
    """Materialise an intermediate once per application and reuse it (hits, answer pairs, term index).

    ``cut`` off takes what ``build`` returns as it is: something that has been stored already."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _SHARED:
        _SHARED[full] = cut_lineage(build()) if cut else build()
    return _SHARED[full]
