"""Lineage cuts and housekeeping of the multi-step operators."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from attestry.scale import cut_lineage


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared checkpoint folder, read it back, and let Spark drop finished shuffle files.

    A lost executor then costs a re-read of the table, not a rerun of the steps before it.
    """
    out = cut_lineage(df)
    release(df.sparkSession)
    return out


def small_batches(spark: SparkSession, most: str = "8m") -> None:
    """Send texts to Python tasks a few MB at a time: a worker's memory then does not depend on how long texts are.

    A size that the session sets itself, other than the default, is left alone.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64m").lower() in ("67108864b", "67108864", "64m", "64mb"):
        spark.conf.set(name, most)


def release(spark: SparkSession) -> None:
    """Collect garbage on the driver, so that Spark's cleaner removes the shuffle files of plans no longer used."""
    gc.collect()
    try:
        spark._jvm.System.gc()
    except (AttributeError, TypeError):  # a remote session has no JVM at hand
        return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing later reads: whatever was made of them has been settled itself."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("table-"):
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
