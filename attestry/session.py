"""Session defaults and table loading (step 0 of the build)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "benchmark", "embeddings", "conversations", "events", "labels", "pages")


def get_session(app: str = "attestry", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or reuse) a session with the settings every operator assumes.

    UTC session time zone, AQE with skew-join handling and partition coalescing.  A cluster keeps its own
    master, memory and shuffle settings: they are only set here when the caller passes them.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Text stages are CPU-bound: let small inputs keep enough partitions to use every core.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; column pruning and filters reach the parquet scan from here."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
