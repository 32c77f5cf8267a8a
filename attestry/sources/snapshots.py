"""Replace-by-key snapshots, manifests and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert_by_doc(target: DataFrame, incoming: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """S4. Replace every row of an incoming key: (merged table, deleted rows per key)."""
    ids = incoming.select(key).distinct()
    merged = target.join(ids, key, "left_anti").unionByName(incoming)
    deleted = target.join(ids, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("deleted"))
    return merged, deleted


def delete_docs(target: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """S5. Rows kept, and the number deleted per key."""
    ids = ids.select(key).distinct()
    deleted = target.join(ids, key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("deleted"))
    return target.join(ids, key, "left_anti"), deleted


def write_snapshot(df: DataFrame, root: str, version: str) -> str:
    """S4. Write a complete new version beside the old ones; readers switch when its success marker exists."""
    path = f"{root}/snapshot={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_snapshot(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root}/snapshot={version}")


def make_manifest(df: DataFrame, key: str, content: str) -> DataFrame:
    """S13. Checksum and size per unit."""
    return df.select(F.col(key).alias("unit"), F.md5(content).alias("checksum"), F.length(content).cast("bigint").alias("size"))


def diff_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """S13. One row per issue: missing, unexpected, checksum_mismatch, size_mismatch."""
    a = old.select("unit", F.col("checksum").alias("c0"), F.col("size").alias("s0"))
    b = new.select("unit", F.col("checksum").alias("c1"), F.col("size").alias("s1"))
    issues = F.array_compact(F.array(
        F.when(F.col("c1").isNull(), "missing"), F.when(F.col("c0").isNull(), "unexpected"),
        F.when(F.col("c0") != F.col("c1"), "checksum_mismatch"), F.when(F.col("s0") != F.col("s1"), "size_mismatch")))
    return a.join(b, "unit", "full_outer").select("unit", F.explode(issues).alias("issue"))


def expire_snapshots(listing: DataFrame, keep: int = 5, by: str = "store") -> DataFrame:
    """S14. Snapshots beyond the newest ``keep`` of each store.

    The keepers are a group-limited ranking (at most ``keep`` rows per store and task are shuffled); everything
    else is an anti join against that small table."""
    w = Window.partitionBy(by).orderBy(F.col("modified").desc(), F.col("name").desc())
    keepers = listing.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).select(by, "name")
    return listing.join(keepers, [by, "name"], "left_anti")


def retained_snapshots(listing: DataFrame, keep: int = 5, by: str = "store") -> DataFrame:
    """S14. The newest ``keep`` of each store, the newest flagged."""
    w = Window.partitionBy(by).orderBy(F.col("modified").desc(), F.col("name").desc())
    ranked = listing.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep)
    return ranked.withColumn("latest", F.col("_rn") == 1).drop("_rn")
