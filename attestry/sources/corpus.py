"""Listings, intake and build reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import params as P


def scan_corpus(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """S1. Recursive listing with content available lazily: (path, modified, size, content)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return raw.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))


def corpus_inventory(files: DataFrame) -> DataFrame:
    """S2. (name, path, size, type) with the type in upper case."""
    return files.select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "path", "size", F.upper(suffix_of(F.col("path"))).alias("type"), "modified")


def inventory_totals(files: DataFrame) -> DataFrame:
    """S2. File count and total megabytes, two decimals."""
    return files.agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("size") / F.lit(1024.0 * 1024.0), 2).alias("total_mb"))


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """S12. Names, one per line; blanks and ``#`` comments dropped."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(line.alias("name")).distinct()


def intake_gate(files: DataFrame, max_bytes: int = P.MAX_FILE_BYTES, suffixes: Sequence[str] = P.FILE_SUFFIXES) -> DataFrame:
    """S16. Reason code per file: ok, missing, too_large, bad_type."""
    return files.withColumn("reason", F.when(F.col("size").isNull(), "missing").when(F.col("size") > max_bytes, "too_large")
                            .when(~suffix_of(F.col("path")).isin(*suffixes), "bad_type").otherwise("ok"))


def build_status(results: DataFrame) -> DataFrame:
    """S15. Status per file from (doc_id, error, unchanged, content_chars, chunks)."""
    return results.withColumn("status", F.when(F.col("error").isNotNull(), "error").when(F.col("unchanged"), "skipped")
                              .when(F.col("content_chars") == 0, "no_content").when(F.col("chunks") == 0, "no_chunks").otherwise("success"))


def build_report(results: DataFrame) -> DataFrame:
    """S15. Files and chunks per status."""
    return build_status(results).groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.sum("chunks").alias("chunks"))
