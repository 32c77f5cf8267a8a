"""Vector column functions and the default hashed encoder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v
    )


def unit(v: Column) -> Column:
    """L2-normalised copy; a zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def token_bucket(term: Column, dim: int = DIM) -> Column:
    """Dimension of a token: first eight hex digits of its md5, modulo ``dim``."""
    return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % dim).cast("int")


def hashed_vectors(postings: DataFrame, id_col: str = "chunk_id", dim: int = DIM) -> DataFrame:
    """Default encoder as a relational job over (id, term, tf): counts per bucket, L2-normalised.

    Postings that arrive partitioned by ``id_col`` keep that partitioning through both groupings, so no
    further shuffle is planned.
    """
    sparse = (
        postings.select(id_col, token_bucket(F.col("term"), dim).alias("_d"), "tf")
        .groupBy(id_col, "_d").agg(F.sum("tf").cast("double").alias("_n"))
        .groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("_d", "_n"))).alias("_m"),
                             F.sqrt(F.sum(F.col("_n") * F.col("_n"))).alias("_len"))
    )
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)) / F.col("_len"))
    return sparse.select(id_col, dense.alias("embedding"))
