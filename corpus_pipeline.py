"""Training-data pipeline: quality, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last adds the ids.  A stage
that drops rows drops them for its own reason only: rows with a null or empty text pass all stages but the first
decides on them as on any other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm import decontaminate, minhash, resample, sentencepieces, suffixdedup
from attestry.llm.queries import MODEL_PATH
from attestry.llm.store import settle
from attestry.session import load_table

#: Percent of common shingles from which rows are near copies in the pipeline; op8's own contract has 85.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling draws; all their columns stay as they are."""
    kept = resample.resample(docs, load_table(spark, sf_dir, "labels")).where("selected")
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies (``NEAR_PERCENT``), whatever their doc_ids; rows without words are in no group and stay.

    It is the row with the smallest doc_id; rows without a doc_id come last, and a hash of the row breaks ties.  Groups
    are made of rows, not of doc_ids: two texts of one doc_id are two documents here, so that neither takes the other along.
    """
    id_ = F.col("doc_id").cast("long")
    rows = settle(docs.select(F.monotonically_increasing_id().alias("row"), id_.alias("id"), _whole(docs), "text"))  # written once, so that the numbers stay
    groups = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text"), percent=NEAR_PERCENT)
    groups = groups.select(F.col("doc_id").alias("row"), "component_id")
    rank = rows.select("row", F.struct(F.col("id").isNull().alias("unnamed"), "id", F.xxhash64(F.to_json("doc")).alias("hash"), "row").alias("rank"))
    first = settle(groups.join(rank, "row").groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.row"))
    return _unpacked(rows.hint("merge").join(first, "row", "left_semi"), docs)


def _whole(docs: DataFrame) -> Column:
    """All columns as one, so that no helper's name can clash with one of theirs."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out every passage of 200 bytes or more that stands in several places; no row is dropped."""
    return suffixdedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item, with its own or with other values in its slots."""
    judged = decontaminate.contamination(docs.select("doc_id", "text"), load_table(spark, sf_dir, "benchmark"))
    gone = settle(judged.where("contaminated").select("k1", "k2").distinct())
    text = F.col("text").cast("string")
    keyed = docs.select(_whole(docs), F.xxhash64(text).alias("k1"), F.hash(text).alias("k2"))
    return _unpacked(keyed.hint("merge").join(gone, ["k1", "k2"], "left_anti"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids, n_ids, round_trip and parity behind their own columns."""
    out = sentencepieces.encode_documents(docs, sentencepieces.model_bytes(MODEL_PATH))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns], "ids", "n_ids", "round_trip", "parity")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece encoding and decoding", tokens),
]

#: The first stage draws random numbers and the last uses a vocabulary file: SQL cannot state the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    docs = load_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
