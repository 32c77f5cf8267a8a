"""Operator 12: exact duplicates by a persistent digest index.

The index is a bucketed Parquet table, sorted by digest inside each file, at a path of its own: one row for each
different text ever admitted.  A batch of documents is reduced to one row a digest (combined before the shuffle),
anti-joined to the index by a sort-merge join in the index's own buckets, and what is new is appended.  The index
outlives the session: opening its path again gives the same table.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.store import discard, partitions, settle
from attestry.scale import checkpoint_folder

#: Deleted from a text before it is compared: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"
#: A digest with more than this share of a batch's rows is looked up in a broadcast table, which so has under HOT rows.
HOT = 1024

_COLUMNS = "digest binary, keep_id long, keep_chars long, batch string"


@dataclass(frozen=True)
class DigestIndex:
    """A digest index in the folder ``path`` with ``buckets`` buckets; ``table`` is its name in this session."""

    spark: SparkSession
    path: str
    buckets: int
    table: str

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Forget the name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def drop(self) -> None:
        """Forget the name and delete the files."""
        self.close()
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def open_index(spark: SparkSession, path: str, buckets: int | None = None) -> DigestIndex:
    """Attach the index at ``path``, a folder all executors share; a new folder starts an empty index.

    ``buckets`` (default: the shuffle partitions) holds for the life of an index: open it with the same number.
    """
    n = buckets or partitions(spark)
    table = f"digest_index_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {table} ({_COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {n} BUCKETS LOCATION '{path.replace("'", "\\'")}'")
    return DigestIndex(spark, path, n, table)


def digest_of(text: Column) -> Column:
    """SHA-256 of the text without white space, as UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, "").cast("binary"), 256))


def _groups(keyed: DataFrame) -> DataFrame:
    """(digest, n, best): rows of each text and its best row: most code points, then smallest doc_id, nulls last."""
    best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row"))
    return keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))


def _append(index: DigestIndex, new: DataFrame) -> None:
    """One sorted file a bucket; the rows come in the index's own partitioning."""
    new.select("digest", "keep_id", "keep_chars", "batch").write.bucketBy(index.buckets, "digest").sortBy("digest").mode("append").format("parquet").saveAsTable(index.table)


def compact(index: DigestIndex, path: str) -> DigestIndex:
    """The same index in a new folder with one file a bucket; each append adds a file to every bucket it touches."""
    out = open_index(index.spark, path, index.buckets)
    _append(out, index.read().repartition(index.buckets, "digest"))
    return out


def admit(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Deduplicate ``docs`` (doc_id, text; others are not read) against the index and within, and append what is new.

    Returns one row for each row of ``docs``: (doc_id, keep_id, group_size, kept, known, text_sha256).  Texts are equal
    when they are identical without white space.  A text that an earlier batch brought is ``known``: it keeps that
    batch's row, and none of this batch is kept.  Of a new text the row with the most code points in the original,
    then the smallest doc_id is kept; a null doc_id comes last, and of rows alike in both exactly one is kept.
    ``group_size`` counts the rows of this batch.  Null and empty texts and texts of white space only are one group.

    A batch that failed half-way can be admitted again under the same name: its own rows in the index do not make a
    text known, and nothing is appended twice.  An index takes one writer at a time.  An empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    keyed = settle(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("chars"), digest_of(F.col("text")).alias("digest")))
    groups = settle(_groups(keyed))
    mine = groups.select("digest", "n", F.col("best.doc_id").alias("keep_id"), (-F.col("best.less")).alias("keep_chars"), F.col("best.row").alias("first_row"))
    earlier = index.read().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("first_id"), F.lit(True).alias("seen"))
    dealt = mine.repartition(index.buckets, "digest").hint("merge")
    _append(index, dealt.join(index.read().select("digest"), "digest", "left_anti").withColumn("batch", F.lit(batch)))
    decided = settle(dealt.join(earlier, "digest", "left").select(
        "digest", "n", F.when(F.col("seen"), F.col("first_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("seen", F.lit(False)).alias("known"), "first_row"))
    rows = keyed.count()
    hot = decided.where(F.col("n") * HOT > rows).select("digest")  # under HOT rows, since the shares sum to one at most
    warm = keyed.join(F.broadcast(hot), "digest", "left_anti").hint("merge").join(decided.join(F.broadcast(hot), "digest", "left_anti"), "digest")
    many = keyed.join(F.broadcast(decided.join(F.broadcast(hot), "digest", "left_semi")), "digest")
    out = settle(warm.unionByName(many).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (~F.col("known") & (F.col("row") == F.col("first_row"))).alias("kept"),
        "known", F.lower(F.hex("digest")).alias("text_sha256")))
    discard(keyed, groups, decided)
    return out


def deduplicate(docs: DataFrame) -> DataFrame:
    """``admit`` for a table that stands alone: an index of its own, empty at first, is built and dropped again."""
    index = open_index(docs.sparkSession, f"{checkpoint_folder(docs.sparkSession)}/digest-index-{uuid.uuid4().hex}")
    out = admit(docs, index, "all")
    index.drop()
    return out
