"""Containment join: which texts hold which passages, character for character.

Both sides are hashed in windows of a fixed number of bytes, and of every few neighbouring windows the one with the
smallest hash is kept.  A passage that covers so many windows keeps one that any text around it keeps as well, wherever
the passage stands and whatever it is made of, so an equi join on kept hashes gives all candidates; the strings decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.scale import cut_lineage, salted_join

#: Passages are dealt with by the power of two of their bytes, up to this one; windows have half of it.
TOP_CLASS = 6
#: Bytes hashed at a time; a longer text is taken in overlapping parts.
PART_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def length_class(size: Column) -> Column:
    return F.least(F.floor(F.log2(size.cast("double"))), F.lit(TOP_CLASS)).cast("int")


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def kept_hashes(data: bytes, kind: int) -> np.ndarray:
    """Distinct hashes kept of the windows of ``data``; empty if it has too few bytes for the class."""
    width = span = max(1, 1 << kind >> 1)
    found = [np.zeros(0, dtype=np.uint64)]
    for at in range(0, max(1, len(data) - width - span + 2), PART_BYTES):
        part = np.frombuffer(data[at : at + PART_BYTES + width + span - 2], dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        if len(part) < width + span - 1:
            continue
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(part * _powers(_BASE, len(part)))])
        h = (sums[width:] - sums[:-width]) * _powers(_INVERSE, len(part) - width + 1)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        found.append(np.unique(np.lib.stride_tricks.sliding_window_view(h, span).min(axis=1)))
    return np.unique(np.concatenate(found))


def _hash_texts(kinds: list[int], one: bool):
    """(id, text, kind) -> (id, kind, hash): all kept hashes of every class asked for, or one of the text's own class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, kind_of, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.uint64)]
            for i, (text, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                data = text.encode("utf-8", "surrogatepass")
                for kind in [own] if one else kinds:
                    h = kept_hashes(data, kind)
                    h = h[:1] if one else h
                    owner.append(np.full(len(h), i))
                    kind_of.append(np.full(len(h), kind, dtype=np.int32))
                    hashes.append(h)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(np.concatenate(owner))), pa.array(np.concatenate(kind_of)), pa.array(np.concatenate(hashes).view(np.int64))], ["id", "kind", "hash"])

    return run


def containing(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """(text_id, passage_id) of texts (text_id, text) that hold a passage (passage_id, text) verbatim, each pair once.

    Null and empty passages stand in no text.  A window that many texts share is dealt to several tasks."""
    asked = cut_lineage(passages.where("text <> ''").select("passage_id", "text", length_class(F.octet_length("text")).alias("kind")))
    kinds = sorted(r[0] for r in asked.select("kind").distinct().collect())  # TOP_CLASS + 1 of them at most
    schema = lambda df, id_: T.StructType([T.StructField("id", df.schema[id_].dataType), T.StructField("kind", T.IntegerType()), T.StructField("hash", T.LongType())])
    p = asked.select(F.col("passage_id").alias("id"), "text", "kind").mapInArrow(_hash_texts(kinds, True), schema(passages, "passage_id"))
    t = texts.where("text <> ''").select(F.col("text_id").alias("id"), "text", F.lit(None).cast("int").alias("kind")).mapInArrow(_hash_texts(kinds, False), schema(texts, "text_id"))
    key = F.struct("kind", "hash").alias("key")
    wanted = p.select(key, F.col("id").alias("passage_id"))
    held = t.select(key, F.col("id").alias("text_id")).join(wanted.select("key").distinct(), "key", "left_semi")
    pairs = salted_join(wanted, cut_lineage(held), "key", "text_id").select("text_id", "passage_id").distinct()
    found = pairs.join(asked.select("passage_id", F.col("text").alias("_passage")), "passage_id").join(texts.select("text_id", F.col("text").alias("_text")), "text_id")
    return found.where(F.col("_text").contains(F.col("_passage"))).select("text_id", "passage_id").distinct()
