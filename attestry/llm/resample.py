"""Operator 7: quality by importance resampling.

Two generative models over hashed n-grams, one of labelled good text (target) and one of all text (raw), give each
document a log importance weight; a Gumbel top-k sample of those weights is kept.  The n-grams are one and two
words, and one to three word shapes (letter case, digits, closing sign, whether a word repeats the one before).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attestry.llm.bytehash import LOWER, mix64, pieces, prefix_hash, span_hash, word_spans
from attestry.llm.store import settle, small_batches

BUCKETS = 1 << 16
SMOOTH = 0.5
#: The log weight of a document is its mean over n-grams, at this many n-grams: the sample then depends on what a
#: text is like and not on how long it is, and the Gumbel noise (deviation 1.28) only matters near the cut.
NGRAMS = 400
SEED = 7
BINS = 4096

_KIND = np.zeros(256, dtype=np.uint64)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[128:] = 1
_SIGN = np.arange(256, dtype=np.uint64) * (_KIND == 0)


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, row of each n-gram) of a run of texts."""
    start, end, bounds = word_spans(data, offsets)
    n = len(start)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    word = span_hash(prefix_hash(LOWER[data]), start, end)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    shape = np.zeros(n, dtype=np.uint64)
    if n:
        first, last = data[start], data[end - 1]
        shout = (upper[end] - upper[start] > 1).astype(np.uint64)
        again = np.concatenate([[False], (word[1:] == word[:-1]) & (row[1:] == row[:-1])]).astype(np.uint64)
        shape = mix64(_KIND[first] + (_KIND[last] << np.uint64(3)) + (_SIGN[first] << np.uint64(8)) + (_SIGN[last] << np.uint64(16)) + (shout << np.uint64(24)) + (again << np.uint64(25)) + np.uint64(1 << 40))
    grams, rows = [], []
    for unit, longest, salt in ((word, 2, 11), (shape, 3, 23)):
        h = np.full(n, salt, dtype=np.uint64)
        for k in range(longest):
            m = max(0, n - k)
            h = mix64(h[:m] * np.uint64(3) + unit[k : k + m])
            same = row[:m] == row[k : k + m] if k else slice(None)
            grams.append((h[same] >> np.uint64(20)) % np.uint64(buckets))
            rows.append(row[:m][same])
    return np.concatenate(grams).astype(np.int64), np.concatenate(rows)


def _counts(buckets: int):
    """(text, target weight) -> (bucket, raw count, target count), summed over the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        raw = np.zeros(buckets, dtype=np.int64)
        target = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            good = np.asarray(batch.column(1).fill_null(0)).astype(bool)
            for row, data, offsets in pieces(batch.column(0)):
                bucket, owner = ngram_buckets(data, offsets, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[row + owner]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return run


def _weigh(ratio: np.ndarray):
    """(text, position) -> (position, n_grams, mean log ratio)."""
    buckets = len(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            count = np.zeros(batch.num_rows, dtype=np.int64)
            total = np.zeros(batch.num_rows)
            for row, data, offsets in pieces(batch.column(0)):
                bucket, owner = ngram_buckets(data, offsets, buckets)
                size = len(offsets) - 1
                count[row : row + size] = np.bincount(owner, minlength=size)
                total[row : row + size] = np.bincount(owner, weights=ratio[bucket], minlength=size)
            mean = total / np.maximum(count, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(count), pa.array(mean)], [*batch.schema.names[1:], "n_grams", "ratio"])

    return run


def gumbel(*keys: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on the keys only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double")
    return -F.log(-F.log((bits + 0.5) / float(1 << 53)))


def kth_largest(df: DataFrame, value: str, k: int) -> float:
    """The k-th largest value, by counting in ever narrower bins; only counts of ``BINS`` bins reach the driver."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if k <= 1 or low == high:
        return high if k <= 1 else low
    above = 0
    while True:
        width = (high - low) / BINS
        inside = df.where(F.col(value).between(low, high))
        bins = inside.groupBy(F.least(F.floor((F.col(value) - low) / width), F.lit(BINS - 1)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        for r in sorted(bins.collect(), key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                break
            above += r["n"]
        if r["lo"] == r["hi"] or (r["lo"], r["hi"]) == (low, high):
            return r["lo"]
        if above + 1 == k:
            return r["hi"]
        low, high = r["lo"], r["hi"]


def best_cut(scored: DataFrame) -> float:
    """The ratio that separates labelled good rows from bad ones with the fewest errors of equal class weight.

    ``scored`` has ``ratio`` and ``good`` (null: not labelled).  Without rows of both classes nothing is cut off.
    """
    bins = scored.where("good is not null").groupBy(F.round(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), "ratio")), 3).alias("bin")).agg(F.sum(F.col("good").cast("long")).alias("g"), F.count(F.lit(1)).alias("n"))
    rows = sorted((r["bin"], r["g"], r["n"] - r["g"]) for r in bins.collect())
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return float("-inf")
    # a lost good row weighs as much as its class is large, so that clean text stays
    best, cut, lost, caught = bad, float("-inf"), 0, 0
    for (bin_, g, b), after in zip(rows, [*rows[1:], None], strict=True):
        lost, caught = lost + g, caught + b
        errors = 2 * lost + bad - caught
        if errors < best:
            best, cut = errors, (bin_ + after[0]) / 2 if after else float("inf")
    return cut


def weights(docs: DataFrame, ratio: np.ndarray, ngrams: int = NGRAMS, seed: int = SEED) -> DataFrame:
    """(row, n_grams, ratio, log_weight, key) of each document; ``row`` is a struct of all columns of ``docs``."""
    packed = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = packed.mapInArrow(_weigh(ratio), StructType([packed.schema["row"], *StructType.fromDDL("n_grams long, ratio double").fields]))
    log_weight = F.col("ratio") * ngrams
    return out.withColumn("log_weight", log_weight).withColumn("key", log_weight + gumbel(F.col("row.doc_id"), seed=seed))


def resample(docs: DataFrame, labels: DataFrame, carry: list[str] | None = None, buckets: int = BUCKETS, keep: int | None = None, ngrams: int = NGRAMS, seed: int = SEED) -> DataFrame:
    """(row, n_grams, ratio, log_weight, key, selected); ``row`` is a struct of the columns ``carry`` (default: all).

    ``docs`` needs doc_id and text, ``labels`` doc_id and quality; the target model counts the texts labelled 1 and
    the raw model all texts.  ``keep`` is the size of the sample; by default it is the number of documents on the
    good side of the cut that best separates the labels.  Equal keys at the boundary are all kept.  A null or blank
    text has no n-grams, weight 0 and takes part like any other; a null doc_id is not labelled; a doc_id with
    several labels counts as good if one is 1.  Empty tables give an empty result; without labels all rows stay.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if carry is None or c in (*carry, "doc_id", "text")])
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("quality") == 1).alias("good"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # labels grow with the documents: the same join at every size
    labelled = texts.hint("merge").join(good.where("good").select("id"), "id", "left_semi").select("text", F.lit(1).alias("good"))
    raw = texts.select("text", F.lit(0).alias("good"))
    schema = "bucket long, raw long, target long"
    counts = raw.mapInArrow(_counts(buckets), schema).select("bucket", "raw", F.lit(0).alias("target"))
    counts = counts.unionByName(labelled.mapInArrow(_counts(buckets), schema).select("bucket", F.lit(0).alias("raw"), "target"))
    table = np.zeros((2, buckets))
    for b, r, t in counts.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        table[:, b] = r, t
    prob = (table + SMOOTH) / (table.sum(axis=1, keepdims=True) + SMOOTH * buckets)
    ratio = np.log(prob[1]) - np.log(prob[0]) if table[1].any() else np.zeros(buckets)

    keys = settle(weights(docs.select("doc_id", "text"), ratio, ngrams, seed).select(F.col("row.doc_id").cast("long").alias("id"), "ratio", "key"))
    if keep is None:
        cut = best_cut(keys.join(good, "id").select("ratio", "good"))
        keep = keys.where(F.col("ratio") >= F.lit(cut)).count()
    least = kth_largest(keys, "key", keep) if keep > 0 and not keys.isEmpty() else float("inf")
    out = weights(docs, ratio, ngrams, seed).withColumn("selected", F.col("key") >= F.lit(least))
    if carry is not None:
        out = out.withColumn("row", F.struct(*[F.col(f"row.`{c}`").alias(c) for c in carry]))
    return out
