"""Operator 4: toxicity by weak supervision.

Voters are word beginnings and whole words, each with a least number of occurrences; they are mined from labelled
text.  A generative model with one hidden class per document estimates the voters' accuracies, the reliability of the
labels themselves and the correlation of voters that fire together, and gives posterior labels.  A linear
classifier over the voters' counts is trained on those, and scores whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.bytehash import mix64, pieces, prefix_hash, span_hash
from attestry.llm.store import settle, small_batches

#: Labelled rows used for learning, at most: those of the smallest hashed doc_id.
SAMPLE = 16_000
#: Bytes of a word's beginning that make a pattern voter, besides the whole word.
PREFIXES = (4, 5, 6, 7, 8, 9, 10, 12)
#: Pattern terms that become voters, and the texts of the rarer class that a term must stand in.
TERMS = 500
SUPPORT = 3
#: A voter fires at one occurrence, another at so many.
AT_LEAST = (1, 3)
ROUNDS = 25
SMOOTH = 0.5

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = True
_LETTER[128:] = True


@dataclass
class Model:
    """Terms (sorted hashes) with their weights; ``bias`` is the score of a text without any."""

    terms: np.ndarray
    weights: np.ndarray
    bias: float


def term_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, row) of the whole words, then of the word beginnings of each length, in lower-cased bytes."""
    solid = np.zeros(len(data) + 2, dtype=bool)
    solid[1:-1] = _LETTER[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    start = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    end = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    sums = prefix_hash(data)
    yield mix64(span_hash(sums, start, end) + np.uint64(1)), row
    for n in PREFIXES:
        longer = np.flatnonzero(end - start > n)
        yield span_hash(sums, start[longer], start[longer] + n), row[longer]


def _texts(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()))


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) -> (term, toxic texts, other texts) with each term once in a text."""
    np.seterr(over="ignore")
    for batch in batches:
        toxic = np.asarray(batch.column(1)).astype(bool)
        for row, data, offsets in pieces(_texts(batch.column(0))):
            h, r = (np.concatenate(x) for x in zip(*term_hashes(data, offsets), strict=True))
            pair = np.unique(np.stack([h, r.astype(np.uint64)]), axis=1) if len(h) else np.zeros((2, 0), dtype=np.uint64)
            term, at = np.unique(pair[0], return_inverse=True)
            bad = np.bincount(at, weights=toxic[row + pair[1].astype(np.int64)], minlength=len(term)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(term)) - bad)], ["term", "bad", "fine"])


def term_counts(column: pa.Array, terms: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, term index, count) of the occurrences of the given sorted hashes, run by run."""
    mask = np.zeros(1 << 16, dtype=bool)
    mask[(terms >> np.uint64(48)).astype(np.int64)] = True
    for row, data, offsets in pieces(_texts(column)):
        keys = []
        for h, r in term_hashes(data, offsets):
            maybe = np.flatnonzero(mask[(h >> np.uint64(48)).astype(np.int64)])
            at = np.searchsorted(terms, h[maybe])
            hit = at < len(terms)
            hit[hit] = terms[at[hit]] == h[maybe][hit]
            keys.append(r[maybe[hit]].astype(np.int64) * max(1, len(terms)) + at[hit])
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        yield row, len(offsets) - 1, key // max(1, len(terms)), key % max(1, len(terms)), count


def _votes(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            terms_of, counts_of = [b""] * batch.num_rows, [b""] * batch.num_rows
            for row, size, r, t, n in term_counts(batch.column(0), terms):
                cut = np.searchsorted(r, np.arange(size + 1))
                for i in range(size):
                    terms_of[row + i] = t[cut[i] : cut[i + 1]].astype(np.int32).tobytes()
                    counts_of[row + i] = n[cut[i] : cut[i + 1]].astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int32()), pa.array(terms_of, pa.binary()), pa.array(counts_of, pa.binary())], ["toxic", "terms", "counts"])

    return run


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of the hidden class, weight of each voter) by expectation maximisation.

    ``votes`` is a 0/1 matrix (texts, voters), ``labels`` the 0/1 labels, which count as one more voter of unknown
    reliability.  A voter's evidence is divided by the sum of its conditional correlations with all voters, so that
    voters that see the same word do not count twice.
    """
    v = votes.astype(np.float32)
    together = (v.T @ v).astype(np.float64)
    y = np.where(labels > 0, 0.97, 0.03)
    scale = np.ones(v.shape[1])
    for _ in range(rounds):
        both = np.stack([y, 1 - y], axis=1)  # share of each class in each text
        size = both.sum(axis=0)
        hits = (v.T @ both.astype(np.float32)).astype(np.float64)  # (voters, classes)
        fire = (hits + SMOOTH) / (size + 2 * SMOOTH)
        # conditional correlation of the voters: what is left of their votes once the class is taken into account
        cross = hits @ fire.T
        cov = (together - cross - cross.T + fire @ (both.T @ both) @ fire.T) / len(v)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        scale = 1 / np.maximum(1, np.maximum(cov / np.outer(sd, sd), 0).sum(axis=1))
        on, off = np.log(fire[:, 0] / fire[:, 1]), np.log((1 - fire[:, 0]) / (1 - fire[:, 1]))
        said = (both.T @ labels + SMOOTH) / (size + 2 * SMOOTH)
        logit = np.log((size[0] + SMOOTH) / (size[1] + SMOOTH)) + v @ (scale * (on - off)).astype(np.float32) + (scale * off).sum()
        logit += np.where(labels > 0, np.log(said[0] / said[1]), np.log((1 - said[0]) / (1 - said[1])))
        y = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    return y, scale


def linear(features: np.ndarray, target: np.ndarray, ridge: float = 1.0, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on soft targets, by full-batch Adam steps."""
    x = features.astype(np.float32, copy=False)
    target = target.astype(np.float32)
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + np.float32(b), -40, 40)))
        g = np.append(x.T @ (p - target) + ridge * w / 100, (p - target).sum()) / len(x)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        d = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
        w, b = w - d[:-1].astype(np.float32), b - d[-1]
    return w.astype(np.float64), float(b)


def fit(labelled: DataFrame, sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """Learn from rows (doc_id, text, toxic), of which at most ``sample`` are used; only bounded tables reach the driver."""
    rows = settle(labelled.where("toxic is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("text", F.col("toxic").cast("int").alias("toxic")))
    bad, total = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    if not bad or bad == total:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), float(np.log((bad + SMOOTH) / (total - bad + SMOOTH))))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n)
    mined = rows.mapInArrow(_mine, "term long, bad long, fine long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    inside = (F.col("bad") + SMOOTH) / (bad + 2 * SMOOTH)
    outside = (F.col("fine") + SMOOTH) / (total - bad + 2 * SMOOTH)
    gain = F.col("bad") * F.log(inside / outside) + (bad - F.col("bad")) * F.log((1 - inside) / (1 - outside))
    best = mined.where((F.col("bad") >= SUPPORT) & (inside > 3 * outside)).orderBy(gain.desc(), "term").limit(terms).select("term")
    known = np.sort(np.array([r[0] for r in best.collect()], dtype=np.int64).view(np.uint64))
    seen = rows.mapInArrow(_votes(known), "toxic int, terms binary, counts binary").toArrow()
    counts = np.zeros((len(seen), len(known)), dtype=np.float32)
    labels = np.asarray(seen["toxic"]).astype(np.float64)
    for i, (t, n) in enumerate(zip(seen["terms"].to_pylist(), seen["counts"].to_pylist(), strict=True)):
        counts[i, np.frombuffer(t, dtype=np.int32)] = np.frombuffer(n, dtype=np.int32)
    votes = np.concatenate([counts >= k for k in AT_LEAST], axis=1)
    votes = votes[:, votes.any(axis=0)]
    posterior, _ = label_model(votes, labels)
    weights, bias = linear(np.log1p(counts, out=counts), posterior)
    return Model(known, weights, bias)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            logit = np.full(batch.num_rows, model.bias)
            for row, size, r, t, n in term_counts(batch.column(1), model.terms):
                logit[row : row + size] += np.bincount(r, weights=np.log1p(n) * model.weights[t], minlength=size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logit, -40, 40))))], ["row", "score"])

    return run


def score(docs: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """(row, score, predicted): a score from 0 to 1 of each whole ``text``; a null text counts as empty."""
    packed = docs.select(F.struct(*carry).alias("row"), F.col("text").cast("string").alias("text"))
    out = packed.mapInArrow(_score(model), f"row {packed.schema['row'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row for each row of ``docs`` (doc_id, text; others are not read).

    Learns from documents with a label (doc_id, toxic) whose crc32(doc_id as text) mod 5 is not 0.  A doc_id with
    several labels counts as toxic if one is 1; one with several texts has them all labelled alike.  Null texts
    count as empty, a null doc_id is not labelled and not held out; without labels of both classes every score is the share of the
    class that there is.  An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    fold = lambda c: F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))
    told = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~fold(F.col("doc_id")))
    told = told.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = docs.select("doc_id", "text")
    # at most ``sample`` rows of two numbers are broadcast
    model = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(told), "doc_id"), sample)
    return score(docs, model, ["doc_id"]).select("row.doc_id", fold(F.col("row.doc_id")).alias("held_out"), "score", "predicted")
