"""Operator 9: language identification by a convolutional network over bytes.

Texts are cut into windows of a fixed number of bytes.  Byte embeddings, filters of several widths, the maximum of
each filter over the window and a softmax give a window's language; a text's is the mean over all its windows.
The network is trained in numpy on windows of labelled text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.bytehash import pieces
from attestry.llm.store import small_batches

WINDOW = 128
EMBED = 6
WIDTHS = (2, 3, 4)
FILTERS = 12
#: Labelled texts used for training, at most: so many of each language and so many in all, by hashed doc_id.
PER_LANGUAGE = 1500
SAMPLE = 8000
#: Parts in which a language's rows are ranked first.
PARTS = 64
#: Windows of a training text, evenly spread over it.
SPREAD = 4
EPOCHS = 8
BATCH = 256
UNKNOWN = "und"
#: Windows pushed through the network at a time.
STEP = 512


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # (256, EMBED)
    filters: np.ndarray  # (max width * EMBED, len(WIDTHS) * FILTERS), zero beyond a filter's width
    bias: np.ndarray
    out: np.ndarray  # (features, languages)
    out_bias: np.ndarray


def _patches(embed: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """(n, positions, max width * EMBED): the embedded bytes that each position's filters see."""
    wide = max(WIDTHS)
    e = embed[windows]
    return np.concatenate([e[:, j : windows.shape[1] - wide + 1 + j] for j in range(wide)], axis=2)


def forward(net: Network, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class probabilities, pooled features, position of each maximum) of a matrix of windows."""
    x = _patches(net.embed, windows)
    r = (x.reshape(-1, x.shape[2]) @ net.filters).reshape(len(windows), x.shape[1], -1)
    at = r.argmax(axis=1)
    top = np.take_along_axis(r, at[:, None, :], axis=1)[:, 0, :] + net.bias
    f = np.maximum(top, 0)
    z = f @ net.out + net.out_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True), f, at


def probabilities(net: Network, windows: np.ndarray) -> np.ndarray:
    out = []
    for a in range(0, len(windows), STEP):
        x = _patches(net.embed, windows[a : a + STEP])
        r = (x.reshape(-1, x.shape[2]) @ net.filters).reshape(x.shape[0], x.shape[1], -1).max(axis=1)
        z = np.maximum(r + net.bias, 0) @ net.out + net.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        out.append(z / z.sum(axis=1, keepdims=True))
    return np.concatenate(out) if out else np.zeros((0, len(net.languages)))


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, row of each): every byte of each row, with the overlap of a filter; the last is filled up with 0."""
    stride = WINDOW - max(WIDTHS) + 1
    size = np.diff(offsets)
    count = np.where(size > 0, np.maximum(1, -(-(size - max(WIDTHS) + 1) // stride)), 0)
    row = np.repeat(np.arange(len(size)), count)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * stride + offsets[:-1][row]
    at = start[:, None] + np.arange(WINDOW)
    inside = at < offsets[1:][row][:, None]
    return np.where(inside, data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8), row


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = 1) -> Network:
    """Adam on the cross-entropy; classes weigh alike."""
    rng = np.random.default_rng(seed)
    wide, k = max(WIDTHS), len(languages)
    mask = np.concatenate([np.repeat((np.arange(wide) < w)[:, None], FILTERS, axis=1) for w in WIDTHS], axis=1).repeat(EMBED, axis=0).astype(np.float32)
    f = mask.shape[1]
    net = Network(
        languages, rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), (rng.normal(0, 0.4, mask.shape) * mask).astype(np.float32),
        np.zeros(f, dtype=np.float32), rng.normal(0, 0.1, (f, k)).astype(np.float32), np.zeros(k, dtype=np.float32))
    names = ("embed", "filters", "bias", "out", "out_bias")
    first = {n: np.zeros_like(getattr(net, n)) for n in names}
    second = {n: np.zeros_like(getattr(net, n)) for n in names}
    share = 1 / np.maximum(1, np.bincount(target, minlength=k))
    weight = (share[target] / share[target].mean()).astype(np.float32)
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        rate = 0.01 * (1 - epoch / epochs)
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            w, y = windows[pick], target[pick]
            p, feat, at = forward(net, w)
            d = p.copy()
            d[np.arange(len(y)), y] -= 1
            d *= weight[pick][:, None] / len(y)
            grad = {"out": feat.T @ d, "out_bias": d.sum(axis=0)}
            back = (d @ net.out.T) * (feat > 0)
            grad["bias"] = back.sum(axis=0)
            seen = w[np.arange(len(w))[:, None, None], at[:, :, None] + np.arange(wide)]  # (n, f, wide) bytes of the winners
            vec = net.embed[seen].reshape(len(w), f, -1)
            grad["filters"] = np.einsum("nfd,nf->df", vec, back) * mask
            flow = (back[:, :, None] * (net.filters * mask).T[None]).reshape(-1, EMBED)
            grad["embed"] = np.stack([np.bincount(seen.ravel(), weights=flow[:, j], minlength=256) for j in range(EMBED)], axis=1)
            t += 1
            for n in names:
                g = grad[n].astype(np.float32)
                first[n] = 0.9 * first[n] + 0.1 * g
                second[n] = 0.999 * second[n] + 0.001 * g * g
                setattr(net, n, getattr(net, n) - rate * (first[n] / (1 - 0.9**t)) / (np.sqrt(second[n] / (1 - 0.999**t)) + 1e-8))
    return net


def fit(labelled: DataFrame) -> Network | None:
    """Train on rows (doc_id, text, lang); at most ``SAMPLE`` texts and ``SPREAD`` windows of each reach the driver."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = labelled.where("doc_id is not null and lang is not null and text rlike '\\\\p{L}'").select("doc_id", "lang")
    # the first of a language are among the first of its parts, so that no task ranks a whole language
    ids = ids.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(PARTS)), F.lit(PARTS)))
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("n") <= PER_LANGUAGE)
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("n") <= PER_LANGUAGE).orderBy("n", "lang").limit(SAMPLE).select("doc_id", "lang")
    # at most SAMPLE rows are broadcast
    rows = labelled.select("doc_id", "lang", "text").join(F.broadcast(ids.distinct()), ["doc_id", "lang"])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lang = [], []
            names = batch.column(0).to_pylist()
            for row, data, offsets in pieces(batch.column(1)):
                windows, owner = cut_windows(data, offsets)
                for i in range(len(offsets) - 1):
                    a, b = np.searchsorted(owner, [i, i + 1])
                    for j in np.unique(np.linspace(a, b - 1, min(SPREAD, b - a)).astype(np.int64)) if b > a else ():
                        out.append(windows[j].tobytes())
                        lang.append(names[row + i])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())], ["lang", "bytes"])

    got = sorted((r["lang"], bytes(r["bytes"])) for r in rows.select("lang", "text").mapInArrow(sample, "lang string, bytes binary").collect())
    languages = sorted({lang for lang, _ in got})
    if not languages:
        return None
    number = {lang: i for i, lang in enumerate(languages)}
    windows = np.frombuffer(b"".join(b for _, b in got), dtype=np.uint8).reshape(len(got), WINDOW)
    return train(windows, np.array([number[lang] for lang, _ in got]), languages)


def _predict(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = np.zeros(batch.num_rows, dtype=np.int64)
            score = np.zeros(batch.num_rows)
            for row, data, offsets in pieces(batch.column(1)):
                windows, owner = cut_windows(data, offsets)
                p = probabilities(net, windows)
                size = len(offsets) - 1
                mean = np.stack([np.bincount(owner, weights=p[:, k], minlength=size) for k in range(p.shape[1])], axis=1).astype(np.float64)
                mean /= np.maximum(1, np.bincount(owner, minlength=size))[:, None]
                best[row : row + size] = mean.argmax(axis=1)
                score[row : row + size] = mean.max(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([net.languages[k] for k in best], pa.string()), pa.array(np.clip(score, 0, 1))], ["row", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Network | None, carry: list[str]) -> DataFrame:
    """(row, lang_pred, score) of each whole ``text``; ``und`` and 0 for a text without letters or without a network."""
    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    packed = docs.select(F.struct(*carry, letters.alias("_letters")).alias("row"), F.col("text").cast("string").alias("text"))
    if net is None:
        return packed.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    out = packed.mapInArrow(_predict(net), f"row {packed.schema['row'].dataType.simpleString()}, lang_pred string, score double")
    known = F.col("row._letters")
    return out.select("row", F.when(known, F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, F.col("score")).otherwise(0.0).alias("score"))


def language(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row for each row of ``docs`` (doc_id, text, lang; others are not read).

    Learns from text and non-null lang of documents whose crc32(doc_id as text) mod 4 is not 2.  A text that is null
    or has no letter is ``und`` with score 0; so is every text if nothing can be learned.  A null doc_id is neither
    learned from nor held out; repeated rows come back as often as they came; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    fold = lambda c: F.coalesce(F.crc32(c.cast("string")) % 4 == 2, F.lit(False))
    net = fit(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~fold(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), net, ["doc_id"]).select("row.doc_id", fold(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
