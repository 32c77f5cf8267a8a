"""Exact cosine top-k and batch model jobs (R6, R7, R8, R20, R21 scoring)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions.vectors import dot, unit
from attestry.operators.lexical import top_k

BLOCK = 8192


def _matrix(col) -> np.ndarray:
    m = np.vstack(list(col)).astype(np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _block_top(qm: np.ndarray, qid: np.ndarray, vm: np.ndarray, vid: np.ndarray, k: int, threshold: float | None, mask: np.ndarray | None = None):
    """Local top-k of a query block against a vector block, ties by id; never more than k rows per query.

    ``mask`` (query, vector) names the pairs that count."""
    sims = np.round(qm @ vm.T, 6)
    if mask is not None:
        sims[~mask] = -np.inf
    kk = min(k, sims.shape[1])
    cut = np.partition(sims, sims.shape[1] - kk, axis=1)[:, sims.shape[1] - kk]
    out_q, out_v, out_s = [], [], []
    for r in range(len(qid)):
        idx = np.flatnonzero((sims[r] >= cut[r]) & (sims[r] > -np.inf))
        order = np.lexsort((vid[idx], -sims[r, idx]))[:kk]
        idx = idx[order]
        out_q.append(np.full(len(idx), qid[r]))
        out_v.append(vid[idx])
        out_s.append(sims[r, idx])
    return pd.DataFrame({"query_id": np.concatenate(out_q), "chunk_id": np.concatenate(out_v), "score": np.concatenate(out_s)})


def vector_topk(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 30,
    scope: DataFrame | None = None,
    exclude_self: bool = False,
    block: int = BLOCK,
    n_vectors: int | None = None,
) -> DataFrame:
    """R6. Exact cosine top-k: (query_id, chunk_id, score, rank).

    ``queries`` (query_id, embedding), ``vectors`` (chunk_id, embedding); integer ids.
    Both sides are cut into blocks of about ``block`` rows and every pair of blocks meets in one task: a
    fragment-and-replicate grid keyed by (query block, vector block), the same for every size.  A task emits only
    its local top-k, so the final ranking shuffles k rows per query and block.
    R8: with ``scope`` (query_id, chunk_id) only those pairs are scored, through equi joins.
    R20: ``exclude_self`` drops the query's own row (k + 1 nearest minus self).
    ``n_vectors``, if known, sets the number of blocks; vectors that are computed need not be counted for it.
    """
    q = queries.select("query_id", F.col("embedding").alias("_qe"))
    schema = f"query_id {_type(queries, 'query_id')}, chunk_id {_type(vectors, 'chunk_id')}, score double"
    if scope is not None:
        pairs = scope.join(q, "query_id").join(vectors.select("chunk_id", F.col("embedding").alias("_ve")), "chunk_id")
        cand = pairs.select("query_id", "chunk_id", F.round(dot(unit(F.col("_qe")), unit(F.col("_ve"))), 6).alias("score"))
    else:
        local_k = k + 1 if exclude_self else k
        cand = _grid(q, vectors, local_k, schema, block, n_vectors)
    if exclude_self:
        cand = cand.where(F.col("query_id") != F.col("chunk_id"))
    return top_k(cand, k)


def _type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def _grid(q: DataFrame, vectors: DataFrame, k: int, schema: str, block: int, n_vectors: int | None) -> DataFrame:
    nq = max(1, math.ceil(q.count() / block))
    nv = max(1, math.ceil((vectors.count() if n_vectors is None else n_vectors) / block))
    salt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    qs = q.select("query_id", "_qe", salt("query_id", nq).alias("qb"), span(nv).alias("vb"))
    vs = vectors.select("chunk_id", "embedding", salt("chunk_id", nv).alias("vb"), span(nq).alias("qb"))

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": a["query_id"][:0], "chunk_id": b["chunk_id"][:0], "score": pd.Series(dtype="float64")})
        return _block_top(_matrix(a["_qe"]), a["query_id"].to_numpy(), _matrix(b["embedding"]), b["chunk_id"].to_numpy(), k, None)

    return qs.groupBy("qb", "vb").cogroup(vs.groupBy("qb", "vb")).applyInPandas(run, schema)


def embed(
    df: DataFrame, encode_fn: Callable[[Sequence[str]], np.ndarray], text: str = "text", batch: int = 16, prefix: str = "", dim: int = 64
) -> DataFrame:
    """R7. Batch embedding job: unit vectors, blank text to the zero vector, optional query prefix.

    ``encode_fn`` turns a list of texts into a matrix; it is built once per task by pickling.
    """
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", embedding array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[text].fillna("").tolist()
            vecs = np.zeros((len(texts), dim))
            live = [i for i, t in enumerate(texts) if t.strip()]
            for s in range(0, len(live), batch):
                part = live[s : s + batch]
                vecs[part] = _matrix(encode_fn([prefix + texts[i] for i in part]))
            yield pdf.assign(embedding=list(vecs))

    return df.mapInPandas(run, out)


def score_pairs(
    pairs: DataFrame, score_fn: Callable[[Sequence[str], Sequence[str]], np.ndarray], query: str = "query", text: str = "text",
    batch: int = 8, activation: str = "sigmoid",
) -> DataFrame:
    """R21. Batch rerank scoring: adds ``rerank_score``; one logit -> sigmoid, two logits -> softmax of the
    positive class."""
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema) + ", rerank_score double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = []
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                logits = np.asarray(score_fn(part[query].tolist(), part[text].tolist()), dtype=float)
                if activation == "softmax":
                    e = np.exp(logits - logits.max(axis=1, keepdims=True))
                    scores.extend(e[:, 1] / e.sum(axis=1))
                else:
                    scores.extend(1 / (1 + np.exp(-logits.reshape(-1))))
            yield pdf.assign(rerank_score=scores)

    return pairs.mapInPandas(run, out)
