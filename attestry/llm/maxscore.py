"""Operator 3: exact top-k search by MaxScore.

A vector is a document whose terms are its dimensions with whole-number weights.  For each query the terms are
ordered by the most that they can add in a shard.  The essential terms, without which no row can reach the k-th best
score so far, are traversed first; the others are probed in order, and only for rows that can still compete.
Shards are merged by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.store import settle

K = 20
SCALE = 64
#: Rows of a shard, rows scored together, queries of a block, shards that one task takes for a block.
SHARD = 4096
RUN = 512
BLOCK = 512
GROUP = 4
#: Terms probed between two looks at which rows can still compete.
PROBE = 8


def _pack(size: int):
    """(vec_id, terms) -> rows of at most ``size`` vectors as two byte strings, the longest vectors first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[list[int]] = []

        def flush() -> pa.RecordBatch:
            wide = max(map(len, rows))
            m = np.zeros((len(rows), wide), dtype=np.int64)
            for i, r in enumerate(rows):
                m[i, : len(r)] = r
            order = np.argsort(-np.abs(m).astype(np.float64).sum(axis=1), kind="stable")
            name = np.array(ids, dtype=np.int64)[order]
            most = np.abs(m.astype(np.float64)).max(initial=0)
            kind = next((t for t in ("int8", "int16", "int32") if most <= np.iinfo(t).max), "int64")  # the smallest that holds all
            out = pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([name.tobytes()], pa.binary()), pa.array([kind]), pa.array([m[order].astype(kind).tobytes()], pa.binary())], ["n", "ids", "kind", "terms"])
            ids.clear(), rows.clear()
            return out

        for batch in batches:
            for i, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                rows.append(r)
                if len(ids) == size:
                    yield flush()
        if ids:
            yield flush()

    return run


def _unpack(n: int, ids: bytes, kind: str, terms: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, dtype=np.int64), np.frombuffer(terms, dtype=kind).reshape(n, -1).astype(np.int64)


class _Best:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score = np.zeros(0, dtype=np.int64)
        self.id = np.zeros(0, dtype=np.int64)

    def offer(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]

    @property
    def least(self) -> int | None:
        return int(self.score[-1]) if len(self.score) == self.k else None


def search_shard(query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, best: _Best) -> None:
    """Offer to ``best`` every row of the shard that can be among the k best; ``low``/``high`` bound each term's weights.

    ``rows`` are floats that hold whole numbers exactly, or integers.
    """
    bound = np.maximum(query * low, query * high)
    order = np.argsort(-bound, kind="stable")
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # the most that the terms from here on can add
    q = query[order]
    for a in range(0, len(ids), RUN):
        name, part = ids[a : a + RUN], rows[a : a + RUN]
        least = best.least
        if least is None:
            score = part @ query
            keep = name != own
            best.offer(score[keep].astype(np.int64), name[keep])
            continue
        # essential terms: as many as it takes until the others alone cannot reach the k-th best
        below = np.flatnonzero(rest < least)
        done = int(below[0]) if len(below) else len(q)
        score = part[:, order[:done]] @ q[:done]
        at = np.flatnonzero((score + rest[done] >= least) & (name != own))
        score = score[at]
        while done < len(q) and len(at):
            step = order[done : done + PROBE]
            score = score + part[np.ix_(at, step)] @ query[step]
            done = min(done + PROBE, len(q))
            keep = score + rest[done] >= least
            at, score = at[keep], score[keep]
        if len(at):
            best.offer(score.astype(np.int64), name[at])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, dict[int, _Best]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                block, *packed = (batch.column(c)[row].as_py() for c in range(9))
                names, queries = _unpack(*packed[:4])
                ids, rows = _unpack(*packed[4:])
                wide = max(queries.shape[1], rows.shape[1])
                queries = np.pad(queries, ((0, 0), (0, wide - queries.shape[1])))
                rows = np.pad(rows, ((0, 0), (0, wide - rows.shape[1])))
                most = float(np.abs(queries).astype(np.float64).max(initial=0)) * float(np.abs(rows).astype(np.float64).max(initial=0)) * max(1, wide)
                kind = np.float64 if most < 2**53 else np.int64 if most < 2**63 else object
                rows, queries = rows.astype(kind), queries.astype(kind)
                low, high = rows.min(axis=0), rows.max(axis=0)
                own = kept.setdefault(block, {})
                for i, name in enumerate(names.tolist()):
                    search_shard(queries[i], name, ids, rows, low, high, own.setdefault(name, _Best(k)))
        q = [(name, b) for found in kept.values() for name, b in found.items() if len(b.id)]
        cols = [np.repeat([n for n, _ in q], [len(b.id) for _, b in q]), np.concatenate([b.id for _, b in q]), np.concatenate([b.score for _, b in q])] if q else [np.zeros(0, dtype=np.int64)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query with the rows of ``vectors``.

    Both need vec_id and embedding; each component x becomes floor(scale * x).  Rows whose vec_id is null, or whose
    embedding is null or holds a null or non-finite component, take no part; shorter vectors are filled up with 0.
    A row with the query's own id is no candidate; other repeated rows each count, and a repeated query is asked
    once (of different vectors under one id, any one).  Fewer than ``k`` candidates are all returned; empty tables
    give an empty result.  Scores beyond 64 bits are not defined.
    """

    def terms(df: DataFrame) -> DataFrame:
        sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        df = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
        return df.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("terms"))

    packed = "n long, ids binary, kind string, terms binary"
    shards = settle(terms(vectors).mapInArrow(_pack(SHARD), packed))
    asked = terms(queries).groupBy("vec_id").agg(F.max("terms").alias("terms"))
    blocks = settle(asked.mapInArrow(_pack(BLOCK), packed))
    groups, lots = max(1, -(-shards.count() // GROUP)), max(1, blocks.count())
    # every block meets every group of shards once: both sides carry the pair's key, and no side goes whole to a task
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    name = F.xxhash64("ids")
    left = blocks.select(name.alias("block"), *[F.col(c).alias(f"q_{c}") for c in blocks.columns], F.pmod(name, F.lit(lots)).cast("int").alias("lot"), every(groups).alias("grp"))
    right = shards.select(*shards.columns, F.pmod(name, F.lit(groups)).cast("int").alias("grp"), every(lots).alias("lot"))
    pairs = left.hint("merge").join(right, ["grp", "lot"]).select("block", *[f"q_{c}" for c in blocks.columns], *shards.columns)
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
