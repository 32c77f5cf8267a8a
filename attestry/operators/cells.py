"""Exact cosine top-k that skips what cannot matter (R6, R20): cells around pivots and the triangle inequality.

Every vector belongs to the pivot it makes the smallest angle with; a cell knows the largest of these angles.  The angle
between a query and any member of a cell is at least the query's angle to the pivot less that radius, which bounds the
score.  A query first meets the cells with the best bounds, enough to fill its list; the k-th score so found rules
out every cell whose bound stays below it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators.lexical import top_k
from attestry.operators.vector import _block_top, _matrix, _type
from attestry.scale import cut_lineage

#: Vectors, and queries, that meet in one task; queries that are scored at a time.
BLOCK = 16384
AT_ONCE = 1024
#: Pivots, at most: they and the radius of each are all that the driver holds of the vectors.
PIVOTS = 256
#: Rows the pivots are chosen from, for each of them.
SAMPLED = 16
#: Scores are rounded to six digits: a bound counts as lower only by more than that.
SLACK = 1e-6
#: The cell of vectors without direction, whose cosine with anything is 0.
NOWHERE = -1


@dataclass(frozen=True)
class Cells:
    """members(chunk_id, embedding, cell, bin), the pivots as unit rows, and radius, size and bins of each cell."""

    members: DataFrame
    pivots: np.ndarray
    radius: dict[int, float]
    size: dict[int, int]
    bins: dict[int, range]


def build_cells(vectors: DataFrame, pivots: int | None = None, block: int = BLOCK) -> Cells:
    """Cells of ``vectors`` (chunk_id, embedding); by default as many pivots as the square root of the rows, ``PIVOTS`` at most.

    Pivots come from the rows with the smallest hashes, ``SAMPLED`` for each, one after the other the row furthest from
    those before it.  Cells share bins of some ``block`` vectors; one of more is dealt to several bins of its own."""
    n = pivots or max(1, min(PIVOTS, math.isqrt(vectors.count())))
    chosen = [r[0] for r in vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLED * n).select("embedding").collect()]
    rows = _matrix(chosen) if chosen else np.zeros((0, 1))
    rows = _far_apart(rows[np.linalg.norm(rows, axis=1) > 0], n)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = _matrix(pdf["embedding"])
            near = m @ rows.T if len(rows) else np.zeros((len(m), 0))
            some = (np.linalg.norm(m, axis=1) > 0) & (near.shape[1] > 0)
            cell = np.where(some, near.argmax(axis=1) if near.shape[1] else 0, NOWHERE)
            angle = np.where(some, np.arccos(np.clip(near.max(axis=1, initial=-1.0), -1, 1)), 0.0)
            yield pdf.assign(cell=cell.astype("int32"), angle=angle)

    schema = f"chunk_id {_type(vectors, 'chunk_id')}, embedding {_type(vectors, 'embedding')}, cell int, angle double"
    placed = cut_lineage(vectors.select("chunk_id", "embedding").mapInPandas(assign, schema)) if not vectors.isEmpty() else vectors.select("chunk_id", "embedding", F.lit(0).alias("cell"), F.lit(0.0).alias("angle"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius"))
    facts = sizes.collect()  # one row a cell
    bins, n_bins, room = {}, 0, 0  # room: what the last bin still takes
    for r in sorted(facts, key=lambda r: r.cell):
        parts = -(-r.n // block)
        if r.n > room:
            n_bins, room = n_bins + parts, block if parts == 1 else 0
        bins[r.cell] = range(n_bins - parts, n_bins)
        room -= r.n if parts == 1 else 0
    place = F.create_map(*[F.lit(x) for c, b in bins.items() for x in (c, b.start)]) if bins else F.lit(None)
    parts = F.create_map(*[F.lit(x) for c, b in bins.items() for x in (c, len(b))]) if bins else F.lit(None)
    at = place[F.col("cell")] + F.pmod(F.xxhash64("chunk_id"), parts[F.col("cell")]) if bins else F.lit(0)
    members = placed.select("chunk_id", "embedding", "cell", at.cast("int").alias("bin"))
    return Cells(members, rows, {r.cell: r.radius for r in facts}, {r.cell: r.n for r in facts}, bins)


def _far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows, each the least similar to all before it; fewer if the others are equal to some."""
    nearest, chosen = np.full(len(rows), -2.0), []
    while len(chosen) < n and len(rows) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    return rows[chosen]


def _bounds(queries: DataFrame, cells: Cells, k: int) -> DataFrame:
    """(query_id, _qe, bound, first): the bound of every cell, and bits of the cells where the list is filled from."""
    order = sorted(cells.radius)
    pivots, radius = cells.pivots, np.array([cells.radius[c] for c in order])
    size = np.array([cells.size[c] for c in order])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = _matrix(pdf["_qe"])
            bound = np.zeros((len(m), len(order)))  # that of NOWHERE
            for j, cell in enumerate(order):
                if cell != NOWHERE:
                    angle = np.arccos(np.clip(m @ pivots[cell], -1, 1)) - radius[j]
                    bound[:, j] = np.cos(np.maximum(angle, 0.0))
            bound[np.linalg.norm(m, axis=1) == 0] = 0.0  # such a query scores 0 everywhere
            rank = np.argsort(-bound, axis=1, kind="stable")
            before = np.cumsum(size[rank], axis=1) - size[rank]
            first = np.zeros(bound.shape, dtype=bool)
            np.put_along_axis(first, rank, before < k, axis=1)
            yield pdf.assign(bound=list(bound), first=[x.tobytes() for x in np.packbits(first, axis=1)])

    return queries.mapInPandas(run, f"query_id {_type(queries, 'query_id')}, _qe {_type(queries, '_qe')}, bound array<double>, first binary")


def _bits(packed, n: int) -> np.ndarray:
    """Rows of packed bits as booleans."""
    return np.unpackbits(np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1), axis=1, count=n).astype(bool)


def _scanned(pdf: pd.DataFrame, first: np.ndarray) -> np.ndarray:
    """Cells that are read: those the list was filled from, and those whose bound reaches the k-th score so found."""
    floor = pdf["floor"].to_numpy(dtype=np.float64)[:, None]
    return first | np.isnan(floor) | (np.vstack(list(pdf["bound"])) >= floor - SLACK)


def _score(judged: DataFrame, cells: Cells, k: int, blocks: int, seeds: bool) -> DataFrame:
    """Best k of each query in each bin, of the cells it reads there: those it starts from (``seeds``), or the others.

    A query goes once to each bin in which it reads a cell, with a bit for each cell, not once to each cell."""
    order = sorted(cells.radius)
    of_bin = {b: [j for j, c in enumerate(order) if b in cells.bins[c]] for b in range(1 + max(r[-1] for r in cells.bins.values()))}
    q_type, v_type = _type(judged, "query_id"), _type(cells.members, "chunk_id")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            first = _bits(pdf["first"].tolist(), len(order)) if len(pdf) else np.zeros((0, len(order)), dtype=bool)
            if not len(pdf):
                continue
            read = first if seeds else _scanned(pdf, first) & ~first
            for b, own in of_bin.items():
                some = np.flatnonzero(read[:, own].any(axis=1))
                if len(some):
                    bits = np.packbits(read[np.ix_(some, own)], axis=1)
                    yield pdf[["query_id", "_qe"]].iloc[some].assign(q_bin=np.int32(b), read=[x.tobytes() for x in bits])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": a["query_id"][:0], "chunk_id": b["chunk_id"][:0], "score": pd.Series(dtype="float64")})
        own = of_bin[int(b["bin"].iloc[0])]
        read, cell = _bits(a["read"].tolist(), len(own)), b["cell"].to_numpy()
        qm, qid, vm, vid = _matrix(a["_qe"]), a["query_id"].to_numpy(), _matrix(b["embedding"]), b["chunk_id"].to_numpy()
        at_own = np.searchsorted([order[j] for j in own], cell)  # the cell's bit in ``read``
        many = read @ np.bincount(at_own, minlength=len(own)) * 2 > len(vid)
        out = []
        for at in np.split(np.flatnonzero(many), range(AT_ONCE, many.sum(), AT_ONCE)):  # most of the bin: all of it, less the pairs that do not count
            if len(at):
                out.append(_block_top(qm[at], qid[at], vm, vid, k, None, read[np.ix_(at, at_own)]))
        for j in range(len(own)):  # the others cell by cell
            at, holds = np.flatnonzero(read[:, j] & ~many), at_own == j
            if len(at) and holds.any():
                out += [_block_top(qm[s], qid[s], vm[holds], vid[holds], k, None) for s in np.split(at, range(AT_ONCE, len(at), AT_ONCE))]
        return pd.concat(out) if out else pd.DataFrame({"query_id": qid[:0], "chunk_id": vid[:0], "score": pd.Series(dtype="float64")})

    asked = judged.mapInPandas(ask, f"query_id {q_type}, _qe {_type(judged, '_qe')}, q_bin int, read binary")
    q = asked.withColumn("q_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    v = cells.members.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return q.groupBy("q_bin", "q_block").cogroup(v.groupBy("bin", "block")).applyInPandas(run, f"query_id {q_type}, chunk_id {v_type}, score double")


def _search(queries: DataFrame, cells: Cells, k: int, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
    """(candidates that hold each query's best k, the queries with the bounds, first cells and ``floor`` they are judged by)."""
    q = queries.select("query_id", F.col("embedding").alias("_qe"))
    depth = k + 1 if exclude_self else k
    n_bins = 1 + max(r[-1] for r in cells.bins.values())
    blocks = max(1, math.ceil(q.count() / BLOCK), math.ceil(q.sparkSession.sparkContext.defaultParallelism / n_bins))
    bounds = cut_lineage(_bounds(q, cells, depth))
    own = F.col("query_id") != F.col("chunk_id") if exclude_self else F.lit(True)
    seeds = cut_lineage(_score(bounds, cells, depth, blocks, True).where(own))
    floor = top_k(seeds, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    judged = bounds.join(floor, "query_id", "left")
    return seeds.unionByName(_score(judged, cells, depth, blocks, False).where(own)), judged


def pruned_topk(queries: DataFrame, vectors: DataFrame | Cells, k: int = 30, exclude_self: bool = False) -> DataFrame:
    """R6, R20. Exact cosine top-k as ``vector_topk``: (query_id, chunk_id, score, rank); integer ids.

    ``vectors`` (chunk_id, embedding) or their ``build_cells``, which serve any number of query tables."""
    cells = vectors if isinstance(vectors, Cells) else build_cells(vectors)
    if not cells.radius:
        return top_k(queries.select("query_id", F.col("query_id").alias("chunk_id"), F.lit(0.0).alias("score")).limit(0), k)
    return top_k(_search(queries, cells, k, exclude_self)[0], k)


def pruning_report(queries: DataFrame, vectors: DataFrame | Cells, k: int = 30) -> DataFrame:
    """R6. One row: (query, cell) pairs, pairs whose vectors were read, and the share of vector comparisons saved."""
    cells = vectors if isinstance(vectors, Cells) else build_cells(vectors)
    order = sorted(cells.radius)
    size = np.array([cells.size[c] for c in order])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                read = _scanned(pdf, _bits(pdf["first"].tolist(), len(order)))
                yield pd.DataFrame({"pairs": [read.size], "scanned": [read.sum()], "read": [(read * size).sum()], "all": [size.sum() * len(pdf)]})

    counts = _search(queries, cells, k, False)[1].mapInPandas(count, "pairs long, scanned long, read long, all long")
    return counts.agg(F.sum("pairs").alias("pairs"), F.sum("scanned").alias("scanned"), F.round(1 - F.sum("read") / F.sum("all"), 6).alias("share_skipped"))
