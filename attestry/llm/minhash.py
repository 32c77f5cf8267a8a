"""Operator 8: near-duplicate documents by circulant MinHash.

Every coordinate of a signature comes from two permutations of the 32-bit numbers: the shingle's number is
permuted once by the first, then shifted by the coordinate's number and permuted by the second.  Bands of the
signature find candidates; clusters of candidates are compared in bounded blocks, and every link is confirmed on
the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.bytehash import mix64, shingle_sets
from attestry.llm.components import components
from attestry.llm.store import partitions, settle, small_batches

WORDS = 5
PERCENT = 85
#: A pair at 85 % similarity shares no band with probability (1 - .85**5)**28 = 7e-8, one at 80 % with 1.5e-5.
BAND_ROWS = 5
BANDS = 28
#: Nodes of a cluster that one task compares at a time.
BLOCK = 3000
#: Coordinates, and the share of equal ones, under which a pair inside a block is not confirmed: seven standard errors below 0.85, five below 0.80.
SKETCH = 128
SKETCH_LEAST = 0.62


def _second(x: np.ndarray) -> np.ndarray:
    """The second permutation: a bijection of the 32-bit numbers."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(sets: list[np.ndarray], size: int) -> np.ndarray:
    """(sets, size) matrix of circulant MinHash coordinates; the sets are not empty."""
    out = np.empty((len(sets), size), dtype=np.uint32)
    row = 0
    while row < len(sets):
        end, total = row, 0
        while end < len(sets) and (end == row or total + len(sets[end]) <= 1 << 17):
            total += len(sets[end])
            end += 1
        first = (mix64(np.concatenate(sets[row:end]) ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[row : end - 1])])
        for k in range(size):
            out[row:end, k] = np.minimum.reduceat(_second(first + np.uint32(k + 1)), starts)
        row = end
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates."""
    key = np.zeros((len(sig), sig.shape[1] // rows), dtype=np.uint64)
    for j in range(rows):
        key = mix64(key + sig[:, j::rows][:, : key.shape[1]].astype(np.uint64) + np.uint64(1))
    return key.view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def block_links(nodes: np.ndarray, sets: list[np.ndarray], percent: int, groups: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Confirmed links (positions) that join the sets' components; pairs already joined are not compared.

    ``groups`` names components known before; pairs inside one are skipped.
    """
    n = len(sets)
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for known in (nodes, groups):
        if known is not None:
            seen: dict[int, int] = {}
            for i, g in enumerate(known.tolist()):
                parent[find(i)] = find(seen.setdefault(g, i))
    links: list[tuple[int, int]] = []

    def attempt(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b and linked(sets[i], sets[j], percent):
            parent[max(a, b)] = min(a, b)
            links.append((i, j))

    if n <= 3:
        for i in range(n):
            for j in range(i):
                attempt(i, j)
        return links
    size = np.array([len(s) for s in sets])
    sketch = signature(sets, SKETCH)
    step = max(1, (1 << 22) // (n * SKETCH))
    least = int(SKETCH * SKETCH_LEAST)
    found = []
    for a in range(0, n, step):
        same = (sketch[a : a + step, None, :] == sketch[None, :, :]).sum(axis=2, dtype=np.int16)
        i, j = np.nonzero(same >= least)
        i += a
        keep = (j < i) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        found.append(np.stack([i[keep], j[keep], same[i[keep] - a, j[keep]]]))
    i, j, same = np.concatenate(found, axis=1)
    order = np.argsort(-same, kind="stable")
    i, j = i[order], j[order]
    for a in range(0, len(i), 20_000):
        label = np.array([find(x) for x in range(n)])
        x, y = i[a : a + 20_000], j[a : a + 20_000]
        for p in np.flatnonzero(label[x] != label[y]).tolist():
            attempt(int(x[p]), int(y[p]))
    return links


def _sign(words: int, rows: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            sets: list[np.ndarray] = []
            for _, s in shingle_sets(batch.column(1), words):
                sets.append(s)
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(signature(full, rows * bands), rows).tolist())
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "bands"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            sets = [s.tobytes() for _, s in shingle_sets(batch.column("text"), words)]
            yield batch.drop_columns(["text"]).append_column("shingles", pa.array(sets, pa.binary()))

    return run


def _link_blocks(percent: int):
    """Rows come sorted by block; a block ends where its key changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        held: list[tuple[int, int, np.ndarray]] = []
        key = None
        u: list[int] = []
        v: list[int] = []

        def close() -> None:
            nodes = np.array([h[0] for h in held], dtype=np.int64)
            groups = np.array([h[1] for h in held], dtype=np.int64)
            for i, j in block_links(nodes, [h[2] for h in held], percent, groups):
                u.append(int(nodes[i]))
                v.append(int(nodes[j]))
            held.clear()

        for batch in batches:
            d = batch.to_pydict()
            for k, node, group, data in zip(d["block"], d["node"], d["known"], d["shingles"], strict=True):
                if k != key and held:
                    close()
                key = k
                held.append((node, group, np.frombuffer(data, dtype=np.uint64)))
            if len(u) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u.clear(), v.clear()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, rows: int = BAND_ROWS, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (columns doc_id, text; others are not read).

    Documents whose shingle sets have ``100 * intersection >= percent * union`` are linked; a component is named
    by its smallest doc_id.  Null, empty or blank texts have no shingles and are linked with nothing.  A row whose
    doc_id is null is linked with nothing, has a null component and is kept.  Rows that share a doc_id are one
    document with several texts; equal rows come back as often as they came.  An empty table gives an empty result.

    Equal sets are one node.  A cluster of candidates larger than ``block`` is cut into blocks: first each block
    alone, then, where the cluster has not become one component, every pair of blocks, for pairs not yet joined.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, set_key binary, bands array<long>"
    signed = settle(docs.mapInArrow(_sign(words, rows, bands), schema))
    classes = settle(signed.where("doc_id is not null and set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.max("bands").alias("bands")))

    cells = classes.select("node", F.posexplode("bands").alias("band", "cell"))
    shared = cells.groupBy("band", "cell").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    edges = cells.join(shared, ["band", "cell"]).where("node != low").select(F.col("node").alias("u"), F.col("low").alias("v"))
    cluster = settle(components(edges).withColumnRenamed("component", "cluster"))

    parts = cluster.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("long").alias("parts"))
    placed = cluster.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    # the same join at every size: the texts are dealt by id, whether the candidates are few or many
    sets = placed.hint("merge").join(docs.withColumnRenamed("doc_id", "node"), "node").select("node", "cluster", "parts", "part", "text")
    sets = settle(sets.mapInArrow(_sets(words), "node long, cluster long, parts long, part long, shingles binary"))

    def links(rows_: DataFrame) -> DataFrame:
        dealt = rows_.repartition(n, "block").sortWithinPartitions("block", "node")
        return dealt.mapInArrow(_link_blocks(percent), "u long, v long")

    alone = sets.select(F.concat_ws("-", "cluster", "part").alias("block"), "node", F.col("node").alias("known"), "shingles")
    first = settle(links(alone))
    joined = components(first)
    if not parts.where("parts > 1").isEmpty():
        known = sets.where("parts > 1").join(joined.withColumnRenamed("component", "known"), "node", "left").withColumn("known", F.coalesce("known", "node"))
        apart = known.groupBy("cluster").agg(F.min("known").alias("a"), F.max("known").alias("b")).where("a < b").select("cluster")
        across = known.join(apart, "cluster").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).where("other != part")
        across = across.select(F.concat_ws("-", "cluster", F.least("part", "other"), F.greatest("part", "other")).alias("block"), "node", "known", "shingles")
        second = settle(links(across))
        joined = components(first.unionByName(second))
    named = classes.select("set_key", "node").join(joined, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
