"""Pruned vector search against all pairs."""

import numpy as np
import pytest

from attestry.operators import cells, vector


def frames(spark, m, ids=None):
    rows = [(int(i), [float(x) for x in row]) for i, row in zip(ids if ids is not None else range(len(m)), m)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    return v.withColumnRenamed("chunk_id", "query_id"), v


@pytest.mark.parametrize("seed,spread", [(1, .05), (2, .4), (3, 10.0)])
def test_pruned_equals_brute_force(spark, seed, spread):
    """Clustered and shapeless vectors, equal ones, opposite ones and zero vectors."""
    r = np.random.default_rng(seed)
    m = r.normal(size=(12, 8))[r.integers(0, 12, 400)] + spread * r.normal(size=(400, 8))
    m = np.vstack([m, m[:10], -m[:5], np.zeros((2, 8))])
    q, v = frames(spark, m)
    index = cells.build_cells(v, block=50)
    for own in (False, True):
        rows = lambda df: sorted((x.query_id, x.rank, x.chunk_id, x.score) for x in df.collect())
        assert rows(cells.pruned_topk(q, index, 6, own)) == rows(vector.vector_topk(q, v, 6, exclude_self=own))


def test_clusters_are_skipped_and_reported(spark):
    r = np.random.default_rng(5)
    m = np.repeat(np.eye(16), 40, axis=0) + .02 * r.normal(size=(640, 16))
    q, v = frames(spark, m)
    got = cells.pruning_report(q, v, 10).first()
    assert got.share_skipped > .7 and got.scanned < got.pairs == 640 * len(cells.build_cells(v).radius)


def test_few_vectors_and_none(spark):
    q, v = frames(spark, np.array([[1.0, 0.0], [0.0, 2.0]]))
    assert cells.pruned_topk(q, v, 5).count() == 4
    assert cells.pruned_topk(q, v.limit(0), 5).count() == 0
    assert cells.pruned_topk(q.limit(0), v, 5).count() == 0


def test_a_query_goes_to_a_bin_once(spark):
    """Where no cell can be skipped, the rows that are sent are queries times bins, not queries times cells."""
    m = np.random.default_rng(7).normal(size=(300, 24))
    q, v = frames(spark, m)
    index = cells.build_cells(v, pivots=20, block=100)
    n_bins = 1 + max(b[-1] for b in index.bins.values())
    assert len(index.radius) == 20 and n_bins <= 6
    found = cells.pruned_topk(q, index, 5).collect()
    rows = lambda df: sorted((x.query_id, x.rank, x.chunk_id, x.score) for x in df)
    assert rows(found) == rows(vector.vector_topk(q, v, 5).collect())
    assert cells.pruning_report(q, index, 5).first().pairs == 300 * 20
    parts = cells._score(cells._bounds(q.withColumnRenamed("embedding", "_qe"), index, 5), index, 5, 1, True)
    assert parts.groupBy("query_id").count().agg({"count": "max"}).first()[0] <= 5 * n_bins
