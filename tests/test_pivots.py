"""Pruned nearest neighbours: the rows of the all-pairs operators and of
NumPy brute force, on clustered, uniform, tied and degenerate vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import blocks, density, pivots, similarity as S
from test_similarity import brute_topk

SCHEMA = "id long, embedding array<double>"


def clustered(n=600, d=6, groups=12, seed=5):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, d))[rng.integers(0, groups, n)] * 4 + rng.normal(size=(n, d)) * 0.05


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA)


def found(df):
    out = {}
    for r in df.orderBy("doc_id", "rank").collect():
        out.setdefault(r.doc_id, []).append((r.nbr_id, r.sim))
    return out


def uniform(n=200, d=4):
    return np.random.default_rng(8).normal(size=(n, d))


def with_copies_and_zeros():
    x = clustered(300)
    x[50:150] = x[50]  # a third are equal
    x[200:204] = 0.0
    x[210] *= 1e-12    # the guard in the denominator counts here
    return x


@pytest.mark.parametrize("make", [clustered, uniform, with_copies_and_zeros])
def test_top_k_equals_brute_force(spark, make):
    x = make()
    got = found(S.top_k_pruned(frame(spark, x), k=5, cell_rows=30, block_rows=40))
    assert got == brute_topk(x, 5)


def test_few_rows_nulls_and_empty(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (None, [1.0, 1.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0])]
    got = found(S.top_k_pruned(spark.createDataFrame(rows, SCHEMA), k=5))
    assert got == {1: [(2, 0.0)], 2: [(1, 0.0)]}
    assert S.top_k_pruned(spark.createDataFrame([], SCHEMA), k=5).collect() == []


def test_distances_equal_the_all_pairs_operator(spark):
    for x in (clustered(400), uniform(), with_copies_and_zeros()):
        pts = frame(spark, x).withColumnRenamed("embedding", "vec")
        want = {r.id: r.near for r in density.nearest_distances(pts, 4, len(x)).collect()}
        got = {r.id: r.near for r in density.nearest_distances_pruned(pts, 4, cell_rows=30, block_rows=40).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[i], want[i], atol=1e-6) for i in want)


def test_clusters_close_most_pairs(spark):
    """Copies a vector is shuffled in, against the all-pairs layout."""
    x = clustered(1200)
    src = pivots.usable(frame(spark, x), "id", "embedding")

    seen = {}

    def watch(df, search, *args):
        rows, cells, piv = pivots.in_cells(df, search, 40, pivots.MAX_PIVOTS, 60)
        pairs = pivots.open_pairs(pivots.search_chunks(rows, cells, piv, search), cells)
        seen["copies"] = pivots.copies(rows, pairs).count() / len(x)
        seen["chunks"] = cells.agg(F.sum("parts")).first()[0]
        return real(df, search, 40, pivots.MAX_PIVOTS, 60)

    real = pivots.nearest
    pivots.nearest = watch
    try:
        got = found(S.top_k_pruned(frame(spark, x), k=5))
    finally:
        pivots.nearest = real
    assert src.count() == 1200 and got == brute_topk(x, 5)
    assert seen["copies"] < 0.5 * blocks.n_blocks(1200, 60) <= seen["chunks"]


def test_a_hot_cell_is_dealt_into_chunks(spark):
    x = np.vstack([np.tile([[1.0, 2.0]], (300, 1)), uniform(60, 2)])
    search = pivots.Search(3, None, "", lambda v: v, None)
    rows, cells, _ = pivots.in_cells(pivots.usable(frame(spark, x), "id", "embedding"), search, 30, 8, 50)
    sizes = [r["count"] for r in rows.groupBy("chunk").count().collect()]
    assert sum(sizes) == 360 and max(sizes) < 110


def test_near_vectors_share_a_chunk_of_a_large_cell(spark):
    """With their nearest in their own chunk, vectors open few others."""
    r = np.random.default_rng(4)
    x = np.repeat(uniform(400, 12), 5, axis=0) + r.normal(scale=1e-7, size=(2000, 12))
    src = pivots.usable(frame(spark, x), "id", "embedding")
    seen = {}

    def watch(df, search, *args):
        rows, cells, piv = pivots.in_cells(df, search, 500, pivots.MAX_PIVOTS, 100)
        seen["open"] = pivots.open_pairs(pivots.search_chunks(rows, cells, piv, search), cells).count()
        seen["chunks"] = cells.agg(F.sum("parts")).first()[0]
        return real(df, search, 500, pivots.MAX_PIVOTS, 100)

    real = pivots.nearest
    pivots.nearest = watch
    try:
        got = {q.id: q.near for q in density.nearest_distances_pruned(src.withColumnRenamed("embedding", "vec"), 4).collect()}
    finally:
        pivots.nearest = real
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert all(np.allclose(got[i], np.sort(d[i])[:4], rtol=1e-9, atol=0) for i in range(2000))
    assert seen["chunks"] >= 20 and seen["open"] < 0.5 * seen["chunks"] * (seen["chunks"] - 1) / 2
