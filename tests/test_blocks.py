"""Wide blocks: copies a vector is shuffled in, and kernels over many tiles."""

import numpy as np
import pandas as pd
import pytest

from quarry.operators import blocks, density, hierarchy as H, quality

SCHEMA = "id long, embedding array<double>, cluster int"


def frame(spark, x, label):
    return spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label))], SCHEMA)


def test_copies_do_not_grow_with_small_blocks():
    assert blocks.wide_blocks(100_000) == blocks.wide_blocks(1_000_000) == blocks.MIN_BLOCKS
    assert blocks.wide_blocks(3_000_000) == 23 and blocks.wide_blocks(2000) == 1


@pytest.mark.parametrize("decimals", [None, 6])
def test_best_over_tiles_equals_a_sort(decimals):
    rng = np.random.default_rng(3)
    score = np.round(rng.normal(size=(30, 90)), 1)  # many ties
    score[4, :80] = np.nan
    ids = rng.permutation(90)
    best = blocks.Best([np.arange(30)], 5, decimals)
    for at in range(0, 90, 9):
        best.offer(0, score[:, at:at + 9], ids[at:at + 9])
    row, partner, value = best.rows()
    for r in range(30):
        known = [(-score[r, c], ids[c]) for c in range(90) if np.isfinite(score[r, c])]
        got = list(zip(-value[row == r], partner[row == r]))
        want = sorted(known)[:5]
        assert [g[0] for g in got] == [w[0] for w in want]
        if decimals is not None:
            assert got == want


def test_silhouette_over_tiles(spark):
    rng = np.random.default_rng(4)
    x, label = rng.normal(size=(90, 3)), rng.integers(0, 4, 90)
    df = frame(spark, x, label)
    d = np.linalg.norm(x[:, None] - x[None, :], axis=2)
    s = []
    for i, own in enumerate(label):
        a = d[i, label == own].sum() / ((label == own).sum() - 1)
        b = min(d[i, label == c].mean() for c in set(label) - {own})
        s.append((b - a) / max(a, b))
    for rows in (7, 2048):
        assert quality.silhouette(df, block_rows=rows).first()[0] == pytest.approx(np.mean(s), abs=2e-6)


def test_light_forest_has_the_least_weight():
    rng = np.random.default_rng(5)
    u, v = np.triu_indices(25, 1)
    w = np.round(rng.random(len(u)), 1)
    dense = np.zeros((25, 25))
    dense[u, v] = dense[v, u] = w
    got = H.light_forest(u, v, w, 25)
    assert len(got) == 24
    assert w[got].sum() == pytest.approx(sum(e[2] for e in H.prim(dense, True)))


def test_forest_within_eps(spark):
    x = np.arange(40)[:, None] * 1.0
    x[25:] += 5
    pts = frame(spark, x, np.zeros(40)).withColumnRenamed("embedding", "vec").selectExpr("id", "vec", "0.0D as core")
    edges = [(r.src, r.dst) for r in density.eps_forest(pts, 1.0, cell_rows=6, block_rows=8).collect()]
    part = list(range(40))
    for _ in range(40):
        for a, b in edges:
            part[a] = part[b] = min(part[a], part[b])
    assert part == [0] * 25 + [25] * 15


def test_fine_tiles_keep_every_pair_of_rows_once():
    frames = [pd.DataFrame({"id": np.arange(at, at + n)}) for at, n in ((0, 9), (20, 4), (40, 7))]
    for pairs in ([(0, 1), (2, 1)], [(0, 0), (0, 1), (1, 1)]):
        tiles, cut = blocks.fine(frames, pairs, 4)
        assert max(len(t) for t in tiles) <= 4
        want = {(a, b) for i, j in pairs for a in frames[i]["id"] for b in frames[j]["id"]}
        got = [(a, b) for x, y in cut for a in tiles[x]["id"] for b in tiles[y]["id"]]
        assert len(got) == len(set(got)) and set(got) <= want
        assert {frozenset(p) for p in got} == {frozenset(p) for p in want}


def test_silhouette_over_many_labels(spark):
    """More labels than a tile sums one by one, and fewer."""
    rng = np.random.default_rng(6)
    x, label = rng.normal(size=(240, 3)), rng.integers(0, 90, 240)
    df = frame(spark, x, label)
    d = np.linalg.norm(x[:, None] - x[None, :], axis=2)
    s = []
    for i, own in enumerate(label):
        n = (label == own).sum()
        a = d[i, label == own].sum() / max(n - 1, 1)
        b = min(d[i, label == c].mean() for c in set(label) - {own})
        s.append((b - a) / max(a, b) if n > 1 else 0.0)
    assert quality.silhouette(df).first()[0] == pytest.approx(np.mean(s), abs=2e-6)
    assert quality.silhouette(df, block_rows=64).first()[0] == pytest.approx(np.mean(s), abs=2e-6)
