"""Density clustering on planted points; components on a path graph."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import density as D


def planted(spark):
    rng = np.random.default_rng(7)
    rows, i = [], 0
    for c, (cx, cy) in enumerate([(0, 0), (8, 0), (0, 8)]):
        for _ in range(40):
            rows.append((i, [cx + rng.normal(0, 0.4), cy + rng.normal(0, 0.4)], c))
            i += 1
    for x, y in [(40, 40), (-40, 30), (25, -45), (60, 0), (-30, -30)]:
        rows.append((i, [float(x), float(y)], -1))
        i += 1
    rows.append((i, [20.0, 20.0], 3))  # singleton far point
    return rows, spark.createDataFrame(rows, "id long, vec array<double>, truth int")


def test_planted_blobs_and_outliers(spark):
    rows, df = planted(spark)
    for br in (2048, 32):
        got = {r.id: r.cluster for r in D.density_cluster(df, 5, 1.5, 10, block_rows=br).collect()}
        pairs = Counter((t, got[i]) for i, _, t in rows)
        # each planted blob is one cluster, outliers and the singleton are noise
        blob_labels = {t: lab for (t, lab) in pairs if t >= 0 and t < 3}
        assert len(set(blob_labels.values())) == 3 and -1 not in blob_labels.values()
        assert pairs[(-1, -1)] == 5 and pairs[(3, -1)] == 1
        # labels numbered by size then smallest id: all blobs have 40 points
        assert sorted(blob_labels.values()) == [0, 1, 2]


def test_core_distance_counts_self(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0]), (2, [3.0])], "id long, vec array<double>")
    got = {r.id: r.core for r in D.core_distances(df, 2, 3).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 2.0}


def test_connected_components_path(spark):
    n = 30
    v = spark.createDataFrame([(i,) for i in range(n)] + [(100,)], "id long")
    e = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "src long, dst long")
    got = {r.id: r.root for r in D.connected_components(v, e).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[100] == 100


def test_connected_components_long_shuffled_paths_and_hub(spark):
    for n in (400, 2000, 10000):
        ids = [int(x) for x in np.random.default_rng(n).permutation(n)]
        e = spark.createDataFrame(list(zip(ids, ids[1:])), "src long, dst long")
        got = D.connected_components(spark.range(n), e).where("root <> 0").count()
        assert got == 0, n
    hub = spark.range(1, 5000).selectExpr("id AS src", "0L AS dst")
    extra = spark.createDataFrame([(6001, 6000), (6000, 6001), (7, 7), (None, 3)], "src long, dst long")
    got = {r.id: r.root for r in D.connected_components(spark.range(6005), hub.union(extra)).collect()}
    assert all(got[i] == 0 for i in range(5000)) and got[6001] == 6000 and got[6004] == 6004


def test_sweep_and_pareto(spark):
    from quarry.operators import sweep

    rows, df = planted(spark)
    ranges = {"min_cluster_size": (10, 20), "min_samples": (3, 6), "epsilon": (1.0, 2.0)}
    trials = sweep.param_sweep(df, n_trials=2, seed=1, ranges=ranges)
    got = trials.collect()
    assert len(got) == 2 and {r.state for r in got} <= {"COMPLETE", "PRUNED"}
    # three planted blobs are fewer than the 5-cluster minimum -> pruned
    assert all(r.state == "PRUNED" for r in got)
    assert sweep.best_trials(trials).count() == 0


def test_sweep_completes_on_six_blobs(spark):
    from quarry.operators import sweep

    rng = np.random.default_rng(11)
    rows, i = [], 0
    for cx, cy in [(0, 0), (10, 0), (0, 10), (10, 10), (20, 0), (0, 20)]:
        for _ in range(25):
            rows.append((i, [cx + rng.normal(0, 0.3), cy + rng.normal(0, 0.3)]))
            i += 1
    df = spark.createDataFrame(rows, "id long, vec array<double>")
    ranges = {"min_cluster_size": (10, 15), "min_samples": (3, 4), "epsilon": (1.5, 2.5)}
    trials_df = sweep.param_sweep(df, n_trials=2, seed=2, ranges=ranges)
    trials = trials_df.collect()
    assert all(t.state == "COMPLETE" for t in trials)
    assert all(t.ss > 0.8 and t.dbi < 0.3 and t.chi > 100 for t in trials)
    front = sweep.best_trials(trials_df).collect()
    assert front and sum(r.best for r in front) == 1


def test_fit_topics_and_audit(spark):
    from quarry.operators import topics

    rng = np.random.default_rng(5)
    rows, i = [], 0
    words = ["alpha", "bravo", "charlie"]
    for c, (cx, cy) in enumerate([(0, 0), (6, 0), (0, 6)]):
        for _ in range(30):
            v = [cx + rng.normal(0, 0.3), cy + rng.normal(0, 0.3), 0.0]
            txt = f"plastic {words[c]}word recycling {words[c]}item sorting"
            rows.append((i, txt, v))
            i += 1
    df = spark.createDataFrame(rows, "doc_id long, abstract string, embedding array<double>")
    info, terms, keywords = topics.fit_topics(df, min_samples=4, eps=0.3, min_cluster_size=10)
    got = info.collect()
    assert len(got) == 90 and len({r.topic for r in got if r.topic != -1}) == 3
    assert all(0 <= r.probability <= 1 for r in got)
    assert terms.count() > 0
    chosen = keywords.collect()
    assert {(r.topic, r.term) for r in chosen} <= {(r.topic, r.term) for r in terms.collect()}
    for t in {r.topic for r in chosen}:
        sims = [r.sim for r in sorted(chosen, key=lambda r: r["rank"]) if r.topic == t]
        assert 0 < len(sims) <= topics.KEYWORDS and sims == sorted(sims, reverse=True)
    audit = topics.similarity_audit(df.select(F.col("doc_id").alias("id"), "embedding"), k=3)
    assert audit["stats"].first().n == 270 and audit["smoothed"].count() == 100


def rows_of(kind):
    r = np.random.default_rng(6)
    x = r.normal(size=(1300, 5))
    if kind == "tight":  # clusters far narrower than a float32 of their distance
        x = r.normal(size=(4, 5))[r.integers(0, 4, 1300)] * 1e4 + x * 1e-4
    if kind == "copies":
        x[::3] = x[0]
        x[1::5] = x[r.integers(0, 1300, 260)]
        x[11] *= 1e6
    return x


def test_near_kernel_equals_brute_force():
    """Distances of the tiles that meet, with more rows than one matrix has."""
    import pandas as pd

    from quarry.operators import blocks

    for kind in ("even", "tight", "copies"):
        x = rows_of(kind)
        tiles = blocks.tiles_of(pd.DataFrame({"id": np.arange(1300), "vec": list(x)}), 700)
        tiles[0].at[5, "vec"] = np.array([np.nan] * 5)  # near to none
        out = D._near_kernel(4)(tiles, [(0, 0), (0, 1), (1, 1)])
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        d[5] = d[:, 5] = np.inf
        got = out.groupby("id")["d"].apply(lambda v: sorted(v)).to_dict()
        assert 5 not in got and len(got) == 1299
        for i, near in got.items():
            assert np.allclose(near, np.sort(d[i])[:4], rtol=1e-9, atol=0)


def test_forest_kernel_equals_brute_force():
    import pandas as pd

    from quarry.operators import blocks

    for kind, eps in (("even", 0.7), ("tight", 2e-4), ("copies", 0.0)):
        x = rows_of(kind)
        tiles = blocks.tiles_of(pd.DataFrame({"id": np.arange(1300), "vec": list(x)}), 700)
        out = D._forest_kernel(eps)(tiles, [(0, 0), (0, 1), (1, 1)])
        got, want = np.arange(1300), np.arange(1300)
        blocks.hook(got, out["src"].to_numpy(), out["dst"].to_numpy())
        near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
        blocks.hook(want, *np.nonzero(near))
        assert (got == want).all() and len(np.unique(want)) > 1


def test_near_kernel_measures_few_pairs_one_by_one(monkeypatch):
    import pandas as pd

    from quarry.operators import blocks

    seen, real = [], blocks.Close._squares
    monkeypatch.setattr(blocks.Close, "_squares", lambda self, i, j, x, y: seen.append(len(x)) or real(self, i, j, x, y))
    x = np.random.default_rng(1).normal(size=(4096, 16))
    tiles = blocks.tiles_of(pd.DataFrame({"id": np.arange(4096), "vec": list(x)}), 2048)
    D._near_kernel(4)(tiles, [(0, 0), (0, 1), (1, 1)])
    assert 4 * 4096 <= sum(seen) < 0.02 * 4096 * 4096
