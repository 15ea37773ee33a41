"""Hard negatives against all inner products."""

import math

import duckdb
import numpy as np
import pytest

from quarry.llm import hard_negatives as H
from quarry.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, n_pos=5, n_neg=10, low=30, high=90):
    rows = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows
            if i is not None and label is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a in {(i, label, tuple(v)) for i, label, v in rows if i % every == 0}:
        score = [(-sum(x * y for x, y in zip(a[2], v)), i, label) for i, label, v in rows if i != a[0]]
        for p in sorted(s for s in score if s[2] == a[1])[:n_pos]:
            ps = -p[0]
            negs = sorted(s for s in score if s[2] != a[1] and low * ps <= -100 * s[0] <= high * ps)[:n_neg]
            out += [(a[0], p[1], k + 1, n[1], ps, -n[0]) for k, n in enumerate(negs)]
    return sorted(out)


def clustered(n, d, groups, seed, spread=0.15):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, d))
    v = centres[r.integers(0, groups, n)] + r.normal(size=(n, d)) * spread
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(int(i), [float(x) for x in v[i].astype(np.float32)], int(r.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 40, "anchor_block": 7}, {"degree": 3, "leaf_sample": 10},
                                     {"sample": 20, "leaf_sample": 4}])
def test_equals_all_products(spark, options):
    rows = clustered(700, 12, 9, 3)
    rows += [(1000 + i, rows[0][1], 1) for i in range(60)]  # equal vectors: ties by id
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    options = {"leaf_sample": 24, "degree": 6} | options
    from pyspark.sql import functions as F

    got = sorted(map(tuple, H.mine(df, F.col("vec_id") % 20 == 0, **options).collect()))
    assert got == brute(rows, 20) and len(got) > 500


def test_ranges_eliminate_and_lose_nothing(spark):
    """Bounds hold for every pair, and far leaves of clustered data are skipped."""
    rows = clustered(3000, 8, 20, 4, 0.03)
    x = np.floor(256 * np.array([v for _, v, _ in rows], np.float32).astype(float))
    df = spark.createDataFrame([(i, label, [int(y) for y in x[i]]) for i, _, label in rows], "id long, label long, vec array<int>")
    index = H.build(df, degree=8, leaf_sample=100)
    leaf = H.leaf_of(index.tree, x)
    assert sorted((r.id, r.leaf) for r in index.rows.collect()) == list(enumerate(leaf.tolist()))
    a, s = x[:50], x[:50] @ x.T
    best = np.sort(s, axis=1)[:, -6:-5]
    for lo, hi in ((best, np.full_like(best, np.inf)), (0.3 * best, 0.5 * best)):
        row, at = H.reachable(index.tree, a, lo, hi)
        open_ = set(zip(row.tolist(), at.tolist()))
        for i, j in zip(*np.nonzero((s >= lo) & (s <= hi))):
            assert (i, leaf[j]) in open_
        assert len(open_) < 0.6 * 50 * index.tree.leaves


def test_edges(spark):
    from pyspark.sql import functions as F

    every = F.col("vec_id") % 100 == 0
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (100, [1.0, 0.5], 1), (200, [0.0, 0.0], 1), (300, [-1.0, -0.5], 2),
            (1, [0.9, 0.4], 1), (2, [0.4, 0.2], 2), (2, [0.4, 0.2], 2), (3, [0.5, 0.1, 0.7], 3), (4, [0.3], 2), (5, [], 2),
            (6, None, 1), (7, [1.0, None], 2), (8, [nan, 1.0], 2), (9, [inf, 0.0], 2), (None, [0.5, 0.2], 2), (10, [0.4, 0.2], None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "a", "p", "leaf", "score", "rank", "vec")})
    got = sorted(map(tuple, H.mine(df, every).collect()))
    assert got == brute(rows, 100) and len(got) > 10
    assert H.mine(df.limit(0), every).collect() == []
    assert H.mine(df, F.lit(False)).collect() == []
    assert H.mine(df.where("vec_id = 0"), every).collect() == []
    with pytest.raises(Exception, match="2\\^53"):
        big = spark.createDataFrame([(0, [2.0 ** 22], 1), (1, [2.0 ** 22], 1)], SCHEMA)
        H.mine(big, every).collect()


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(H.sql()).fetchall()
    assert sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, sf).collect())) == sorted(want)
    assert len(want) > 100
