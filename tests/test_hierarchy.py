"""Density hierarchy against a plain recursion over all thresholds."""

import numpy as np
import pytest

from quarry.operators import hierarchy as H


def brute(x, min_samples, m, eps=0.0):
    """Labels by taking the graph of all pairs apart, threshold by threshold."""
    n = len(x)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0))
    core = np.sort(d, axis=1)[:, min_samples - 1]
    w = np.maximum(np.round(np.maximum(d, np.maximum.outer(core, core)), 6), 1e-6)

    def parts(members, below):
        left, out = set(members), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                p = todo.pop()
                seen.add(p)
                near = {q for q in left if w[p, q] < below}
                left -= near
                todo += near
            out.append(sorted(seen))
        return out

    def least(members):  # the weight that holds them together
        lo = sorted({w[p, q] for p in members for q in members if p < q})
        for v in lo:
            if len(parts(members, v + 1e-9)) == 1:
                return v

    def cluster(members, birth):
        """(stability, birth, members, children)"""
        total, now = 0.0, members
        while True:
            v = least(now)
            big = [p for p in parts(now, v) if len(p) >= m]
            left = len(now) - (len(big[0]) if len(big) == 1 else 0)
            total += left * (1 / v - (1 / birth if birth else 0))
            if len(big) != 1:
                return [round(total, 6), birth, members, [cluster(p, v) for p in big]]
            now = big[0]

    def best(c, root=False):
        below = [best(k) for k in c[3]]
        s = sum(b[0] for b in below)
        if not root and (not below or c[0] >= s):
            return c[0], [c]
        return max(s, c[0]), [y for b in below for y in b[1]]

    if n < max(m, 2):
        return np.full(n, -1)
    top = cluster(list(range(n)), None)
    chosen = best(top, True)[1]
    up = {}

    def note(c):
        for k in c[3]:
            up[id(k)] = c
            note(k)

    note(top)
    final = {}
    for c in chosen:
        while c[1] < eps and up[id(c)] is not top:
            c = up[id(c)]
        final[id(c)] = c
    label = np.full(n, -1)
    for k, c in enumerate(sorted(final.values(), key=lambda c: (-len(c[2]), min(c[2])))):
        label[c[2]] = k
    return label


def blobs(seed, sizes, spread, far=8):
    r = np.random.default_rng(seed)
    centres = r.uniform(-10, 10, (len(sizes), 2))
    x = np.vstack([c + r.normal(scale=s, size=(n, 2)) for c, n, s in zip(centres, sizes, spread)] + [r.uniform(-30, 30, (far, 2))])
    return np.round(x, 3)


def run(spark, x, *args, **how):
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id long, vec array<double>").repartition(4)
    got = {r.id: r.cluster for r in H.hierarchy_cluster(df, *args, **how).collect()}
    return np.array([got[i] for i in range(len(x))])


@pytest.mark.parametrize("seed,m,eps,how", [
    (1, 6, 0.0, {}), (2, 5, 0.0, {"block_rows": 40, "problem_edges": 30}), (3, 4, 1.5, {})])
def test_labels_equal_plain_recursion(spark, seed, m, eps, how):
    x = blobs(seed, (20, 15, 25), (0.4, 0.3, 1.5))
    want = brute(x, 3, m, eps)
    assert (run(spark, x, 3, m, eps, **how) == want).all()
    assert want.max() >= 1 and (want == -1).any()


def test_ties_and_copies(spark):
    x = np.array([[i, 0] for i in range(12)] + [[i, 50] for i in range(12)] + [[0, 0]] * 6, float)
    assert (run(spark, x, 2, 4, problem_edges=10) == brute(x, 2, 4)).all()


def test_too_few_points(spark):
    assert (run(spark, np.array([[0.0, 0], [1, 1], [2, 2]]), 2, 5) == -1).all()


def test_merge_of_local_trees():
    r = np.random.default_rng(0)
    w = np.round(r.uniform(size=(30, 30)), 2)
    w = np.maximum(w, w.T)
    tree = H.prim(w, True)
    nodes, first = H.merges(np.arange(29), np.array([t[2] for t in tree]), np.array([t[0] for t in tree]),
                            np.array([t[1] for t in tree]), dict.fromkeys(range(30), 1))
    assert len(tree) == 29 and len(first) == 30
    assert max(n[2] for n in nodes) == 30 and sum(n[3] is None for n in nodes) == 1
    weight = {n[0]: n[1] for n in nodes}
    assert all(n[3] is None or weight[n[3]] > n[1] for n in nodes)


def spread(kind, n=1400, d=8):
    r = np.random.default_rng(9)
    if kind == "even":
        return r.normal(size=(n, d))
    x = r.normal(size=(6, d))[r.integers(0, 6, n)] * 20 + r.normal(scale=0.01, size=(n, d))
    x[100:400] = x[100]  # a fifth are equal
    x[7] += 5000.0       # and one lies far off
    return x


def tree_weights(u, v, w, n):
    least = H.light_forest(u, v, w, n)
    return np.sort(w[least])


@pytest.mark.parametrize("kind", ["even", "clusters"])
def test_pruned_edges_hold_a_spanning_tree_of_least_weight(spark, kind):
    x = spread(kind)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    core = np.sort(d, axis=1)[:, 3]
    dense = np.maximum(np.round(np.maximum(d, np.maximum.outer(core, core)), 6), 1e-6)
    want = np.sort([t[2] for t in H.prim(dense, True)])
    df = spark.createDataFrame([(i, v.tolist(), float(c)) for i, (v, c) in enumerate(zip(x, core))],
                               "id long, vec array<double>, core double")
    for rows in (700, 2048):
        e = H.pair_edges(df, len(x), rows).toPandas()
        assert len(e) < 8 * len(x)  # some edges of every block pair, never its pairs
        assert np.allclose(tree_weights(e["a"].to_numpy(), e["b"].to_numpy(), e["w"].to_numpy(), len(x)), want, atol=2e-6)


def test_heights_are_the_heaviest_edges_between():
    r = np.random.default_rng(2)
    n = 60
    u = np.arange(1, n)
    v = np.array([r.integers(0, k) for k in u])
    w = np.round(r.random(n - 1), 1)
    w[20:] += 1.0
    keep = u != 33  # two parts
    u, v, w = u[keep], v[keep], w[keep]
    way = np.full((n, n), np.inf)
    np.fill_diagonal(way, 0.0)
    way[u, v] = way[v, u] = w
    for k in range(n):
        way = np.minimum(way, np.maximum(way[:, k:k + 1], way[k:k + 1]))
    h = H.Heights(u, v, w, n)
    x, y = (c.ravel() for c in np.meshgrid(np.arange(n), np.arange(n)))
    assert (h.between(x, y) == way[x, y]).all()
    assert (np.maximum(h.to_first[x], h.to_first[y]) >= way[x, y]).all()
    assert (np.isfinite(h.to_first).sum()) == max(np.isfinite(way).sum(1))


def test_few_pairs_are_measured_one_by_one():
    """Of evenly spread points, the pairs that the tree so far leaves open are few."""
    r = np.random.default_rng(3)
    x = r.normal(size=(4096, 16))
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0))
    core = np.partition(d, 4, axis=1)[:, 4]
    vecs, cores = np.split(x, 8), np.split(core, 8)
    close = H.blocks.Close(vecs)
    seen = []
    close._squares, real = lambda i, j, a, b: seen.append(len(a)) or real(i, j, a, b), close._squares
    start = np.arange(0, 4097, 512)
    pairs = [(i, j) for i in range(8) for j in range(i, 8)]
    u, v, w = H.light_edges(close, cores, start, H._by_turns(pairs), H.hub_edges(vecs, cores))
    dense = np.maximum(np.round(np.maximum(d, np.maximum.outer(core, core)), 6), 1e-6)
    assert np.allclose(np.sort(w), np.sort([t[2] for t in H.prim(dense, True)]), atol=2e-6)
    assert sum(seen) < 0.03 * 4096 * 4095 / 2


def chain(n, seed):
    """A tree of clusters as deep as half its number, some branches apart."""
    r = np.random.default_rng(seed)
    rows, birth, top = [(0, None, None, 1.0, 10 * n)], {0: 1e9}, 0
    for k in range(1, n, 2):
        up = top if k % 10 else int(r.integers(0, k))  # as a rule below the last
        b = birth[up] * float(r.uniform(0.6, 0.99))
        for c in (k, k + 1):
            rows.append((c, up, b, round(float(r.uniform(0, 3)), 6), 10 * n - k))
            birth[c] = b
        top = k if k % 10 else top
    return rows


def chosen_of(rows, eps):
    up, birth = {r[0]: r[1] for r in rows}, {r[0]: r[2] for r in rows}
    stability = {r[0]: r[3] for r in rows}
    kids = {}
    for c, p in up.items():
        kids.setdefault(p, []).append(c)
    order = sorted(up, key=lambda c: -1 if birth[c] is None else 1 / birth[c])
    best, own = {}, {}
    for c in reversed(order):
        below = sum(best[k] for k in kids.get(c, []))
        own[c] = c not in kids or (stability[c] >= below and up[c] is not None)
        best[c] = stability[c] if c not in kids else max(stability[c], below)
    name = {}

    def descend(marked):
        for c in order:
            name[c] = None if up[c] is None else name[up[c]] if name[up[c]] is not None else c if marked(c) else None

    descend(lambda c: own[c])
    if eps > 0:
        tops = set()
        for c in [c for c in up if name[c] == c]:
            while birth[c] < eps and up[up[c]] is not None:
                c = up[c]
            tops.add(c)
        descend(lambda c: c in tops)
    return dict(name)


@pytest.mark.parametrize("eps,band", [(0.0, 1000), (0.0, 60), (1e6, 1000), (1e6, 60)])
def test_choice_takes_few_rounds_over_a_deep_tree(spark, monkeypatch, eps, band):
    rows = chain(301, 4)
    tables = []
    real = H.written_table
    monkeypatch.setattr(H, "written_table", lambda df: tables.append(1) or real(df))
    tree = spark.createDataFrame(rows, "cluster long, parent long, birth double, stability double, size long").repartition(3)
    got = {r.cluster: r.chosen for r in H.choose(tree, eps, band).collect()}
    assert got == chosen_of(rows, eps)
    assert len({c for c in got.values() if c is not None}) > 1
    assert len(tables) <= 1 + (4 if eps else 2) * -(-301 // band) + 4  # not two for each of 100 levels and more
