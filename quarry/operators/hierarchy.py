"""Density hierarchy (M4): mutual-reachability spanning tree, merge tree,
condensed tree and the clusters of largest stability.

*Spanning tree.*  A task keeps the spanning tree of the edges of its two blocks
(weight ``max(core x, core y, d(x, y))``), to which only those pairs of rows
come that are lighter than the way between them so far; the spanning tree of everything is
one of the union of these, which Boruvka rounds over that edge list find: each
component's lightest edge by a map-side combined minimum, then components by
large-star/small-star.  No distance leaves a task otherwise.

*Merge tree.*  Edges of equal weight merge at once.  A problem (edges and
weighted vertices) of more than ``problem_edges`` edges is cut at its median
weight: components of the lighter edges are problems of their own and single
vertices of the heavier rest, so every round halves the largest problem and
small ones are solved in a task each.  A merge is named by its smallest edge.

*Condensed tree.*  Merges of ``min_cluster_size`` points or more are big.  A
merge of two or more big parts is a split, whose big parts begin clusters; a
chain of merges without a split is one cluster.  Its stability is the sum over
its merges of the points that leave there, times ``1/w`` less ``1/w`` at its
birth.  A cluster is chosen if it is at least as stable as the best choice
below it, the whole is not; clusters born below ``eps`` climb to the ancestor
born above it.  Points of no chosen cluster are noise (-1).

Every table between the steps is written to the shared checkpoint folder.
Weights are rounded to six decimals and at least 1e-6, so that ties and
labels do not hang on the order of additions.  Labels are numbered by size
(descending), then smallest member.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import blocks
from quarry.operators.components import connected_components, star_forest
from quarry.operators.density import NOISE, core_distances
from quarry.operators.pivots import distances
from quarry.operators.records import dense_index
from quarry.session import written_table

DECIMALS = 6
PROBLEM_EDGES = 50_000
HUB_ROWS = 256  # rows that connect a task's others at first
FOLD_EDGES = 1_000_000  # edges of tiles that a task gathers before it folds them
BAND_CLUSTERS = 200_000  # clusters of a band, which a task takes as a whole
SAFETY_ROUNDS = 200
ROUND_SHIFT = 55  # names of vertices made in a round begin here


# -- spanning tree --------------------------------------------------------------

def prim(weights: np.ndarray, same: bool) -> list[tuple[int, int, float]]:
    """Spanning tree of a dense graph, or of the complete bipartite graph of
    ``weights`` (rows are nodes 0 to na - 1, columns the ones after them)."""
    na, nb = weights.shape
    n = na if same else na + nb
    if na == 0 or nb == 0:
        return []
    best, source, out = np.full(n, np.inf), np.zeros(n, np.int64), []
    outside = np.ones(n, bool)
    node = 0
    for _ in range(n - 1):
        outside[node] = False
        if same:
            span, w = slice(0, n), weights[node]
        elif node < na:
            span, w = slice(na, n), weights[node]
        else:
            span, w = slice(0, na), weights[:, node - na]
        closer = w < best[span]
        best[span] = np.where(closer, w, best[span])
        source[span] = np.where(closer, node, source[span])
        node = int(np.where(outside, best, np.inf).argmin())
        out.append((int(source[node]), node, float(best[node])))
    return out


def rounded(w: np.ndarray) -> np.ndarray:
    return np.maximum(np.round(w, DECIMALS), 10.0 ** -DECIMALS)


def hub_edges(vecs: list[np.ndarray], cores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, w): edges that connect all rows of the tiles: a spanning tree of
    ``HUB_ROWS`` of them (of all, if there are no more), and every other row's
    lightest edge to one of these."""
    rows, core = np.concatenate(vecs), np.concatenate(cores)
    hub = np.unique(np.linspace(0, len(rows) - 1, min(HUB_ROWS, len(rows))).astype(np.int64))
    near = rounded(np.maximum(distances(rows[hub], rows[hub]), np.maximum.outer(core[hub], core[hub])))
    tree = prim(near, True)
    u, v, w = (np.array(c) for c in zip(*tree)) if tree else (np.zeros(0, np.int64),) * 3
    out = [(hub[u], hub[v], w.astype(float))]
    rest = np.setdiff1d(np.arange(len(rows)), hub)
    for at in range(0, len(rest), blocks.DEFAULT_BLOCK_ROWS):
        x = rest[at:at + blocks.DEFAULT_BLOCK_ROWS]
        w = np.maximum(distances(rows[x], rows[hub]), np.maximum.outer(core[x], core[hub]))
        y = w.argmin(1)
        out.append((x, hub[y], rounded(w[np.arange(len(x)), y])))
    return tuple(np.concatenate(c) for c in zip(*out))


class Heights:
    """How light the way between two nodes of a forest is: its heaviest edge.

    Joining the lightest edges first, the nodes are laid in a row, a joined part
    behind the larger one; the heaviest edge between two nodes is then the
    greatest height between their places."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int):
        root, last, size, after, height = list(range(n)), list(range(n)), [1] * n, [-1] * n, [np.inf] * n
        order = np.argsort(w, kind="stable")
        for a, b, h in zip(u[order].tolist(), v[order].tolist(), w[order].tolist()):
            while root[a] != a:
                root[a] = a = root[root[a]]
            while root[b] != b:
                root[b] = b = root[root[b]]
            if a == b:
                continue
            if size[a] < size[b]:
                a, b = b, a
            after[last[a]], height[b] = b, h
            last[a], root[b], size[a] = last[b], a, size[a] + size[b]
        row = []
        tops = sorted((a for a in range(n) if root[a] == a), key=lambda a: -size[a])
        for a in tops:  # a part's first node is its root
            while a >= 0:
                row.append(a)
                a = after[a]
        self.place = np.empty(n, np.int64)
        self.place[row] = np.arange(n)
        self.tables = [np.array(height)[row]]  # greatest of 1, 2, 4 ... heights from a place on
        step = 1
        while len(self.tables[-1]) > step:
            self.tables.append(np.maximum(self.tables[-1][:-step], self.tables[-1][step:]))
            step *= 2
        # to the first node of the largest part; a way between two nodes is no heavier than their ways there
        self.to_first = np.maximum.accumulate(np.concatenate(([0.0], self.tables[0][1:])))[self.place] if n else np.zeros(0)

    def between(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The heaviest edge on the way from each of ``x`` to that of ``y``."""
        lo = np.minimum(self.place[x], self.place[y]) + 1
        span = np.maximum(self.place[x], self.place[y]) + 1 - lo
        out = np.zeros(len(lo))
        for k, table in enumerate(self.tables):
            at = np.flatnonzero((span >> k) == 1)
            if len(at):
                out[at] = np.maximum(table[lo[at]], table[lo[at] + span[at] - (1 << k)])
        return out


def _by_turns(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The pairs in growing lots, of which each takes every tile about as often."""
    left, right = (sorted({p[k] for p in pairs}) for k in (0, 1))
    at = [{t: k for k, t in enumerate(side)} for side in (left, right)]
    n = max(len(left), len(right), 1)
    order = sorted(pairs, key=lambda p: ((at[1][p[1]] - at[0][p[0]]) % n, p))
    lots, upto, size = [], 0, n
    while upto < len(order):
        lots.append(order[upto:upto + size])
        upto, size = upto + size, size * 3
    return lots


def light_edges(close: blocks.Close, cores: list[np.ndarray], start: np.ndarray, lots: list[list[tuple[int, int]]], kept):
    """(u, v, w): the spanning tree of least weight of ``kept``, which connects
    all rows of the tiles, and of the lots' pairs of tiles.  A pair of rows counts
    only if it is lighter than the way between them that is known so far."""
    n = int(start[-1])
    new, size = [kept], len(kept[0])

    def fold():
        u, v, w = (np.concatenate(c) for c in zip(*new))
        least = light_forest(u, v, w, n)
        return [(u[least], v[least], w[least])]

    def limits():
        heights = Heights(*new[0], n)
        reach = np.split(heights.to_first, start[1:-1])
        return heights, [close.limit((r + 2 * 10.0 ** -DECIMALS) ** 2) for r in reach]

    for lot in lots:
        new, size = fold(), 0
        heights, limit = limits()
        for i, j in lot:
            near = close.bound(i, j)
            light = near >= limit[i][:, None]
            light |= near >= limit[j][None, :]
            x, y = blocks.cells(np.triu(light, 1) if i == j else light)
            if len(x) == 0:
                continue
            way = heights.between(x + start[i], y + start[j])
            core = np.maximum(cores[i][x], cores[j][y])
            good = (core < way + 10.0 ** -DECIMALS) & (near[x, y] >= close.limit((way + 2 * 10.0 ** -DECIMALS) ** 2))
            x, y, way, core = x[good], y[good], way[good], core[good]
            at, square = close.within(i, j, x, y, (way + 10.0 ** -DECIMALS) ** 2)
            w = rounded(np.maximum(np.sqrt(square), core[at]))
            light = w < way[at]
            at = at[light]
            if len(at):
                new.append((x[at] + start[i], y[at] + start[j], w[light]))
                size += len(at)
            if size > FOLD_EDGES:
                new, size = fold(), 0
                heights, limit = limits()
    return fold()[0]


def pair_edges(points: DataFrame, n_rows: int, block_rows: int = blocks.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(a, b, w): the spanning trees of all block pairs of ``points`` (id, vec,
    core; no null core)."""

    def kernel(tiles: list[pd.DataFrame], pairs: list[tuple[int, int]]) -> pd.DataFrame:
        tiles, pairs = blocks.fine(tiles, pairs)
        ids = np.concatenate([t["id"].to_numpy(np.int64) for t in tiles] or [np.zeros(0, np.int64)])
        start = np.cumsum([0] + [len(t) for t in tiles])
        cores = [t["core"].to_numpy(np.float64) for t in tiles]
        close = blocks.Close([blocks.matrix(t["vec"]) for t in tiles])
        kept = hub_edges(close.vecs, cores)
        if len(ids) > HUB_ROWS:
            kept = light_edges(close, cores, start, _by_turns(pairs), kept)
        x, y, w = (ids[kept[0]], ids[kept[1]], kept[2])
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "w": w})

    return blocks.run_pairs(points.select("id", "vec", "core"), "id", n_rows, kernel, "a long, b long, w double", block_rows)


def light_forest(u: np.ndarray, v: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Positions of the edges of a spanning forest of least weight over nodes
    0 to n - 1, by Boruvka rounds; ties by position."""
    order = np.argsort(w, kind="stable")
    labels, taken = np.arange(n), []
    while True:
        a, b = labels[u[order]], labels[v[order]]
        apart = a != b
        order, a, b = order[apart], a[apart], b[apart]
        if len(order) == 0:
            return np.concatenate(taken) if taken else np.zeros(0, np.int64)
        least = np.full(n, len(order))
        np.minimum.at(least, a, np.arange(len(order)))
        np.minimum.at(least, b, np.arange(len(order)))
        light = order[np.unique(least[least < len(order)])]
        taken.append(light)
        blocks.hook(labels, u[light], v[light])


def spanning_tree(edges: DataFrame) -> DataFrame:
    """(a, b, w): the spanning forest of least weight of an edge list, by
    Boruvka rounds; ties by (a, b)."""
    cur = written_table(edges.where("a <> b").select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    taken = None
    for _ in range(SAFETY_ROUNDS):
        each = cur.select(F.col("ca").alias("c"), F.struct("w", "a", "b", "ca", "cb").alias("e")).union(
            cur.select(F.col("cb").alias("c"), F.struct("w", "a", "b", "ca", "cb").alias("e")))
        light = written_table(each.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        if light.isEmpty():
            return taken if taken is not None else light.select("a", "b", "w")
        taken = light.select("a", "b", "w") if taken is None else written_table(
            taken.unionByName(light.select("a", "b", "w")))
        merged = star_forest(light.select(F.col("ca").alias("src"), F.col("cb").alias("dst")))
        for c in ("ca", "cb"):
            cur = cur.join(merged.select(F.col("id").alias(c), F.col("root").alias("__r")), c, "left").withColumn(
                c, F.coalesce("__r", c)).drop("__r")
        cur = written_table(cur.where("ca <> cb"))
    raise RuntimeError(f"spanning tree not finished after {SAFETY_ROUNDS} rounds")


# -- merge tree -------------------------------------------------------------------

def merges(edges: np.ndarray, weights: np.ndarray, u: np.ndarray, v: np.ndarray, size: dict[int, int]):
    """Merges of one problem: ([(node, weight, size, parent or None)],
    {vertex: its first merge})."""
    root = {x: x for x in size}
    node_of: dict[int, int] = {}  # of a component's root, its last merge
    nodes: dict[int, list] = {}
    first: dict[int, int] = {}
    total = dict(size)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = np.lexsort((edges, weights))
    at = 0
    while at < len(order):
        upto = at
        while upto < len(order) and weights[order[upto]] == weights[order[at]]:
            upto += 1
        parts: dict[int, tuple[set, int]] = {}  # by root so far: the components that merge, the smallest edge
        for k in order[at:upto].tolist():
            x, y = find(int(u[k])), find(int(v[k]))
            if x == y:
                continue
            px, py = (parts.pop(z, ({z}, int(edges[k]))) for z in (x, y))
            root[y] = x
            total[x] += total.pop(y)
            parts[x] = (px[0] | py[0], min(px[1], py[1], int(edges[k])))
        for top, (members, name) in parts.items():
            nodes[name] = [float(weights[order[at]]), total[top], None]
            for m in members:
                if m in node_of:
                    nodes[node_of.pop(m)][2] = name
                else:
                    first[m] = name
            node_of[top] = name
        at = upto
    return [(k, *x) for k, x in nodes.items()], first


SOLVED = "g long, node long, w double, size long, parent long, vertex long"


def _solve(key, edges: pd.DataFrame, vertices: pd.DataFrame) -> pd.DataFrame:
    sizes = dict(zip(vertices["u"].tolist(), vertices["size"].tolist()))
    nodes, first = merges(edges["e"].to_numpy(), edges["w"].to_numpy(), edges["u"].to_numpy(), edges["v"].to_numpy(), sizes)
    rows = [(key[0], *n, None) for n in nodes] + [(key[0], n, None, None, None, x) for x, n in first.items()]
    # names are longs beyond 2^53: a column with gaps must not turn to floats on the way
    return pd.DataFrame({c: pd.array(list(x), dtype="float64" if c == "w" else "Int64")
                         for c, x in zip(("g", "node", "w", "size", "parent", "vertex"), zip(*rows))})


def merge_tree(ids: DataFrame, tree: DataFrame, problem_edges: int = PROBLEM_EDGES) -> tuple[DataFrame, DataFrame]:
    """(node, w, size, parent) of every merge of a spanning tree over ``ids``
    (id), and (id, node): every point's first merge."""
    e = written_table(tree.select(F.lit(-1).cast("long").alias("g"), F.monotonically_increasing_id().alias("e"), "w",
                                        F.col("a").alias("u"), F.col("b").alias("v")))
    v = ids.select(F.lit(-1).cast("long").alias("g"), F.col("id").alias("u"), F.lit(1).cast("long").alias("size"))
    solved = []
    for r in range(1, SAFETY_ROUNDS):
        sizes = e.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi"),
                                   F.percentile_approx("w", 0.5, 1000).alias("mid"))
        sizes = written_table(sizes)
        large = sizes.where(F.col("n") > problem_edges)
        now, flat, cut = sizes.where(F.col("n") <= problem_edges).select("g"), large.where("lo = hi"), large.where("lo < hi")
        solved.append(written_table(
            e.join(now, "g").groupBy("g").cogroup(v.join(now, "g").groupBy("g")).applyInPandas(_solve, SOLVED)))
        if large.isEmpty():
            break
        # all edges alike: one merge
        one = e.join(flat.select("g"), "g").groupBy("g").agg(F.min("e").alias("node"), F.min("w").alias("w"))
        own = v.join(one, "g")
        solved.append(written_table(
            own.groupBy("g", "node", "w").agg(F.sum("size").alias("size")).select(
                "g", "node", "w", "size", F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("vertex"))
            .unionByName(own.select("g", "node", F.lit(None).cast("double").alias("w"), F.lit(None).cast("long").alias("size"),
                                    F.lit(None).cast("long").alias("parent"), F.col("u").alias("vertex")))))
        if cut.isEmpty():
            break
        split = e.join(cut.select("g", "mid", "hi"), "g").withColumn(
            "light", F.when(F.col("mid") < F.col("hi"), F.col("w") <= F.col("mid")).otherwise(F.col("w") < F.col("hi")))
        split = written_table(split.drop("mid", "hi"))
        forest = written_table(star_forest(split.where("light").select(F.col("u").alias("src"), F.col("v").alias("dst"))))
        names = written_table(forest.select("root").distinct().withColumn(
            "key", F.lit(r << ROUND_SHIFT).cast("long") + F.monotonically_increasing_id()))
        member = written_table(forest.join(names, "root").select(F.col("id").alias("u"), "key").unionByName(
            names.select(F.col("root").alias("u"), "key")))
        vs = v.join(cut.select("g"), "g").join(member, "u", "left")
        inside = vs.where("key IS NOT NULL")
        v = written_table(
            inside.select(F.col("key").alias("g"), "u", "size")
            .unionByName(inside.groupBy("g", "key").agg(F.sum("size").alias("size")).select("g", F.col("key").alias("u"), "size"))
            .unionByName(vs.where("key IS NULL").select("g", "u", "size")))
        light = split.where("light").join(member, "u").select(F.col("key").alias("g"), "e", "w", "u", "v")
        heavy = split.where("NOT light")
        for c in ("u", "v"):
            heavy = heavy.join(member.withColumnRenamed("u", c), c, "left").withColumn(c, F.coalesce("key", c)).drop("key")
        e = written_table(light.unionByName(heavy.select("g", "e", "w", "u", "v")))
    every = solved[0]
    for more in solved[1:]:
        every = every.unionByName(more)
    first = every.where("vertex IS NOT NULL").select("vertex", F.col("node").alias("up"))
    nodes = every.where("vertex IS NULL").select("g", "node", "w", "size", "parent")
    # the last merge of a problem hangs under its vertex' first merge in the problem above
    under = first.select(F.col("vertex").alias("last"), "up")
    hung = nodes.withColumn("last", F.when(F.col("parent").isNull(), F.col("g"))).join(under, "last", "left").select(
        "node", "w", "size", F.coalesce("parent", "up").alias("parent"))
    points = first.join(ids.select(F.col("id").alias("vertex")), "vertex", "left_semi").select(
        F.col("vertex").alias("id"), F.col("up").alias("node"))
    return written_table(hung), written_table(points)


# -- condensed tree -----------------------------------------------------------------

def condensed(nodes: DataFrame, min_cluster_size: int) -> tuple[DataFrame, DataFrame]:
    """(cluster, parent, birth, stability, size) of every cluster, the whole's
    parent and birth null; and (node, cluster) of every big merge."""
    big = nodes.where(F.col("size") >= min_cluster_size)
    kids = big.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
        F.count(F.lit(1)).alias("n_big"), F.sum("size").alias("kept"))
    big = written_table(big.join(kids, "node", "left").withColumn("n_big", F.coalesce("n_big", F.lit(0))))
    chain = big.where("parent IS NOT NULL").select("node", "parent").join(
        big.where("n_big = 1").select(F.col("node").alias("parent")), "parent")
    of = written_table(connected_components(big.select(F.col("node").alias("id")),
                                                  chain.select(F.col("node").alias("src"), F.col("parent").alias("dst"))))
    of = of.select(F.col("id").alias("node"), F.col("root").alias("cluster"))
    in_cluster = big.join(of, "node")
    left = F.col("size") - F.when(F.col("n_big") == 1, F.col("kept")).otherwise(F.lit(0))
    # the merge nearest to the whole: the largest of its chain
    top = F.max_by(F.struct("parent", "size"), F.struct("size", "w", "node"))
    sums = in_cluster.groupBy("cluster").agg(top.alias("t"), F.sum(left / F.col("w")).alias("s"), F.sum(left).alias("n"))
    above = big.select(F.col("node").alias("up"), F.col("w").alias("birth")).join(
        of.select(F.col("node").alias("up"), F.col("cluster").alias("parent")), "up")
    tree = sums.select("cluster", F.col("t.parent").alias("up"), F.col("t.size").alias("size"), "s", "n").join(above, "up", "left")
    stability = F.col("s") - F.col("n") * F.coalesce(1.0 / F.col("birth"), F.lit(0.0))
    return written_table(tree.select("cluster", "parent", "birth", F.round(stability, DECIMALS).alias("stability"), "size")), of


NONE = -1  # for a missing name: a column of longs with gaps would turn to floats on the way


def _banded(tree: DataFrame, band_clusters: int) -> tuple[DataFrame, int]:
    """(tree with ``band``, bands): bands of about ``band_clusters`` clusters by
    their births, so that no cluster's part is in a later band than itself."""
    n = max(1, -(-tree.count() // band_clusters))
    cuts = sorted(set(tree.approxQuantile("birth", [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
    # null for the whole: the last band
    band = sum((F.coalesce(F.col("birth") > c, F.lit(True)).cast("int") for c in cuts), F.lit(0))
    names = [F.coalesce("parent", F.lit(NONE).cast("long")).alias("parent"), "birth", "stability"]
    return written_table(tree.select("cluster", *names, band.alias("band"))), len(cuts) + 1


def _best_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """The best choice at or below every cluster of a band; ``below`` and ``k``
    are those of its parts in bands before and their number."""
    pdf = pdf.sort_values("birth", na_position="last", kind="stable")
    below, parts = dict(zip(pdf["cluster"], pdf["below"])), dict(zip(pdf["cluster"], pdf["k"]))
    best, own = [], []
    for c, parent, stability in zip(pdf["cluster"], pdf["parent"], pdf["stability"]):
        best.append(max(stability, below[c]) if parts[c] else stability)
        own.append(not parts[c] or (stability >= below[c] and parent != NONE))
        if parent in below:
            below[parent] += best[-1]
            parts[parent] += 1
    return pdf.assign(best=best, own=own)[["cluster", "parent", "birth", "band", "best", "own"]]


def _named_down(last: bool):
    """The name that every cluster of a band takes: its own where it has a
    ``mark``, else its parent's; the last mark above it counts, or the first."""

    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("birth", ascending=False, na_position="first", kind="stable")
        names: dict[int, int] = {}
        for c, parent, mark, above in zip(pdf["cluster"], pdf["parent"], pdf["mark"], pdf["above"]):
            above = names.get(parent, above)
            names[c] = c if mark and (last or above == NONE) else above
        return pd.DataFrame({"cluster": pdf["cluster"], "name": pd.Series(names, dtype=np.int64).reindex(pdf["cluster"]).to_numpy()})

    return name


def _down(rows: DataFrame, bands: int, last: bool) -> DataFrame:
    """(cluster, name) of rows (cluster, parent, birth, band, mark)."""
    out = None
    for b in reversed(range(bands)):
        part, none = rows.where(F.col("band") == b), F.lit(NONE).cast("long")
        if out is not None:
            part = part.join(out.select(F.col("cluster").alias("parent"), F.col("name").alias("above")), "parent", "left")
        else:
            part = part.withColumn("above", none)
        part = part.select("cluster", "parent", "birth", "band", "mark", F.coalesce("above", none).alias("above"))
        new = part.groupBy("band").applyInPandas(_named_down(last), "cluster long, name long")
        out = written_table(new if out is None else out.unionByName(new))
    return out


def choose(tree: DataFrame, eps: float = 0.0, band_clusters: int = BAND_CLUSTERS) -> DataFrame:
    """(cluster, chosen): every cluster with the chosen one that it is or lies
    under; null under none.

    A task takes a band of clusters through all its levels, from the leaves up
    and from the whole down; what bands leave to others are their best sums and
    names."""
    todo, bands = _banded(tree, band_clusters)
    done = None
    for b in range(bands):  # from the leaves up
        part = todo.where(F.col("band") == b)
        if done is None:
            part = part.withColumns({"below": F.lit(0.0), "k": F.lit(0).cast("long")})
        else:
            sums = done.groupBy(F.col("parent").alias("cluster")).agg(F.sum("best").alias("below"), F.count(F.lit(1)).alias("k"))
            part = part.join(sums, "cluster", "left").fillna({"below": 0.0, "k": 0})
        new = part.groupBy("band").applyInPandas(
            _best_up, "cluster long, parent long, birth double, band int, best double, own boolean")
        done = written_table(new if done is None else done.unionByName(new))
    # from the whole down: the first own choice takes everything below
    mark = F.col("own") & (F.col("parent") != NONE)
    every = _down(done.withColumn("mark", mark), bands, last=False)
    if eps > 0:
        # a chosen cluster born below eps climbs to the first above it that is not, or whose parent is the whole
        whole = done.where(F.col("parent") == NONE).select(F.col("cluster").alias("parent"), F.lit(True).alias("under"))
        stop = (F.col("birth") >= eps) | F.col("under").isNotNull()
        stops = _down(done.join(whole, "parent", "left").withColumn("mark", stop & (F.col("parent") != NONE)), bands, last=True)
        tops = every.where("cluster = name").join(stops.withColumnRenamed("name", "top"), "cluster").select(
            F.col("top").alias("cluster"), F.lit(True).alias("mark")).distinct()
        marked = done.join(tops, "cluster", "left").withColumn("mark", F.coalesce("mark", F.lit(False)))
        every = _down(marked, bands, last=False)
    return every.select("cluster", F.when(F.col("name") != NONE, F.col("name")).alias("chosen"))


def point_clusters(nodes: DataFrame, points: DataFrame, of: DataFrame, min_cluster_size: int) -> DataFrame:
    """(id, cluster): the cluster that a point leaves, from its first big merge."""
    small = nodes.where(F.col("size") < min_cluster_size)
    up = small.select("node", "parent").join(small.select(F.col("node").alias("parent")), "parent", "left_semi")
    group = connected_components(small.select(F.col("node").alias("id")), up.select(F.col("node").alias("src"), F.col("parent").alias("dst")))
    top = (group.select(F.col("id").alias("node"), "root").join(small.select("node", "parent"), "node")
           .join(of.select(F.col("node").alias("parent"), "cluster"), "parent").groupBy("root").agg(F.max("cluster").alias("cluster")))
    through = group.select(F.col("id").alias("node"), "root").join(top, "root").select("node", "cluster")
    return points.join(of.unionByName(through), "node").select("id", "cluster")


def hierarchy_cluster(points: DataFrame, min_samples: int, min_cluster_size: int, eps: float = 0.0, id_col: str = "id",
                      vec_col: str = "vec", block_rows: int = blocks.DEFAULT_BLOCK_ROWS,
                      problem_edges: int = PROBLEM_EDGES) -> DataFrame:
    """M4: (id, cluster) with -1 for noise.  Ids are whole numbers of 0 and
    more, each once."""
    pts = written_table(points.select(F.col(id_col).cast("long").alias("id"),
                                            F.col(vec_col).cast("array<double>").alias("vec")))
    n = pts.count()
    core = core_distances(pts, min_samples, n, block_rows).where("core IS NOT NULL")
    edges = pair_edges(written_table(pts.join(core, "id")), n, block_rows)
    tree = edges if blocks.wide_blocks(n, block_rows) == 1 else spanning_tree(edges)
    nodes, first = merge_tree(pts.select("id"), tree, problem_edges)
    clusters, of = condensed(nodes, min_cluster_size)
    chosen = choose(clusters, eps).where("chosen IS NOT NULL")
    own = written_table(point_clusters(nodes, first, of, min_cluster_size).join(chosen, "cluster").select("id", "chosen"))
    sizes = own.groupBy("chosen").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    numbered = dense_index(sizes, [F.desc("n"), F.asc("least")], "label")
    return (pts.select("id").join(own.join(numbered.select("chosen", "label"), "chosen").select("id", "label"), "id", "left")
            .select(F.col("id").alias(id_col), F.coalesce(F.col("label").cast("int"), F.lit(NOISE)).alias("cluster")))
