"""Density clustering (M4) and connected components.

Re-aimed from HDBSCAN to its DBSCAN* cut at ``eps`` (Campello et al. 2013):

* ``core(x)`` = distance to the ``min_samples``-th nearest point, the point
  itself counted first (exact, kNN over the pairs of blocks that can hold it);
* an edge joins x and y when ``max(core x, core y, d(x, y)) <= eps``;
* clusters are the connected components of core points; components smaller
  than ``min_cluster_size`` and all non-core points are noise (-1);
* labels are numbered by size (desc), then smallest member id.

The edge set is exact but never materialised: a task reduces the eps-graph of
the blocks that meet in it to a spanning forest (edges from each point to its
local component's first point).  The union of those forests has the same
connected components as the full graph.  Blocks that no point within reach can
be in do not meet (``pivots``).  Components are then found by
``components.connected_components`` (large-star/small-star).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import blocks, pivots
from quarry.operators.components import connected_components
from quarry.operators.records import dense_index
from quarry.session import reliable_checkpoint

NOISE = -1


NEAR_SCHEMA = "id long, d double"
FIRST_ROWS = 256  # rows that give a tile its first limits


def _first_limits(ids: list[np.ndarray], close: blocks.Close, pairs: list[tuple[int, int]], k: int) -> list[np.ndarray]:
    """Negative squared distances that each row's k nearest reach, from the first
    rows of a tile that its own meets; -inf where these are too few."""
    least = [np.full(len(i), -np.inf) for i in ids]
    left, right = blocks.square_factors(close.moved)
    met = {}
    for i, j in pairs:
        for t, other in ((i, j), (j, i)):
            if met.get(t, t) == t:
                met[t] = other
    for t, other in met.items():
        if len(ids[t]) and len(ids[other]) >= k:
            square = left[t] @ right[other][:FIRST_ROWS].T
            square[(ids[t][:, None] == ids[other][None, :FIRST_ROWS]) | np.isnan(square)] = np.inf
            if square.shape[1] >= k:
                kth = np.partition(square, k - 1, axis=1)[:, k - 1]
                least[t] = -(np.maximum(kth, 0.0) * (1.0 + 1e-9) + 1e-12) / close.scale ** 2  # more than their rounding
    return least


def _near_kernel(k: int):
    """The k least distances of each row of the tiles that meet, as ``NEAR_SCHEMA``."""

    def kernel(tiles: list[pd.DataFrame], pairs: list[tuple[int, int]]) -> pd.DataFrame:
        tiles, pairs = blocks.fine(tiles, pairs)
        ids = [t["id"].to_numpy(np.int64) for t in tiles]
        close = blocks.Close([blocks.matrix(t["vec"]) for t in tiles])
        best = blocks.Best(ids, k)
        best.least = _first_limits(ids, close, pairs, k)
        limit = [close.limit(-x) for x in best.least]
        found: list[list] = [[] for _ in tiles]  # (rows, scores, partners) not yet among the best
        n_found = [0] * len(tiles)

        def settle(t):
            if found[t]:
                best.add(t, *(np.concatenate(c) for c in zip(*found[t])))
                limit[t], found[t], n_found[t] = close.limit(-best.least[t]), [], 0

        def offer(t, other, row, col):
            apart = ids[t][row] != ids[other][col]
            row, col = row[apart], col[apart]
            at, square = close.within(t, other, row, col, -best.least[t][row])
            if len(at):
                found[t].append((row[at], -square, ids[other][col[at]]))
                n_found[t] += len(at)
                if n_found[t] > len(ids[t]):
                    settle(t)

        for i, j in pairs:
            near = close.bound(i, j)
            row, col = blocks.cells(near >= limit[i][:, None])
            if len(row):
                offer(i, j, row, col)
            if i != j:
                row, col = blocks.cells(near >= limit[j][None, :])
                if len(row):
                    offer(j, i, col, row)
        for t in range(len(tiles)):
            settle(t)
        point, _, score = best.rows()
        return pd.DataFrame({"id": point, "d": np.sqrt(np.maximum(-score, 0.0))})

    return kernel


def nearest_distances(points: DataFrame, k: int, n_rows: int,
                      block_rows: int = blocks.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(id, near): ascending distances to the k nearest other points."""
    return _nearest_k(blocks.run_pairs(points, "id", n_rows, _near_kernel(k), NEAR_SCHEMA, block_rows), k)


def nearest_distances_pruned(points: DataFrame, k: int, cell_rows: int = pivots.CELL_ROWS,
                             max_pivots: int = pivots.MAX_PIVOTS,
                             block_rows: int = blocks.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """The rows of ``nearest_distances``, where only those blocks meet that can
    hold one of the k nearest (``pivots``)."""

    def limits(rows: pd.DataFrame, found: pd.DataFrame) -> np.ndarray:
        kth = found.groupby("id")["d"].agg(["max", "size"]).reindex(rows["id"])
        scale = 1.0 + np.linalg.norm(blocks.matrix(rows["vec"]), axis=1)  # rounding grows with the vectors
        return np.nan_to_num(kth["max"].where(kth["size"] >= k).to_numpy(), nan=np.inf) + 1e-6 * scale

    search = pivots.Search(k, _near_kernel(k), NEAR_SCHEMA, lambda x: x, limits)
    return _nearest_k(pivots.nearest(pivots.usable(points, "id", "vec"), search, cell_rows, max_pivots, block_rows), k)


def _nearest_k(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy("d")
    return (cand.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
            .groupBy("id").agg(F.sort_array(F.collect_list("d")).alias("near")))


def core_from(ids: DataFrame, near: DataFrame, min_samples: int) -> DataFrame:
    """(id, core): distance to the min_samples-th nearest point, the point
    itself first; null (never core) with fewer other points."""
    k = max(min_samples - 1, 0)
    if k == 0:
        return ids.select("id", F.lit(0.0).alias("core"))
    return ids.select("id").join(near, "id", "left").select("id", F.get("near", F.lit(k - 1)).alias("core"))


def core_distances(points: DataFrame, min_samples: int, n_rows: int,
                   block_rows: int = blocks.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(id, core): distance to the min_samples-th nearest point (self first)."""
    k = max(min_samples - 1, 1)
    return core_from(points, nearest_distances(points, k, n_rows, block_rows), min_samples)


def _forest_kernel(eps: float):
    """Star edges (src, dst) of the components that the tiles' pairs within
    ``eps`` make."""

    def kernel(tiles: list[pd.DataFrame], pairs: list[tuple[int, int]]) -> pd.DataFrame:
        tiles, pairs = blocks.fine(tiles, pairs)
        ids = np.concatenate([t["id"].to_numpy(np.int64) for t in tiles] or [np.zeros(0, np.int64)])
        start = np.cumsum([0] + [len(t) for t in tiles])
        close = blocks.Close([blocks.matrix(t["vec"]) for t in tiles])
        most = eps * eps * (1.0 + 1e-12)  # rounding
        limit = close.limit(np.float64(most))
        labels = np.arange(len(ids))
        found, n_found = [], 0

        def settle():
            if found:
                blocks.hook(labels, *(np.concatenate(c) for c in zip(*found)))

        for i, j in pairs:
            x, y = blocks.cells(close.bound(i, j) >= limit)
            apart = labels[x + start[i]] != labels[y + start[j]]
            x, y = x[apart], y[apart]
            at, _ = close.within(i, j, x, y, most)
            if len(at):
                found.append((x[at] + start[i], y[at] + start[j]))
                n_found += len(at)
            if n_found > len(ids):
                settle()
                found, n_found = [], 0
        settle()
        src = np.flatnonzero(labels != np.arange(len(ids)))
        return pd.DataFrame({"src": ids[src], "dst": ids[labels[src]]})

    return kernel


def eps_forest(points: DataFrame, eps: float, cell_rows: int = pivots.CELL_ROWS, max_pivots: int = pivots.MAX_PIVOTS,
               block_rows: int = blocks.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Spanning-forest edges (src, dst) of the eps mutual-reachability graph
    among core points (rows with ``core <= eps``); blocks that lie farther
    apart than ``eps`` do not meet (``pivots``)."""

    def limits(rows: pd.DataFrame, found: pd.DataFrame) -> np.ndarray:
        return eps + 1e-6 * (1.0 + np.linalg.norm(blocks.matrix(rows["vec"]), axis=1))

    search = pivots.Search(1, _forest_kernel(eps), "src long, dst long", lambda x: x, limits)
    return pivots.nearest(pivots.usable(points.where(F.col("core") <= eps), "id", "vec"), search, cell_rows, max_pivots, block_rows)


def density_cluster(points: DataFrame, min_samples: int, eps: float | None,
                    min_cluster_size: int, id_col: str = "id", vec_col: str = "vec",
                    eps_quantile: float = 0.5,
                    block_rows: int = blocks.DEFAULT_BLOCK_ROWS, near: DataFrame | None = None) -> DataFrame:
    """M4: (id, cluster, core) with -1 for noise.

    ``near``: nearest distances of the same points (``nearest_distances``) for
    at least ``min_samples - 1`` neighbours, where many runs share them.

    ``eps=None`` takes the ``eps_quantile`` of the core distances (exact
    quantile), a data-adaptive cut for inputs without a tuned eps."""
    from quarry.operators.stats import exact_quantiles

    pts = points.select(F.col(id_col).cast("long").alias("id"),
                        F.col(vec_col).cast("array<double>").alias("vec"))
    pts = reliable_checkpoint(pts)
    if near is None:
        near = nearest_distances_pruned(pts, max(min_samples - 1, 1), block_rows=block_rows)
    core = reliable_checkpoint(core_from(pts, near, min_samples))
    if eps is None:
        eps = exact_quantiles(core, "core", [eps_quantile]).first()[0]
        eps = float(eps) if eps is not None else 0.0
    with_core = pts.join(core, "id")
    forest = eps_forest(with_core, eps, block_rows=block_rows)
    core_ids = core.where(F.col("core") <= eps).select("id")
    comp = connected_components(core_ids, forest)
    sizes = comp.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    big = sizes.where(F.col("size") >= min_cluster_size).withColumn("neg", -F.col("size"))
    numbered = dense_index(big, ["neg", "root"], "label")
    labelled = comp.join(numbered.select("root", "label"), "root", "left")
    return (pts.select("id").join(labelled.select("id", "label"), "id", "left")
            .join(core, "id", "left")
            .select(F.col("id").alias(id_col),
                    F.coalesce(F.col("label").cast("int"), F.lit(NOISE)).alias("cluster"),
                    F.col("core")))
