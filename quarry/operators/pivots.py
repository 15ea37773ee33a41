"""Exact nearest neighbours through Voronoi cells of pivots.

The pivots are a bounded sample of the vectors (the ``max_pivots`` first by
hash of id, at most one for ``cell_rows`` vectors), every vector belongs to
the cell of its nearest pivot, a cell is cut into shells by radius, and a
shell is dealt into chunks of about ``block_rows`` vectors, so that a cell
holding a third of them is many tasks.
Three steps:

1. every chunk searches itself.  The k-th result is a limit: whatever lies
   farther from the vector cannot be among its k nearest;
2. the same task names the cells that the limits leave open.  By the triangle
   inequality a vector at ``d`` from a pivot whose cell spans the radii
   ``lo..hi`` is at least ``d - hi`` and ``lo - d`` away from all in it, and at
   least as far as from the hyperplane between that pivot and its own;
3. pairs of chunks with an open side meet (``kernel``).  Up to
   ``blocks.BLOCK_TILES`` chunks in a row make a group, and a task gets the
   open pairs of chunks of two groups and the chunks in them.

A vector is shuffled once for each pair of groups in which its chunk has an
open pair: about as often as in the all-pairs layout where all are open, and
far less where the vectors have clusters.  Limits and bounds are exact, no
result is lost.

Broadcast: the pivots (``max_pivots`` vectors, once for each of their shells) and the shells' radii.  Rows
without an id or a vector, and vectors with a null or non-finite component,
take no part.  Equal vectors share a cell, and with more equal vectors than a
chunk holds all pairs of their chunks are open: their ties go by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import blocks
from quarry.session import reliable_checkpoint

CELL_ROWS = blocks.DEFAULT_BLOCK_ROWS  # vectors without clusters then cost what the all-pairs layout does
MAX_PIVOTS = 4096
MAX_SHELLS = 64       # parts that a cell is cut into by radius, at most
SLICE_ROWS = 256      # rows that are held against all pivots at once
LEAST_GAP = 1e-6      # pivots nearer than that give no hyperplane bound


@dataclass(frozen=True)
class Search:
    """What is searched: ``place`` maps a matrix of vectors to points of the
    Euclidean space of the bounds, ``kernel`` gives the k nearest of pairs of
    tiles as rows of ``schema``, ``limits`` the distance in that space beyond which
    no vector can be among a row's k nearest (infinite if unknown)."""
    k: int
    kernel: blocks.Kernel
    schema: str
    place: Callable[[np.ndarray], np.ndarray]
    limits: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad)
            .select(F.col(id_col).cast("long").alias("id"), v.alias("vec")))


def _assign(src: DataFrame, search: Search, pivots) -> DataFrame:
    """(id, vec, cell, radius): the nearest pivot of every vector."""
    place = search.place

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, radius = np.empty(len(pdf), np.int32), np.empty(len(pdf))
                pts = place(blocks.matrix(pdf["vec"]))
                for at in range(0, len(pdf), SLICE_ROWS):
                    d = distances(pts[at:at + SLICE_ROWS], pivots.value)
                    cell[at:at + SLICE_ROWS] = d.argmin(1)
                    radius[at:at + SLICE_ROWS] = d.min(1)
                yield pdf.assign(cell=cell, radius=radius)

    return src.mapInPandas(near, "id long, vec array<double>, cell int, radius double")


def _pivots(src: DataFrame, search: Search, n_rows: int, cell_rows: int, max_pivots: int) -> np.ndarray:
    """Points of the pivots.  Those whose cell would not fill a top k are
    given up, their vectors go to the next pivot."""
    n = min(max_pivots, max(1, n_rows // cell_rows))
    rows = src.orderBy(F.xxhash64("id"), "id").limit(n).collect()
    if not rows:
        return np.zeros((0, 0))
    pts = np.unique(search.place(np.array([r["vec"] for r in rows], dtype=np.float64)), axis=0)
    shared = src.sparkSession.sparkContext.broadcast(pts)
    sizes = {r["cell"]: r["count"] for r in _assign(src, search, shared).groupBy("cell").count().collect()}
    large = [c for c in range(len(pts)) if sizes.get(c, 0) > 2 * search.k]
    return pts[large or [0]]


def _shells(placed: DataFrame, block_rows: int) -> DataFrame:
    """(cell, first, cuts) of every pivot: its cell is cut at these radii, and
    the parts are numbered from ``first`` on."""
    grid = [k / MAX_SHELLS for k in range(1, MAX_SHELLS)]
    # as floats: the rounding of a distance must not part equal vectors
    radius = F.col("radius").cast("float")
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(radius, grid, 1000).alias("q"))
    table, first = [], 0
    for r in cells.orderBy("cell").collect():  # one row per pivot
        n = min(MAX_SHELLS, blocks.n_blocks(r["n"], block_rows))
        at = [round(k * MAX_SHELLS / n) - 1 for k in range(1, n)]
        # between two radii, not at one: a cut seldom parts vectors that lie close together
        cuts = sorted({(r["q"][max(i - 1, 0)] + r["q"][i]) / 2 for i in at})
        table.append((r["cell"], first, cuts))
        first += len(cuts) + 1
    return placed.sparkSession.createDataFrame(table, "cell int, first int, cuts array<float>")


def in_cells(src: DataFrame, search: Search, cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS,
             block_rows: int = blocks.DEFAULT_BLOCK_ROWS) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(rows, cells, pivots): rows (id, vec, cell, chunk), and cells (cell, n,
    lo, hi, base, parts), whose chunks are ``base .. base + parts - 1``.  A
    pivot's cell of more than ``block_rows`` vectors is cut by radius into as many
    cells with that pivot, so that vectors near each other share a chunk."""
    spark = src.sparkSession
    pivots = _pivots(src, search, src.count(), cell_rows, max_pivots)
    placed = reliable_checkpoint(_assign(src, search, spark.sparkContext.broadcast(pivots)))
    shells = _shells(placed, block_rows)
    of = F.col("first") + F.size(F.filter("cuts", lambda c: c < F.col("radius").cast("float")))
    placed = placed.join(F.broadcast(shells), "cell").select("id", "vec", of.alias("cell"), "radius")
    sizes = {r["cell"]: r for r in placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("radius").alias("lo"), F.max("radius").alias("hi")).collect()}
    owner = [r["cell"] for r in shells.orderBy("first").collect() for _ in range(len(r["cuts"]) + 1)]
    table, base = [], 0
    for cell in sorted(sizes):
        r, parts = sizes[cell], blocks.n_blocks(sizes[cell]["n"], block_rows)
        table.append((cell, r["n"], r["lo"], r["hi"], base, parts))
        base += parts
    cells = spark.createDataFrame(table, "cell int, n long, lo double, hi double, base long, parts int")
    chunk = F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts"))
    rows = placed.join(F.broadcast(cells), "cell").select("id", "vec", "cell", chunk.alias("chunk"))
    return rows, cells, pivots[owner] if owner else pivots


def search_chunks(rows: DataFrame, cells: DataFrame, pivots: np.ndarray, search: Search) -> DataFrame:
    """Steps 1 and 2: rows of the search's schema from every chunk itself, and
    rows with (chunk, open) for every cell that is open to it."""
    lo, hi = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in cells.collect():
        lo[r["cell"]], hi[r["cell"]] = r["lo"], r["hi"]
    shared = rows.sparkSession.sparkContext.broadcast((pivots, lo, hi))

    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        piv, near, far = shared.value
        found = search.kernel([pdf], [(0, 0)])
        limit = search.limits(pdf, found)
        own = int(pdf["cell"].iat[0])
        pts, gap = search.place(blocks.matrix(pdf["vec"])), distances(piv[own:own + 1], piv)
        is_open = np.zeros(len(piv), bool)
        for at in range(0, len(pts), SLICE_ROWS):
            d = distances(pts[at:at + SLICE_ROWS], piv)
            least = np.maximum(d - far, near - d)
            plane = (d * d - d[:, own:own + 1] ** 2) / (2 * np.maximum(gap, LEAST_GAP))
            least = np.where(gap > LEAST_GAP, np.maximum(least, plane), least)
            is_open |= (least <= limit[at:at + SLICE_ROWS, None]).any(0)
        opened = pd.DataFrame({"open": np.flatnonzero(is_open).astype(np.int32)}).assign(chunk=pdf["chunk"].iat[0])
        return pd.concat([found, opened], ignore_index=True)

    return rows.groupBy("chunk").applyInPandas(home, f"{search.schema}, chunk long, open int")


def open_pairs(found: DataFrame, cells: DataFrame) -> DataFrame:
    """(a, b), a < b: every pair of chunks of which one side is open."""
    each = F.explode(F.sequence(F.col("base"), F.col("base") + F.col("parts") - 1)).alias("other")
    return (found.where("open IS NOT NULL").select("chunk", F.col("open").alias("cell"))
            .join(F.broadcast(cells), "cell").select("chunk", each).where("other <> chunk")
            .select(F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b")).distinct())


def copies(rows: DataFrame, pairs: DataFrame, span: int = 1) -> DataFrame:
    """(id, vec, chunk, a, b): every row once for each pair of groups (of
    ``span`` chunks) in which its chunk has an open pair."""
    group = [F.expr(f"{c} div {span}").alias(c) for c in ("a", "b")]
    return rows.join(pairs.select(F.explode(F.array("a", "b")).alias("chunk"), *group).distinct(), "chunk")


def nearest(src: DataFrame, search: Search, cell_rows: int = CELL_ROWS, max_pivots: int = MAX_PIVOTS,
            block_rows: int = blocks.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """Rows of the search's schema that hold, for every row of ``src`` (id,
    vec), its k nearest and others."""
    rows, cells, pivots = in_cells(src, search, cell_rows, max_pivots, block_rows)
    found = reliable_checkpoint(search_chunks(rows, cells, pivots, search))
    names = [c for c in found.columns if c not in ("chunk", "open")]
    n_chunks, n = cells.agg(F.coalesce(F.sum("parts"), F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    span = max(1, min(blocks.BLOCK_TILES, -(-n_chunks // blocks.MIN_BLOCKS)))
    tasks = blocks.pair_tasks(-(-n_chunks // span), n)

    def meet(pdf: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        tiles = {c: t.reset_index(drop=True) for c, t in pdf.groupby("chunk")}
        at = {c: i for i, c in enumerate(tiles)}
        return search.kernel(list(tiles.values()), [(at[x], at[y]) for x, y in zip(met["x"], met["y"])])

    pairs = reliable_checkpoint(open_pairs(found, cells))
    listed = pairs.select(*[F.expr(f"{c} div {span}").alias(c) for c in ("a", "b")], F.col("a").alias("x"), F.col("b").alias("y"))
    met = (copies(rows, pairs, span).repartition(tasks, "a", "b").groupBy("a", "b")
           .cogroup(listed.repartition(tasks, "a", "b").groupBy("a", "b")).applyInPandas(meet, search.schema))
    return found.where("open IS NULL").select(*names).unionByName(met)
