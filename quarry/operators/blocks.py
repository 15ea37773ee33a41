"""Block-pair layout for exact all-pairs vector work.

Rows are hashed into ``B`` blocks.  Each row is emitted once for every
*unordered* block pair that contains its block, and
``groupBy(pair).applyInPandas`` hands one kernel call the two blocks of a pair,
cut into tiles of ``block_rows`` vectors, and the pairs of tiles that meet.
The kernel does one dense NumPy GEMM for a pair of tiles and keeps a reduced
result for the whole task (top-k, sums per cluster, a forest), never the pairs.

Shuffle volume is ``N * B`` vector copies.  A block holds up to
``BLOCK_TILES`` tiles, so a task holds at most two of these and one matrix of
distances between two tiles; up to ``MIN_BLOCKS`` full blocks ``B`` does not
grow with N (the copies grow as the input does), beyond that it is
``N / (BLOCK_TILES * block_rows)``, the inherent price of exact all-pairs work
in bounded memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_BLOCK_ROWS = 2048
BLOCK_TILES = 64  # tiles of a block, at most
FINE_ROWS = 512   # rows of a tile of whose pairs a kernel makes one matrix
DENSE_SHARE = 1 / 16  # of a matrix' cells, from which on all are measured at once
MIDDLE_ROWS = 1024    # rows, about, of which the middle is taken
SLICE_PAIRS = 50_000  # pairs of rows measured at a time
MIN_BLOCKS = 16   # blocks that are made, where rows suffice, for enough tasks
MAX_TASKS = 1024
TASK_ROWS = 256    # no more tasks than one for so many rows

# kernel(tiles, pairs): pairs are positions of tiles, (i, i) for a tile with itself
Kernel = Callable[[list[pd.DataFrame], list[tuple[int, int]]], pd.DataFrame]


def n_blocks(n_rows: int, block_rows: int = DEFAULT_BLOCK_ROWS) -> int:
    return max(1, math.ceil(n_rows / block_rows))


def wide_blocks(n_rows: int, block_rows: int = DEFAULT_BLOCK_ROWS, block_tiles: int = BLOCK_TILES) -> int:
    """Blocks of up to ``block_tiles`` tiles that ``n_rows`` are dealt into."""
    tiles = n_blocks(n_rows, block_rows)
    return max(math.ceil(tiles / block_tiles), min(tiles, MIN_BLOCKS))


def pair_tasks(n_blk: int, n_rows: int) -> int:
    """Tasks for the block pairs: small pairs hold much work, so they are not
    left to be coalesced by size."""
    return max(1, min(n_blk * (n_blk + 1) // 2, MAX_TASKS, n_rows // TASK_ROWS))


def with_pairs(df: DataFrame, id_col: str, n_blk: int) -> DataFrame:
    """Add ``blk`` and explode ``pair`` (= lo * B + hi) over the B pairs of each row."""
    blk = F.pmod(F.xxhash64(F.col(id_col)), F.lit(n_blk)).cast("int")
    others = F.sequence(F.lit(0), F.lit(n_blk - 1))
    pair = F.transform(others, lambda j: F.least(F.col("blk"), j) * n_blk + F.greatest(F.col("blk"), j))
    return df.withColumn("blk", blk).withColumn("pair", F.explode(pair))


def tiles_of(rows: pd.DataFrame, block_rows: int = DEFAULT_BLOCK_ROWS) -> list[pd.DataFrame]:
    return [rows.iloc[at:at + block_rows].reset_index(drop=True) for at in range(0, len(rows), block_rows)]


def fine(tiles: list[pd.DataFrame], pairs: list[tuple[int, int]], rows: int = FINE_ROWS):
    """The same tiles and pairs cut into tiles of at most ``rows``, whose
    matrices stay in a core's cache."""
    cut = [tiles_of(t, -(-len(t) // n_blocks(len(t), rows)) or 1) for t in tiles]  # of even sizes
    at = np.cumsum([0] + [len(c) for c in cut])
    return ([t for c in cut for t in c],
            [(x, y) for i, j in pairs for x in range(at[i], at[i + 1]) for y in range(at[j], at[j + 1]) if i != j or x <= y])


def run_pairs(df: DataFrame, id_col: str, n_rows: int, kernel: Kernel, schema: str,
              block_rows: int = DEFAULT_BLOCK_ROWS, block_tiles: int = BLOCK_TILES, order: str | None = None) -> DataFrame:
    """Apply ``kernel`` to every block pair of ``df``; a block's rows are cut
    into tiles by ``order``, if given."""
    n_blk = wide_blocks(n_rows, block_rows, block_tiles)

    def per_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = divmod(int(pdf["pair"].iat[0]), n_blk)
        if order is not None:
            pdf = pdf.sort_values(order, kind="stable")
        left = tiles_of(pdf[pdf["blk"] == lo], block_rows)
        if lo == hi:
            return kernel(left, [(i, j) for i in range(len(left)) for j in range(i, len(left))])
        right = tiles_of(pdf[pdf["blk"] == hi], block_rows)
        return kernel(left + right, [(i, len(left) + j) for i in range(len(left)) for j in range(len(right))])

    return with_pairs(df, id_col, n_blk).repartition(pair_tasks(n_blk, n_rows), "pair").groupBy("pair").applyInPandas(per_pair, schema)


def matrix(col: pd.Series) -> np.ndarray:
    """Stack a pandas column of arrays into a float64 matrix."""
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.vstack([np.asarray(v, dtype=np.float64) for v in col.values])


def square_factors(vecs: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Factors whose product, left by right, is the squared distance of two
    tiles' rows (but for its rounding, which may be below 0)."""
    square = [(v * v).sum(1)[:, None] for v in vecs]
    return ([np.hstack((-2.0 * v, s, np.ones_like(s))) for v, s in zip(vecs, square)],
            [np.hstack((v, np.ones_like(s), s)) for v, s in zip(vecs, square)])


class Scratch:
    """Room for the matrices of two tiles, made once in a task."""

    def __init__(self, dtype=np.float64):
        self.room = np.empty(0, dtype)

    def product(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``left @ right.T``, valid until the next product."""
        n = len(left) * len(right)
        if len(self.room) < n:
            self.room = np.empty(n, self.room.dtype)
        return np.dot(left, right.T, out=self.room[:n].reshape(len(left), len(right)))


def cells(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a matrix, far faster where few cells are set."""
    return np.divmod(np.flatnonzero(mask), max(mask.shape[1], 1))


class Close:
    """Pairs of rows of some tiles that may lie near each other.

    One float32 product bounds the negative squared distances of two tiles from
    above: its largest rounding is added to it.  Only what may be near enough
    by that bound is measured in float64, so nothing near is missed."""

    def __init__(self, vecs: list[np.ndarray]):
        known = [v[np.isfinite(v).all(1)] for v in vecs]
        some = [v[::max(1, len(v) * len(known) // MIDDLE_ROWS)] for v in known if len(v)]
        middle = np.median(np.concatenate(some), axis=0) if some else 0.0  # which a few far rows do not move
        far = max((float(np.linalg.norm(v - middle, axis=1).max()) for v in known if len(v)), default=0.0)
        self.vecs, self.scale = vecs, 1.0 / far if far > 0 else 1.0
        with np.errstate(invalid="ignore", over="ignore"):
            # lengths of at most 1; a row that is not finite is near to none
            self.moved = [(v - middle) * self.scale if len(v) else v for v in vecs]
            square = [(v * v).sum(1)[:, None] for v in self.moved]
            self.slack = 2.0 * ((vecs[0].shape[1] if vecs else 0) + 10) * 2.0 ** -23  # times both squares, of a product's rounding
            least = [1e-30 - s * (1.0 - self.slack) for s in square]
            self.left = [np.hstack((2.0 * v, s, np.ones_like(s))).astype(np.float32) for v, s in zip(self.moved, least)]
            self.right = [np.hstack((v, np.ones_like(s), s)).astype(np.float32) for v, s in zip(self.moved, least)]
        self.room, self.wide, self.factors = Scratch(np.float32), Scratch(), None

    def bound(self, i: int, j: int) -> np.ndarray:
        """At least the negative squared distances of tiles ``i`` and ``j``, in
        the measure of ``limit``; valid until the next call."""
        return self.room.product(self.left[i], self.right[j])

    def limit(self, square: np.ndarray) -> np.ndarray:
        """What ``bound`` reaches where the squared distance is at most ``square``."""
        with np.errstate(over="ignore"):
            return np.nextafter((-square * self.scale * self.scale).astype(np.float32), np.float32(-np.inf))

    def within(self, i: int, j: int, x: np.ndarray, y: np.ndarray, most) -> tuple[np.ndarray, np.ndarray]:
        """Positions of those of rows ``x`` of tile ``i`` and ``y`` of tile ``j``
        whose squared distance is at most ``most``, and these."""
        at, most = np.arange(len(x)), np.broadcast_to(most, len(x))
        if len(x) > DENSE_SHARE * len(self.vecs[i]) * len(self.vecs[j]):  # too many to measure: a sharper bound first
            self.factors = self.factors or square_factors(self.moved)
            least = self.wide.product(self.factors[0][i], self.factors[1][j])[x, y] - 2 * self.slack * 2.0 ** -29
            at = np.flatnonzero(least <= most * self.scale * self.scale * (1 + 1e-9))
        square = np.concatenate([self._squares(i, j, x[at[k:k + SLICE_PAIRS]], y[at[k:k + SLICE_PAIRS]])
                                 for k in range(0, len(at), SLICE_PAIRS)] or [np.zeros(0)])
        good = square <= most[at]
        return at[good], square[good]

    def _squares(self, i: int, j: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = self.vecs[i][x] - self.vecs[j][y]
        return np.einsum("ij,ij->i", d, d)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Cells whose two ids are equal, None if there are none."""
    return a[:, None] == b[None, :] if a is b or len(np.intersect1d(a, b)) else None


def top_cells(score: np.ndarray, row_ids: np.ndarray, col_ids: np.ndarray, k: int, decimals: int):
    """Per row, the k best columns by (rounded score desc, id asc).

    Rounded score and id order make one integer key per cell, so one
    partition and one sort of k columns serve all rows at once."""
    if score.size == 0:
        return [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
    m = score.shape[1]
    kk = min(k, m)
    place = np.empty(m, np.int64)
    place[np.argsort(col_ids, kind="stable")] = np.arange(m)
    known = np.isfinite(score)
    key = np.where(known, np.rint(np.where(known, score, 0.0) * 10 ** decimals).astype(np.int64) * m - place,
                   np.iinfo(np.int64).min + 1)
    top = np.argpartition(-key, kk - 1, axis=1)[:, :kk]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, 1), axis=1), 1)
    keep = np.take_along_axis(known, top, 1).ravel()
    return [np.repeat(row_ids, kk)[keep], col_ids[top].ravel()[keep], np.take_along_axis(score, top, 1).ravel()[keep]]


class Best:
    """The k best partners of every row of some tiles, over all scores offered.

    Scores that are not finite count as none.  With ``decimals`` scores are
    compared rounded and ties go to the smaller id.  Once a row has k partners,
    only scores that reach its k-th are looked at."""

    def __init__(self, ids: list[np.ndarray], k: int, decimals: int | None = None):
        self.ids, self.k, self.decimals = ids, k, decimals
        self.score = [np.full((len(i), k), -np.inf) for i in ids]
        self.partner = [np.zeros((len(i), k), np.int64) for i in ids]
        self.least = [np.full(len(i), -np.inf) for i in ids]

    def _key(self, score: np.ndarray) -> np.ndarray:
        return score if self.decimals is None else np.rint(score * 10 ** self.decimals)

    def offer(self, tile: int, score: np.ndarray, partners: np.ndarray) -> None:
        """Scores of the tile's rows (down) with ``partners`` (across)."""
        k, near = self.k, score >= self.least[tile][:, None]
        if np.count_nonzero(near) <= 4 * k * len(score):
            row, col = np.nonzero(near)
            value, partner = score[row, col], partners[col]
        elif self.decimals is not None:
            row, partner, value = top_cells(score, np.arange(len(score)), partners, k, self.decimals)
        else:
            kk = min(k, score.shape[1])
            known = np.where(np.isfinite(score), score, -np.inf)
            col = np.argpartition(-known, kk - 1, axis=1)[:, :kk]
            row, value, partner = np.repeat(np.arange(len(score)), kk), np.take_along_axis(known, col, 1).ravel(), partners[col].ravel()
        self.add(tile, row, value, partner)

    def add(self, tile: int, row: np.ndarray, value: np.ndarray, partner: np.ndarray) -> None:
        """Scores ``value`` of the tile's rows ``row`` with ``partner``."""
        k, known = self.k, np.isfinite(value)
        row, value, partner = row[known], value[known], partner[known]
        if len(row) == 0:
            return
        at = np.unique(row)
        rows = np.concatenate((np.repeat(at, k), row))
        value = np.concatenate((self.score[tile][at].ravel(), value))
        partner = np.concatenate((self.partner[tile][at].ravel(), partner))
        order = np.lexsort((partner, -self._key(value), rows))
        rows = rows[order]
        order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]  # k of each row
        self.score[tile][at], self.partner[tile][at] = value[order].reshape(-1, k), partner[order].reshape(-1, k)
        last = self.score[tile][at, k - 1]
        last = last if self.decimals is None else (self._key(last) - 0.5) / 10 ** self.decimals - 1e-12
        self.least[tile][at] = np.maximum(self.least[tile][at], last)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, partner, score) of all that was kept."""
        ids = np.concatenate([np.repeat(i, self.k) for i in self.ids] or [np.zeros(0, np.int64)])
        partner, score = (np.concatenate([x.ravel() for x in xs] or [np.zeros(0)]) for xs in (self.partner, self.score))
        known = np.isfinite(score)
        return ids[known], partner[known].astype(np.int64), score[known]


def hook(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the components of nodes i and j, pair by pair, in place: ``labels``
    holds each node's component as its smallest node."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels[:] = further
