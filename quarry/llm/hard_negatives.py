"""Hard negatives by a multiway hyperplane tree with distance ranges (GNAT).

*Task.*  Vectors are taken in whole steps (``floor(scale * x)``), so inner
products are integers and every comparison is exact.  An anchor's positives
are the ``n_positives`` best rows of its label; the negatives of a positive of
score p are the ``n_negatives`` best rows of other labels whose score s lies in
``low * p <= 100 * s <= high * p``.  Better is a higher score, then a smaller id.

*Tree.*  A node has up to ``DEGREE`` split points, far from each other, and a
vector belongs to the child of the nearest one.  The split points are chosen
from a sample of at most ``SAMPLE`` rows (the rows of smallest id hash), which
bounds the tree; *every* row is put in its leaf, and Spark then measures, over
all rows, the range of distances from every split point of a node to every
sibling subtree, and the range of norms of every subtree.

*Search.*  As ``2 s = |a|^2 + |x|^2 - d^2``, a window of scores is an annulus of
distances round the anchor for each norm.  From the anchor's distances to a
node's split points and the stored ranges, the triangle inequality bounds the
scores that a child's rows can have; a child whose bounds miss the window is
eliminated with all under it.  First the anchor's own leaf is read, which
raises the window's lower end to the worst of the best found there; then the
leaves that are left.  Leaves are exact: one matrix product for a block of
anchors and a chunk of a leaf's rows.  A leaf of any size is dealt into chunks
of about ``CHUNK_ROWS`` rows, the anchors into blocks of about
``ANCHOR_BLOCK``, and only the best rows of a chunk leave its task.

Defined results: rows with a null id, label, vector or component, or one that
is not finite, take no part; shorter vectors count as filled up with zeros; a
row with the anchor's id is neither its positive nor its negative; an anchor
row that is there twice is one anchor, any other repeated row counts as often as it
is there; fewer rows than asked for are all returned; negative scores of a
positive have no window; empty tables give no rows.  Components beyond 2^23
and products beyond 2^53 are errors, as they would not be exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import reliable_checkpoint

SCALE = 256
N_POSITIVES = 5
N_NEGATIVES = 10
LOW, HIGH = 30, 90  # hundredths of the positive's score
SAMPLE = 8_192
DEGREE = 16
LEAF_SAMPLE = 128
CHUNK_ROWS = 16_384
ANCHOR_BLOCK = 16_384
TILE = 256  # anchors whose scores are held at once
SEED = 5
EXACT = float(1 << 53)


# -- the tree -----------------------------------------------------------------

@dataclass
class Tree:
    """``points[n]``: the split points of node n; ``child[n][j]``: the node
    under split point j, or ``-1 - leaf``.  With ranges: ``near[n][i, j]`` and
    ``far[n][i, j]`` bound the distances from split point i to the rows under
    j, ``norms[n][j]`` the squared norms there."""

    points: list[np.ndarray]
    child: list[list[int]]
    leaves: int
    near: list[np.ndarray] | None = None
    far: list[np.ndarray] | None = None
    norms: list[np.ndarray] | None = None


def widen(x: np.ndarray, d: int) -> np.ndarray:
    return x if x.shape[1] >= d else np.pad(x, ((0, 0), (0, d - x.shape[1])))


def squares(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances, exact for whole numbers."""
    d = max(x.shape[1], points.shape[1])
    x, points = widen(x, d), widen(points, d)
    return (x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2.0 * (x @ points.T)


def spread_points(x: np.ndarray, degree: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``degree`` different rows, each the farthest from those before it
    among three times as many candidates."""
    some = x[np.sort(rng.choice(len(x), min(len(x), 3 * degree), replace=False))]
    chosen = [0]
    nearest = squares(some, some[:1])[:, 0]
    while len(chosen) < degree and nearest.max(initial=0) > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squares(some, some[chosen[-1:]])[:, 0])
    return some[chosen]


def split(sample: np.ndarray, degree: int = DEGREE, leaf_sample: int = LEAF_SAMPLE, seed: int = SEED) -> Tree:
    rng = np.random.default_rng(seed)
    tree = Tree([], [], 0)

    def grow(x: np.ndarray) -> int:
        points = spread_points(x, degree, rng) if len(x) > leaf_sample else x[:0]
        if len(points) < 2:
            tree.leaves += 1
            return -tree.leaves
        node = len(tree.points)
        tree.points.append(points)
        tree.child.append([])
        own = squares(x, points).argmin(1)
        tree.child[node] = [grow(x[own == j]) for j in range(len(points))]
        return node

    if grow(sample) < 0:  # one leaf: a root with one split point
        tree.points, tree.child = [np.zeros((1, sample.shape[1]))], [[-1]]
    return tree


def walk(tree: Tree, x: np.ndarray):
    """(node, rows that reach it, their squared distances to its split points,
    the child that each belongs to)."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        sq = squares(x[rows], tree.points[node])
        own = sq.argmin(1)
        yield node, rows, sq, own
        todo += [(c, rows[own == j]) for j, c in enumerate(tree.child[node]) if c >= 0 and (own == j).any()]


def leaf_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int32)
    for node, rows, _, own in walk(tree, x):
        at = np.array(tree.child[node])[own]
        out[rows[at < 0]] = -1 - at[at < 0]
    return out


def reachable(tree: Tree, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): leaves that may hold a score of one of the row's windows
    ``low[r, w]`` to ``high[r, w]``."""
    rows_out, leaves_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    norm = (a * a).sum(1)
    todo = [(0, np.arange(len(a)))]
    while todo:
        node, rows = todo.pop()
        d = np.sqrt(np.maximum(squares(a[rows], tree.points[node]), 0.0))[:, :, None]
        near, far = tree.near[node][None], tree.far[node][None]
        least = np.maximum(np.maximum(d - far, near - d), 0.0).max(1)  # to any row under each child
        most = (d + far).min(1)
        small, large = tree.norms[node].T
        slack = 1e-3 + 1e-6 * (norm[rows][:, None] + large)
        best = (norm[rows][:, None] + large - least ** 2) / 2 + slack
        worst = (norm[rows][:, None] + small - most ** 2) / 2 - slack
        lo, hi = low[rows][:, None, :], high[rows][:, None, :]
        open_ = ((lo <= hi) & (best[:, :, None] >= lo) & (worst[:, :, None] <= hi)).any(2) & (large >= small)
        for j, c in enumerate(tree.child[node]):
            go = rows[open_[:, j]]
            if c >= 0 and len(go):
                todo.append((c, go))
            elif len(go):
                rows_out.append(go)
                leaves_out.append(np.full(len(go), -1 - c, np.int32))
    return np.concatenate(rows_out), np.concatenate(leaves_out)


# -- vectors in Arrow ---------------------------------------------------------

def dense(col) -> np.ndarray:
    """A list column as a matrix; short rows are filled with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.diff(col.offsets.to_numpy())
    flat = np.asarray(col.flatten(), np.float64)
    d = int(sizes.max(initial=0))
    if (sizes == d).all():
        return flat.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d))
    out[np.arange(d)[None, :] < sizes[:, None]] = flat
    return out


def exact_scores(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = max(a.shape[1], x.shape[1])
    if d * np.abs(a).max(initial=0) * np.abs(x).max(initial=0) >= EXACT:
        raise ValueError("inner products beyond 2^53 are not exact")
    return widen(a, d) @ widen(x, d).T


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole_steps(vec: Column, scale: int = SCALE) -> Column:
    return F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("int"))


# -- the index ----------------------------------------------------------------

@dataclass
class Index:
    """``rows``: id, label, vec, leaf, seq.  ``chunks[leaf]``: its chunks."""

    tree: Tree
    rows: DataFrame
    chunks: list[int]


def _ranges(tree: Tree):
    """Distance and norm ranges of a partition's rows, one row for each node,
    split point and child met (split point -1: the norms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [np.full((len(p) + 1, len(p)), np.inf) for p in tree.points]
        high = [np.full((len(p) + 1, len(p)), -np.inf) for p in tree.points]
        for b in batches:
            x = dense(b.column(0))
            norm = (x * x).sum(1)
            for node, rows, sq, own in walk(tree, x):
                value = np.column_stack((np.sqrt(np.maximum(sq, 0.0)), norm[rows]))
                for j in np.unique(own):
                    low[node][:, j] = np.minimum(low[node][:, j], value[own == j].min(0))
                    high[node][:, j] = np.maximum(high[node][:, j], value[own == j].max(0))
        cols: list[list] = [[], [], [], [], []]
        for node, lo in enumerate(low):
            for i, j in np.argwhere(np.isfinite(lo)):
                for c, v in zip(cols, (node, i, j, lo[i, j], high[node][i, j])):
                    c.append(v)
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                         names=["node", "i", "j", "low", "high"])

    return run


def build(rows: DataFrame, sample: int = SAMPLE, degree: int = DEGREE, leaf_sample: int = LEAF_SAMPLE,
          chunk_rows: int = CHUNK_ROWS) -> Index | None:
    """The tree over ``rows`` (id, label, vec) and every row in its leaf; None
    without rows."""
    some = rows.select("vec").orderBy(F.xxhash64("id"), "id", "vec").limit(sample).toArrow()["vec"]
    if not len(some):
        return None
    tree = split(dense(some), degree, leaf_sample)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf_of(tree, dense(b.column(2))), pa.int32())],
                                             names=["id", "label", "vec", "leaf"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    placed = rows.select("id", "label", "vec").mapInArrow(
        place, f"id {kinds['id']}, label {kinds['label']}, vec array<int>, leaf int")
    placed = reliable_checkpoint(placed.withColumn("seq", F.monotonically_increasing_id()))
    ranges = (placed.select("vec").mapInArrow(_ranges(tree), "node int, i int, j int, low double, high double")
              .groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect())
    tree.near = [np.full((len(p), len(p)), np.inf) for p in tree.points]
    tree.far = [np.full((len(p), len(p)), -np.inf) for p in tree.points]
    tree.norms = [np.tile([np.inf, -np.inf], (len(p), 1)) for p in tree.points]
    for r in ranges:
        if r.i == len(tree.points[r.node]):
            tree.norms[r.node][r.j] = r.low, r.high
        else:
            tree.near[r.node][r.i, r.j], tree.far[r.node][r.i, r.j] = r.low, r.high
    chunks = [1] * tree.leaves
    for r in placed.groupBy("leaf").count().collect():
        chunks[r["leaf"]] = -(-r["count"] // chunk_rows)
    return Index(tree, placed, chunks)


def visits(index: Index, asked: DataFrame, own_leaf: bool) -> DataFrame:
    """``asked`` (vec, leaf, low, high: its windows' ends) with one row for its
    own leaf, or for every other leaf that the ranges leave, in ``visit``."""
    if own_leaf:
        return asked.withColumn("visit", F.col("leaf"))
    tree = index.tree
    names = asked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high = dense(b.column(names.index("low"))), dense(b.column(names.index("high")))
            row, leaf = reachable(tree, dense(b.column(names.index("vec"))), low, high)
            other = leaf != b.column(names.index("leaf")).to_numpy()[row]
            taken = b.take(pa.array(row[other], pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(leaf[other], pa.int32())], names=[*names, "visit"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields)
    return asked.mapInArrow(run, schema + ", visit int")


def search(index: Index, visiting: DataFrame, kernel: Callable, schema: str, blocks: int) -> DataFrame:
    """``kernel(anchors, rows)`` for every block of anchors and chunk of a leaf
    that meet."""
    chunks = F.get(F.array(*[F.lit(c) for c in index.chunks]), F.col("visit"))
    asked = (visiting.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)))
             .withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1))))
    met = asked.select(F.col("visit").alias("leaf"), F.col("block").alias("of")).distinct()
    own = F.get(F.array(*[F.lit(c) for c in index.chunks]), F.col("leaf"))
    rows = index.rows.join(met, "leaf").select(
        "id", "label", "vec", F.col("leaf").alias("visit"),
        F.pmod(F.xxhash64("seq"), own).cast("int").alias("chunk"), F.col("of").alias("block"))
    keys = ["visit", "chunk", "block"]
    return asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(kernel, schema)


def best_in_rows(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` best allowed cells of each row: higher score,
    then smaller id."""
    s = np.where(allowed, scores, -np.inf)
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        allowed = allowed & (s >= kth[:, None])
    row, col = np.nonzero(allowed)
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row, "left")
    keep = np.arange(len(row)) - first < k
    return row[keep], col[keep]


def _tiles(anchors: pa.Table, rows: pa.Table):
    """(anchors of a tile, their scores, rows' ids, rows' labels)."""
    if not (anchors.num_rows and rows.num_rows):
        return
    a, x = dense(anchors.column("vec")), dense(rows.column("vec"))
    ids, labels = rows.column("id").to_numpy(), rows.column("label").to_numpy()
    for t in range(0, len(a), TILE):
        yield slice(t, t + TILE), exact_scores(a[t:t + TILE], x), ids, labels


def _positives(k: int):
    def kernel(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        for tile, s, ids, labels in _tiles(anchors, rows):
            own = {c: anchors.column(c).to_numpy()[tile] for c in ("a", "aid", "label", "floor")}
            ok = (labels[None, :] == own["label"][:, None]) & (ids[None, :] != own["aid"][:, None])
            r, c = best_in_rows(s, ok & (s >= own["floor"][:, None]), ids, k)
            for o, v in zip(out, (own["a"][r], ids[c], s[r, c].astype(np.int64))):
                o.append(v)
        return pa.table(dict(zip(("a", "id", "score"), map(np.concatenate, out))))

    return kernel


def _negatives(k: int, low: int, high: int):
    def kernel(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        lists = {c: anchors.column(c).combine_chunks() for c in ("wanted", "floor")}
        sizes = np.diff(lists["wanted"].offsets.to_numpy())
        ends = np.concatenate(([0], np.cumsum(sizes)))
        wanted = lists["wanted"].flatten().to_numpy().astype(np.float64)
        floor = lists["floor"].flatten().to_numpy().astype(np.float64)
        for tile, s, ids, labels in _tiles(anchors, rows):
            own = {c: anchors.column(c).to_numpy()[tile] for c in ("a", "aid", "label")}
            first, last = ends[tile.start], ends[min(tile.stop, len(sizes))]
            of = np.repeat(np.arange(len(own["a"])), sizes[tile])
            place = np.arange(first, last) - ends[tile.start + of]
            p, f = wanted[first:last], floor[first:last]
            ok = (labels[None, :] != own["label"][:, None]) & (ids[None, :] != own["aid"][:, None])
            for w in range(int(place.max(initial=-1)) + 1):  # the windows of the same place together
                at = np.flatnonzero(place == w)
                sw, pw = s[of[at]], p[at][:, None]
                r, c = best_in_rows(sw, ok[of[at]] & (low * pw <= 100 * sw) & (100 * sw <= high * pw)
                                    & (sw >= f[at][:, None]), ids, k)
                for o, v in zip(out, (own["a"][of[at][r]], np.full(len(r), w), ids[c], sw[r, c].astype(np.int64))):
                    o.append(v)
        return pa.table(dict(zip(("a", "p", "id", "score"), map(np.concatenate, out))))

    return kernel


def top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best rows of each key, with ``rank`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def twice(index: Index, asked: DataFrame, kernel: Callable, schema: str, keys: list[str], k: int, blocks: int,
          raised: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The best ``k`` of each key: the own leaf first, then what is left with
    the windows as ``raised`` by that."""
    here = reliable_checkpoint(top(search(index, visits(index, asked, True), kernel, schema, blocks), keys, k).drop("rank"))
    rest = search(index, visits(index, raised(here), False), kernel, schema, blocks)
    return top(here.unionByName(rest), keys, k)


def mine(vectors: DataFrame, anchor: Column, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES,
         low: int = LOW, high: int = HIGH, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding",
         label: str | Column = "label", anchor_block: int = ANCHOR_BLOCK, **index_options) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score; ``anchor`` marks the rows of ``vectors`` that are anchors."""
    label = F.col(label) if isinstance(label, str) else label
    vec = F.col(vec_col)
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & usable(vec)).select(
        F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
        whole_steps(vec, scale).alias("vec"), anchor.alias("anchor"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = build(rows.drop("anchor"), **index_options)
    if index is None:
        return vectors.sparkSession.createDataFrame([], schema)
    tree = index.tree

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf_of(tree, dense(b.column(2))), pa.int32())],
                                             names=["aid", "label", "vec", "leaf"])

    anchors = rows.where("anchor").select(F.col("id").alias("aid"), "label", "vec").distinct().mapInArrow(
        place, "aid long, label long, vec array<int>, leaf int")
    anchors = reliable_checkpoint(anchors.withColumn("a", F.monotonically_increasing_id()))
    blocks = -(-anchors.count() // anchor_block) or 1

    always, never = F.lit(float("-inf")), F.lit(float("inf"))
    asked = anchors.withColumn("floor", always).withColumn("low", F.array("floor")).withColumn("high", F.array(never))

    def raised_positives(here: DataFrame) -> DataFrame:
        worst = here.groupBy("a").agg(F.min("score").cast("double").alias("w"), F.count(F.lit(1)).alias("n"))
        held = anchors.join(worst, "a", "left")
        return (held.withColumn("floor", F.when(F.col("n") == n_positives, F.col("w")).otherwise(always)).drop("w", "n")
                .withColumn("low", F.array("floor")).withColumn("high", F.array(never)))

    positives = reliable_checkpoint(
        twice(index, asked, _positives(n_positives), "a long, id long, score long", ["a"], n_positives, blocks, raised_positives)
        .select("a", (F.col("rank") - 1).cast("long").alias("p"), F.col("id").alias("pid"), F.col("score").alias("ps")))
    # the positives of an anchor in order; those below 0 have no window
    wanted = positives.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("p", "ps"))).alias("w"))
    asked = anchors.join(wanted, "a").withColumn("wanted", F.transform("w", lambda x: x["ps"])).drop("w")

    def windows(df: DataFrame) -> DataFrame:
        ends = F.transform("wanted", lambda p: p * high / 100.0)
        return (df.withColumn("low", F.zip_with("wanted", "floor", lambda p, f: F.greatest(p * low / 100.0, f)))
                .withColumn("high", ends))

    def raised_negatives(here: DataFrame) -> DataFrame:
        worst = here.groupBy("a", "p").agg(F.min("score").cast("double").alias("w"), F.count(F.lit(1)).alias("n"))
        full = worst.where(F.col("n") == n_negatives).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("p", "w"))).alias("m"))
        floor = F.transform("wanted", lambda p, i: F.coalesce(F.element_at("m", i.cast("long")), always))
        return windows(asked.join(full, "a", "left").withColumn("floor", floor).drop("m"))

    start = windows(asked.withColumn("floor", F.transform("wanted", lambda p: always)))
    negatives = twice(index, start, _negatives(n_negatives, low, high), "a long, p long, id long, score long", ["a", "p"],
                      n_negatives, blocks, raised_negatives)
    return (negatives.join(positives, ["a", "p"]).join(anchors.select("a", "aid"), "a")
            .select(F.col("aid").alias("anchor_id"), F.col("pid").alias("positive_id"), "rank",
                    F.col("id").alias("negative_id"), F.col("ps").alias("positive_score"),
                    F.col("score").alias("negative_score")))


def sql() -> str:
    return f"""WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT row_number() OVER () AS a, * FROM (SELECT DISTINCT * FROM e WHERE vec_id % 100 = 0)),
s AS (SELECT a, a.vec_id AS aid, a.label = e.label AS same, e.vec_id AS id,
             CAST(list_inner_product(a.v, e.v) AS BIGINT) AS s
      FROM a JOIN e ON a.vec_id <> e.vec_id),
pos AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, id) AS p FROM s WHERE same QUALIFY p <= {N_POSITIVES}),
neg AS (SELECT pos.aid, pos.id AS pid, pos.s AS ps, s.id AS nid, s.s AS ns,
               row_number() OVER (PARTITION BY pos.a, p ORDER BY s.s DESC, s.id) AS rank
        FROM pos JOIN s ON pos.a = s.a
        WHERE NOT s.same AND {LOW} * pos.s <= 100 * s.s AND 100 * s.s <= {HIGH} * pos.s QUALIFY rank <= {N_NEGATIVES})
SELECT aid AS anchor_id, pid AS positive_id, CAST(rank AS INTEGER) AS rank, nid AS negative_id, ps AS positive_score,
       ns AS negative_score FROM neg"""
