"""Vector similarity operators: exact top-k cosine (J7), wide neighbour
table (W5), centroids (A4), document-to-centroid cosine (J8), nearest topic
(J10), member and representative rankings (W1, W2), centroid filter (P11).

Vectors are ``array<double>`` columns.  Heavy linear algebra runs as NumPy
GEMM on Arrow batches (``mapInPandas`` / ``applyInPandas``); everything
else is built-in DataFrame operators.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import blocks, pivots
from quarry.session import reliable_checkpoint

# Fixed values of the reference.
TOP_K = 10
SIM_EPS = 1e-10            # cosine denominator guard in the neighbour audit
CENTROID_THRESHOLD = 0.5   # strict '>' filter on cosine to the centroid
TOP_DOCS = 100             # members / representatives kept per topic
SIM_DECIMALS = 6           # similarities are compared and reported rounded
CENTROID_BLOCK_BYTES = 32 << 20  # centroids that are broadcast at once


def cosine(a, b, eps: float = 0.0) -> Column:
    """Cosine of two array columns, JVM-side (fine for short vectors)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))
    nb = F.sqrt(F.aggregate(b, F.lit(0.0), lambda s, v: s + v * v))
    denom = na * nb + F.lit(eps)
    # zero vectors have cosine 0 (as sklearn's normalise-then-dot)
    return F.when(denom > 0, dot / denom).otherwise(F.lit(0.0))


# --------------------------------------------------------------------------
# J7 exact top-k neighbours
# --------------------------------------------------------------------------

PAIR_SCHEMA = "doc_id long, nbr_id long, sim double"


def _cosine_kernel(k: int, eps: float):
    """The k best neighbours of each row of the tiles that meet, as ``PAIR_SCHEMA``."""

    def kernel(tiles: list[pd.DataFrame], pairs: list[tuple[int, int]]) -> pd.DataFrame:
        vecs = [blocks.matrix(t["vec"]) for t in tiles]
        norms = [np.linalg.norm(v, axis=1) for v in vecs]
        ids = [t["id"].to_numpy(np.int64) for t in tiles]
        best = blocks.Best(ids, k, SIM_DECIMALS)
        for i, j in pairs:
            sim = (vecs[i] @ vecs[j].T) / (np.outer(norms[i], norms[j]) + eps)
            own = blocks.alike(ids[i], ids[j])
            if own is not None:
                sim[own] = -np.inf
            best.offer(i, sim, ids[j])
            if i != j:
                best.offer(j, sim.T, ids[i])
        doc, nbr, score = best.rows()
        return pd.DataFrame({"doc_id": doc, "nbr_id": nbr, "sim": score})

    return kernel


def top_k_similar(vectors: DataFrame, k: int = TOP_K, id_col: str = "id",
                  vec_col: str = "embedding", eps: float = SIM_EPS,
                  block_rows: int = blocks.DEFAULT_BLOCK_ROWS,
                  n_rows: int | None = None) -> DataFrame:
    """Exact cosine top-k per vector, self excluded.

    Output (doc_id, rank, nbr_id, sim) with rank 1..k by (sim desc, nbr_id
    asc) on 6-decimal similarities.  Each block pair keeps its local top-k
    per row, so the final window sees at most k * B candidates per row."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    n = n_rows if n_rows is not None else src.count()
    return _best(blocks.run_pairs(src, "id", n, _cosine_kernel(k, eps), PAIR_SCHEMA, block_rows), k)


def _best(cand: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("sim", SIM_DECIMALS)), F.asc("nbr_id"))
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("doc_id", F.col("rank").cast("int").alias("rank"), "nbr_id",
                    F.round("sim", SIM_DECIMALS).alias("sim")))


def top_k_pruned(vectors: DataFrame, k: int = TOP_K, id_col: str = "id", vec_col: str = "embedding",
                 eps: float = SIM_EPS, cell_rows: int = pivots.CELL_ROWS, max_pivots: int = pivots.MAX_PIVOTS,
                 block_rows: int = blocks.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """J7 with pruned pairs: the rows of ``top_k_similar``, where only those
    blocks meet that can hold one of the k nearest (``pivots``).

    The bounds are chords of unit vectors; a zero vector, whose cosine to all
    is 0, is placed at a right angle to them.  ``eps`` only draws a cosine
    towards 0, so chords bound every positive similarity; a row whose k-th
    similarity is not positive meets all cells."""

    def place(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.hstack([x / np.where(norm > 0, norm, 1.0), norm == 0])

    def limits(rows: pd.DataFrame, found: pd.DataFrame) -> np.ndarray:
        # the k-th, and what ties with it when rounded
        kth = found.groupby("doc_id")["sim"].agg(["min", "size"]).reindex(rows["id"])
        least = kth["min"].where(kth["size"] >= k).to_numpy() - 2 * 10.0 ** -SIM_DECIMALS
        return np.where(least > 0, np.sqrt(np.maximum(2 - 2 * np.nan_to_num(least), 0)), np.inf)

    search = pivots.Search(k, _cosine_kernel(k, eps), PAIR_SCHEMA, place, limits)
    return _best(pivots.nearest(pivots.usable(vectors, id_col, vec_col), search, cell_rows, max_pivots, block_rows), k)


def neighbours_wide(long: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row per document with top_i_index / top_i_similarity columns.

    Conditional aggregation with the k ranks named up front (no pivot
    value discovery pass)."""
    aggs = []
    for i in range(1, k + 1):
        aggs.append(F.max(F.when(F.col("rank") == i, F.col("nbr_id"))).alias(f"top_{i}_index"))
        aggs.append(F.max(F.when(F.col("rank") == i, F.col("sim"))).alias(f"top_{i}_similarity"))
    return long.groupBy("doc_id").agg(*aggs)


# --------------------------------------------------------------------------
# A4 centroids and everything measured against them
# --------------------------------------------------------------------------

def centroids_long(df: DataFrame, group_col: str = "cluster", vec_col: str = "embedding") -> DataFrame:
    """A4 in long form: (group, dim, value) = element-wise mean per group,
    one row per group and dimension of the finished centroids."""
    return centroids(df, group_col, vec_col).select(group_col, F.posexplode("centroid").alias("dim", "value"))


def centroids(df: DataFrame, group_col: str = "cluster", vec_col: str = "embedding") -> DataFrame:
    """A4: (group, centroid array<double>, n) -- one row per group.

    ``Summarizer.mean`` is a JVM aggregate over whole vectors with a
    map-side partial buffer of D doubles per group, so neither the row
    count nor the dimension is multiplied before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = df.select(group_col, array_to_vector(F.col(vec_col)).alias("_v"))
    return (v.groupBy(group_col)
            .agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("n"))
            .select(group_col, vector_to_array("_m").alias("centroid"), "n"))


def centroid_blocks(cents: DataFrame, group_col: str) -> list:
    """The centroid matrix in blocks of about ``CENTROID_BLOCK_BYTES``, each
    collected and broadcast by itself: one block for any usual number of
    topics, more for more."""
    cents = reliable_checkpoint(cents.select(group_col, "centroid"))
    size = cents.agg(F.count(F.lit(1)).alias("k"), F.max(F.size("centroid")).alias("d")).first()
    n = max(1, -(-size["k"] * (size["d"] or 0) * 8 // CENTROID_BLOCK_BYTES))
    out = []
    for b in range(n):
        rows = cents.where(F.pmod(F.xxhash64(group_col), F.lit(n)) == b).collect()
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        mat = np.array([r[1] for r in rows], dtype=np.float64) if rows else np.zeros((0, 0))
        out.append(cents.sparkSession.sparkContext.broadcast((ids, mat)))
    return out


def doc_centroid_cosine(docs: DataFrame, cents: DataFrame, group_col: str = "cluster",
                        id_col: str = "doc_id", vec_col: str = "embedding",
                        best_only: bool = False, top_n: int | None = None) -> DataFrame:
    """Cosine of every document to every centroid: (doc_id, topic, sim).

    The centroid matrix is k x D (k topics), broadcast in blocks of bounded
    size; each Arrow batch of documents is one GEMM per block.
    ``best_only`` keeps only the nearest topic per document (J10), without
    any shuffle while one block holds all centroids; ``top_n`` keeps only
    what can be among a topic's ``top_n`` documents (W2): that many rows per
    topic and batch."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    parts = [src.mapInPandas(_against(bc, best_only, top_n), "doc_id long, topic int, sim double")
             for bc in centroid_blocks(cents, group_col)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if best_only and len(parts) > 1:
        best = F.max_by(F.struct("topic", "sim"), F.struct(F.round("sim", SIM_DECIMALS), -F.col("topic")))
        out = out.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.topic", "b.sim")
    return out


def _against(bc, best_only: bool, top_n: int | None):
    """The batch function that scores vectors against one centroid block."""
    def score(batches):
        ids, mat = bc.value
        cn = np.linalg.norm(mat, axis=1) if mat.size else np.zeros(0)
        for pdf in batches:
            if len(pdf) == 0 or len(ids) == 0:
                continue
            x = blocks.matrix(pdf["vec"])
            xn = np.linalg.norm(x, axis=1)
            denom = np.outer(xn, cn)
            with np.errstate(divide="ignore", invalid="ignore"):
                sim = np.where(denom > 0, (x @ mat.T) / np.where(denom > 0, denom, 1.0), 0.0)
            if best_only:
                # J10 inside the batch: highest 6-decimal cosine, then lowest topic
                order = np.lexsort((np.broadcast_to(ids, sim.shape), -np.round(sim, SIM_DECIMALS)), axis=1)
                pick = order[:, 0]
                yield pd.DataFrame({
                    "doc_id": pdf["id"].to_numpy(np.int64),
                    "topic": ids[pick].astype(np.int32),
                    "sim": sim[np.arange(len(pdf)), pick],
                })
                continue
            if top_n is not None:
                topic, doc, score_ = blocks.top_cells(sim.T, ids, pdf["id"].to_numpy(np.int64), top_n, SIM_DECIMALS)
                yield pd.DataFrame({"doc_id": doc, "topic": topic.astype(np.int32), "sim": score_})
                continue
            yield pd.DataFrame({
                "doc_id": np.repeat(pdf["id"].to_numpy(np.int64), len(ids)),
                "topic": np.tile(ids, len(pdf)).astype(np.int32),
                "sim": sim.reshape(-1),
            })

    return score


def nearest_topic(sims: DataFrame) -> DataFrame:
    """Per document the topic with the highest cosine (ties: lower id)."""
    best = F.max_by(F.struct("topic", "sim"),
                    F.struct(F.round("sim", SIM_DECIMALS), -F.col("topic")))
    return (sims.groupBy("doc_id").agg(best.alias("b"))
            .select("doc_id", F.col("b.topic").alias("topic"),
                    F.round("b.sim", SIM_DECIMALS).alias("sim")))


def own_centroid_cosine(df: DataFrame, cents: DataFrame, group_col: str = "cluster",
                        vec_col: str = "embedding") -> DataFrame:
    """Cosine of each row to its own group's centroid (column ``sim``).

    The centroid side has one row per group; AQE broadcasts it when it is
    small and keeps a shuffle join otherwise."""
    c = cents.select(group_col, "centroid")
    return (df.join(c, group_col)
            .withColumn("sim", cosine(F.col(vec_col), F.col("centroid")))
            .drop("centroid"))


def centroid_filter(df: DataFrame, threshold: float = CENTROID_THRESHOLD,
                    group_col: str = "cluster", vec_col: str = "embedding") -> DataFrame:
    """Keep rows whose cosine to their group centroid is > threshold."""
    scored = own_centroid_cosine(df, centroids(df, group_col, vec_col), group_col, vec_col)
    return scored.where(F.col("sim") > threshold)


def top_members(df: DataFrame, score_col: str, n: int = TOP_DOCS,
                group_col: str = "cluster", id_col: str = "doc_id") -> DataFrame:
    """W1/W2 ranking: best n rows per group by (rounded score desc, id asc)."""
    w = Window.partitionBy(group_col).orderBy(F.desc(F.round(score_col, SIM_DECIMALS)), F.asc(id_col))
    return (df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .withColumn("rank", F.col("rank").cast("int")))
