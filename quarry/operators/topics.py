"""Compositions of the reference's topic-model and audit runs (M11, M13,
M21), built from the operators of this package.

``fit_topics`` is the topic model: reduce the vectors (M3), density-cluster
the reduced points (M4), score class n-grams of the normalised texts
(A5-A7), rank them (W3), and assign every document a topic with a
membership score (cosine to its topic centroid in the original space).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import density, models, similarity as S, stats, terms as TM
from quarry.session import reliable_checkpoint

# Fixed values of the topic model used on the driver tables.
MIN_SAMPLES = 5
MIN_CLUSTER_SIZE = 10
KEYWORDS = 10


def fit_topics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "abstract",
               vec_col: str = "embedding", min_samples: int = MIN_SAMPLES,
               eps: float | None = None, min_cluster_size: int = MIN_CLUSTER_SIZE,
               n_words: int = TM.TOP_N_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (document_info, topic_terms, keywords).

    document_info: (doc_id, topic, probability) with topic -1 for noise and
    probability = cosine to the topic centroid (0 for noise).
    topic_terms: (topic, rank, term, score) for the non-noise topics.
    keywords: the terms' chain of MMR and ranking by vector
    (``topic_keywords``)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("abstract"))
    base = reliable_checkpoint(docs.select(F.col(id_col).alias("doc_id"), F.col(vec_col).cast("array<double>").alias("embedding")))
    reduced = models.reduce_dim(base.select("doc_id", "embedding"))
    pts = reduced.select("doc_id", F.array("x", "y").alias("xy"))
    labels = density.density_cluster(pts, min_samples, eps, min_cluster_size,
                                     id_col="doc_id", vec_col="xy").select("doc_id", "cluster")
    labelled = reliable_checkpoint(base.join(labels, "doc_id"))
    named = texts.join(labelled.select("doc_id", "cluster"), "doc_id")  # texts are read where they lie
    terms = TM.topic_terms(named, n=n_words).withColumnRenamed("cluster", "topic")
    members = labelled.where(F.col("cluster") != -1)
    scored = S.own_centroid_cosine(members, S.centroids(members))
    info = (labelled.select("doc_id", "cluster")
            .join(scored.select("doc_id", "sim"), "doc_id", "left")
            .select("doc_id", F.col("cluster").alias("topic"),
                    F.round(F.coalesce("sim", F.lit(0.0)), 6).alias("probability")))
    keywords = topic_keywords(named, terms.withColumnRenamed("topic", "cluster"))
    return info, terms, keywords


def topic_keywords(docs: DataFrame, terms: DataFrame, n: int = KEYWORDS, make_predict_fn=None) -> DataFrame:
    """M9 -> M10 inside the fit: a topic's diverse keywords (MMR over its
    terms), ordered by cosine to the topic's mean text vector.

    ``docs`` has (cluster, abstract), ``terms`` (cluster, term).  Output
    (topic, rank, term, sim)."""
    members = docs.where(F.col("cluster") != -1).select("cluster", "abstract")
    vectors = reliable_checkpoint(models.embed(members, "abstract", "embedding", make_predict_fn).drop("abstract"))
    topic = S.centroids(vectors).select(F.col("cluster").alias("topic"), F.col("centroid").alias("topic_vec"))
    cands = reliable_checkpoint(models.embed(
        terms.select(F.col("cluster").cast("int").alias("topic"), "term"), "term", "term_vec", make_predict_fn)
        .join(topic, "topic"))
    chosen = models.mmr(cands, "topic", n).select("topic", "term")
    scored = chosen.join(cands, ["topic", "term"]).withColumn("sim", S.cosine("term_vec", "topic_vec"))
    return models.rank_by_vector(scored, "topic").select("topic", "rank", "term", F.round("sim", 6).alias("sim"))


def topic_info(document_info: DataFrame) -> DataFrame:
    """Topic sizes, noise included."""
    return document_info.groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def similarity_audit(vectors: DataFrame, id_col: str = "id", vec_col: str = "embedding",
                     k: int = S.TOP_K) -> dict[str, DataFrame]:
    """J7 -> A3 -> A8 -> W6 over one vector table.  The neighbour table
    is materialised once and feeds every summary."""
    top = reliable_checkpoint(S.top_k_similar(vectors, k=k, id_col=id_col, vec_col=vec_col))
    lo, hi = stats.FIXED_HIST_RANGE
    fixed = stats.histogram(top, "sim", stats.FIXED_HIST_BINS, lo, hi)
    return {
        "neighbours": top,
        "wide": S.neighbours_wide(top, k),
        "stats": stats.mean_std(top, "sim"),
        "histogram": stats.histogram(top, "sim", stats.HIST_BINS),
        "histogram_fixed": fixed,
        "smoothed": stats.gaussian_smooth(fixed),
    }
