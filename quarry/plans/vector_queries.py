"""Registered queries: neighbours, similarity audit, centroids, topics,
cluster quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import quality, similarity as S, stats
from quarry.plans.registry import register
from quarry.plans.sqlparts import corpus_cte
from quarry.sources.tables import corpus, table

TOPK_CTE = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
vn AS (SELECT id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS nrm FROM v),
pairs AS (SELECT a.id AS doc_id, b.id AS nbr_id, list_dot_product(a.e, b.e) / (a.nrm * b.nrm + 1e-10) AS sim
          FROM vn a JOIN vn b ON a.id <> b.id),
topk AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 6) DESC, nbr_id) AS INTEGER) AS rank,
         nbr_id, round(sim, 6) AS sim FROM pairs QUALIFY rank <= 10)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))


def _topk(spark, sf_dir):
    return S.top_k_similar(_vectors(spark, sf_dir), k=S.TOP_K)


@register("cosine_topk", f"WITH {TOPK_CTE} SELECT doc_id, rank, nbr_id, sim FROM topk")
def cosine_topk(spark, sf_dir):
    return _topk(spark, sf_dir)


@register("cosine_topk_pruned", f"WITH {TOPK_CTE} SELECT doc_id, rank, nbr_id, sim FROM topk")
def cosine_topk_pruned(spark, sf_dir):
    """J7 through cells of pivots: the rows of ``cosine_topk``."""
    return S.top_k_pruned(_vectors(spark, sf_dir), k=S.TOP_K)


_wide_cols = ", ".join(
    f"max(CASE WHEN rank = {i} THEN nbr_id END) AS top_{i}_index, "
    f"max(CASE WHEN rank = {i} THEN sim END) AS top_{i}_similarity" for i in range(1, 11))


@register("neighbours_wide", f"WITH {TOPK_CTE} SELECT doc_id, {_wide_cols} FROM topk GROUP BY doc_id")
def neighbours_wide(spark, sf_dir):
    return S.neighbours_wide(_topk(spark, sf_dir))


@register("similarity_stats", f"""WITH {TOPK_CTE}
SELECT count(sim) AS n, round(avg(sim), 6) AS mean_sim, round(stddev_pop(sim), 6) AS std_sim FROM topk""")
def similarity_stats(spark, sf_dir):
    return stats.mean_std(_topk(spark, sf_dir), "sim")


def _hist_sql(bins: int, lo: str, hi: str, src: str = "topk", col: str = "sim") -> str:
    return f"""rng AS (SELECT {lo} AS lo, {hi} AS hi FROM {src}),
cnt AS (SELECT CAST(CASE WHEN hi > lo THEN least(floor(({col} - lo) * {bins} / (hi - lo)), {bins - 1}) ELSE 0 END AS INTEGER) AS bin,
        count(*) AS n FROM {src}, rng WHERE {col} BETWEEN lo AND hi GROUP BY 1),
axis AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins})),
hist AS (SELECT axis.bin, round(lo + axis.bin * ((hi - lo) / {bins}), 6) AS lo_edge,
         round(lo + (axis.bin + 1) * ((hi - lo) / {bins}), 6) AS hi_edge, coalesce(cnt.n, 0) AS n
         FROM axis LEFT JOIN cnt USING (bin), (SELECT DISTINCT lo, hi FROM rng))"""


@register("similarity_histogram", f"""WITH {TOPK_CTE},
{_hist_sql(50, 'min(sim)', 'max(sim)')}
SELECT bin, lo_edge, hi_edge, n FROM hist""")
def similarity_histogram(spark, sf_dir):
    return stats.histogram(_topk(spark, sf_dir), "sim", stats.HIST_BINS)


_FIXED = f"""{_hist_sql(100, 'CAST(0.2 AS DOUBLE)', 'CAST(1.0 AS DOUBLE)', src="(SELECT 1)")}"""
_FIXED = _FIXED.replace("FROM (SELECT 1), rng", "FROM topk, rng")


@register("similarity_histogram_fixed", f"""WITH {TOPK_CTE},
{_FIXED}
SELECT bin, lo_edge, hi_edge, n FROM hist""")
def similarity_histogram_fixed(spark, sf_dir):
    lo, hi = stats.FIXED_HIST_RANGE
    return stats.histogram(_topk(spark, sf_dir), "sim", stats.FIXED_HIST_BINS, lo, hi)


def _smooth_sql() -> str:
    radius, weights = stats.gaussian_weights()
    wl = "[" + ", ".join(f"CAST('{w!r}' AS DOUBLE)" for w in weights) + "]"
    return f"""taps AS (SELECT bin AS out, unnest(generate_series(0, {2 * radius})) AS k, unnest({wl}) AS w FROM hist),
nbin AS (SELECT count(*) AS nb FROM hist),
src AS (SELECT out, w, CAST(CASE WHEN out + k - {radius} < 0 THEN -(out + k - {radius}) - 1
                         WHEN out + k - {radius} > nb - 1 THEN 2 * nb - 1 - (out + k - {radius})
                         ELSE out + k - {radius} END AS INTEGER) AS src FROM taps, nbin)"""


@register("gaussian_smooth", f"""WITH {TOPK_CTE},
{_FIXED},
{_smooth_sql()}
SELECT src.out AS bin, round(sum(src.w * hist.n), 6) AS smoothed FROM src JOIN hist ON hist.bin = src.src GROUP BY src.out""")
def gaussian_smooth(spark, sf_dir):
    lo, hi = stats.FIXED_HIST_RANGE
    hist = stats.histogram(_topk(spark, sf_dir), "sim", stats.FIXED_HIST_BINS, lo, hi)
    return stats.gaussian_smooth(hist)


@register("percentile_limits", """
WITH q AS (SELECT quantile_cont(value, 0.02) AS p_lo, quantile_cont(value, 0.98) AS p_hi FROM events)
SELECT round(p_lo, 6) AS p_lo, round(p_hi, 6) AS p_hi, round(p_lo - 0.1 * (p_hi - p_lo), 6) AS axis_lo,
       round(p_hi + 0.1 * (p_hi - p_lo), 6) AS axis_hi FROM q""")
def percentile_limits(spark, sf_dir):
    return stats.axis_limits(table(spark, sf_dir, "events"), "value")


# ---------------------------------------------------------------- centroids

CENT_CTE = f"""{corpus_cte()},
members AS (SELECT * FROM corpus WHERE cluster <> -1),
cl AS (SELECT cluster, unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS i FROM members),
cent_long AS (SELECT cluster, i, avg(v) AS value FROM cl GROUP BY cluster, i),
cent AS (SELECT cluster, list(value ORDER BY i) AS centroid FROM cent_long GROUP BY cluster),
csz AS (SELECT cluster, count(*) AS n FROM members GROUP BY cluster),
dsim AS (SELECT c.doc_id, t.cluster AS topic,
         list_dot_product(c.embedding, t.centroid) / (sqrt(list_dot_product(c.embedding, c.embedding)) * sqrt(list_dot_product(t.centroid, t.centroid))) AS sim
         FROM corpus c, cent t)"""


def _members(spark, sf_dir):
    return corpus(spark, sf_dir).where(F.col("cluster") != -1)


@register("centroids", f"""WITH {CENT_CTE}
SELECT cluster, CAST(i - 1 AS INTEGER) AS dim, round(value, 6) AS value FROM cent_long""")
def centroids(spark, sf_dir):
    cl = S.centroids_long(_members(spark, sf_dir))
    return cl.select("cluster", "dim", F.round("value", 6).alias("value"))


@register("centroid_filter", f"""WITH {CENT_CTE}
SELECT d.doc_id, d.topic AS cluster, round(d.sim, 6) AS sim FROM dsim d JOIN members m ON m.doc_id = d.doc_id AND m.cluster = d.topic
WHERE d.sim > 0.5""")
def centroid_filter(spark, sf_dir):
    kept = S.centroid_filter(_members(spark, sf_dir), S.CENTROID_THRESHOLD)
    return kept.select("doc_id", "cluster", F.round("sim", 6).alias("sim"))


def _doc_topic(spark, sf_dir, top_n=None):
    c = corpus(spark, sf_dir)
    return S.doc_centroid_cosine(c, S.centroids(_members(spark, sf_dir)), top_n=top_n)


@register("centroid_filter_low", f"""WITH {CENT_CTE}
SELECT d.doc_id, d.topic AS cluster, round(d.sim, 6) AS sim FROM dsim d JOIN members m ON m.doc_id = d.doc_id AND m.cluster = d.topic
WHERE d.sim > 0.2""")
def centroid_filter_low(spark, sf_dir):
    """P11 with a threshold that some rows pass and others do not."""
    kept = S.centroid_filter(_members(spark, sf_dir), 0.2)
    return kept.select("doc_id", "cluster", F.round("sim", 6).alias("sim"))


@register("doc_topic_cosine", f"""WITH {CENT_CTE}
SELECT doc_id, CAST(topic AS INTEGER) AS topic, round(sim, 6) AS sim FROM dsim""")
def doc_topic_cosine(spark, sf_dir):
    return _doc_topic(spark, sf_dir).select("doc_id", "topic", F.round("sim", 6).alias("sim"))


@register("nearest_topic", f"""WITH {CENT_CTE}
SELECT doc_id, CAST(topic AS INTEGER) AS topic, round(sim, 6) AS sim FROM dsim
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(sim, 6) DESC, topic) = 1""")
def nearest_topic(spark, sf_dir):
    c = corpus(spark, sf_dir)
    best = S.doc_centroid_cosine(c, S.centroids(_members(spark, sf_dir)), best_only=True)
    return best.select("doc_id", "topic", F.round("sim", 6).alias("sim"))


@register("top_docs_per_topic", f"""WITH {CENT_CTE}
SELECT m.cluster AS topic, csz.n AS cluster_size,
       CAST(row_number() OVER (PARTITION BY m.cluster ORDER BY round(d.sim, 6) DESC, m.doc_id) AS INTEGER) AS rank,
       m.doc_id, m.title, m.journal, m.doi, m.year, round(d.sim, 6) AS probability
FROM members m JOIN dsim d ON d.doc_id = m.doc_id AND d.topic = m.cluster JOIN csz ON csz.cluster = m.cluster
QUALIFY rank <= 100""")
def top_docs_per_topic(spark, sf_dir):
    m = _members(spark, sf_dir)
    cents = S.centroids(m)
    scored = S.own_centroid_cosine(m, cents)
    ranked = S.top_members(scored, "sim", S.TOP_DOCS)
    sizes = cents.select("cluster", F.col("n").alias("cluster_size"))
    return ranked.join(sizes, "cluster").select(
        F.col("cluster").alias("topic"), "cluster_size", "rank", "doc_id", "title", "journal",
        "doi", "year", F.round("sim", 6).alias("probability"))


@register("representative_docs", f"""WITH {CENT_CTE}
SELECT CAST(topic AS INTEGER) AS topic,
       CAST(row_number() OVER (PARTITION BY topic ORDER BY round(sim, 6) DESC, doc_id) AS INTEGER) AS rank,
       doc_id, round(sim, 6) AS sim FROM dsim QUALIFY rank <= 100""")
def representative_docs(spark, sf_dir):
    ranked = S.top_members(_doc_topic(spark, sf_dir, S.TOP_DOCS), "sim", S.TOP_DOCS, group_col="topic")
    return ranked.select("topic", "rank", "doc_id", F.round("sim", 6).alias("sim"))


@register("topic_sizes", f"""WITH {corpus_cte()}
SELECT cluster, count(*) AS n FROM corpus GROUP BY cluster""")
def topic_sizes(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@register("biggest_topics", f"""WITH {corpus_cte()}
SELECT CAST(row_number() OVER (ORDER BY count(*) DESC, cluster) AS INTEGER) AS rank, cluster, count(*) AS n
FROM corpus WHERE cluster <> -1 GROUP BY cluster ORDER BY rank LIMIT 15""")
def biggest_topics(spark, sf_dir):
    sizes = (corpus(spark, sf_dir).where(F.col("cluster") != -1)
             .groupBy("cluster").agg(F.count(F.lit(1)).alias("n")))
    top = sizes.orderBy(F.desc("n"), F.asc("cluster")).limit(15)
    w = Window.orderBy(F.desc("n"), F.asc("cluster"))
    return top.select(F.row_number().over(w).cast("int").alias("rank"), "cluster", "n")


@register("noise_ratio", f"""WITH {corpus_cte()}
SELECT round(avg(CASE WHEN cluster = -1 THEN 1.0 ELSE 0.0 END), 6) AS noise_ratio,
       count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters, count(*) AS n_points FROM corpus""")
def noise_ratio(spark, sf_dir):
    return quality.noise_ratio(corpus(spark, sf_dir))


@register("silhouette_linear", f"""WITH {CENT_CTE},
d AS (SELECT m.doc_id, m.cluster AS own, t.cluster AS other, list_distance(m.embedding, t.centroid) AS d FROM members m, cent t),
pt AS (SELECT doc_id, max(CASE WHEN own = other THEN d END) AS a, min(CASE WHEN own <> other THEN d END) AS b FROM d GROUP BY doc_id)
SELECT round(avg(CASE WHEN b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM pt""")
def silhouette_linear(spark, sf_dir):
    return quality.silhouette_linear(corpus(spark, sf_dir))


@register("silhouette", f"""WITH {corpus_cte()},
pts AS (SELECT doc_id AS id, cluster, embedding AS e FROM corpus WHERE cluster <> -1),
d AS (SELECT a.id, a.cluster AS own, b.cluster AS other, sum(list_distance(a.e, b.e)) AS dsum, count(*) AS cnt
      FROM pts a, pts b GROUP BY 1, 2, 3),
pt AS (SELECT id, max(CASE WHEN own = other AND cnt > 1 THEN dsum / (cnt - 1) END) AS a,
       min(CASE WHEN own <> other THEN dsum / cnt END) AS b, max(CASE WHEN own = other THEN cnt END) AS own_n
       FROM d GROUP BY id)
SELECT round(avg(CASE WHEN own_n <= 1 OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM pt""")
def silhouette(spark, sf_dir):
    return quality.silhouette(corpus(spark, sf_dir), id_col="doc_id")


QUAL_CTE = f"""{CENT_CTE},
ml AS (SELECT doc_id, cluster, unnest(embedding) AS v, unnest(generate_series(1, len(embedding))) AS i FROM members),
pdist AS (SELECT ml.doc_id, ml.cluster, sqrt(sum((ml.v - c.value) * (ml.v - c.value))) AS d
          FROM ml JOIN cent_long c ON c.cluster = ml.cluster AND c.i = ml.i GROUP BY ml.doc_id, ml.cluster)"""


@register("davies_bouldin", f"""WITH {QUAL_CTE},
spread AS (SELECT cluster, avg(d) AS s FROM pdist GROUP BY cluster),
cd AS (SELECT a.cluster AS ci, b.cluster AS cj, sqrt(sum((a.value - b.value) * (a.value - b.value))) AS d
       FROM cent_long a JOIN cent_long b ON a.i = b.i AND a.cluster <> b.cluster GROUP BY 1, 2),
r AS (SELECT cd.ci, max(CASE WHEN cd.d = 0 THEN 0.0 ELSE (si.s + sj.s) / cd.d END) AS m
      FROM cd JOIN spread si ON si.cluster = cd.ci JOIN spread sj ON sj.cluster = cd.cj GROUP BY cd.ci),
allc AS (SELECT s.cluster, coalesce(r.m, 0.0) AS m FROM spread s LEFT JOIN r ON r.ci = s.cluster)
SELECT round(avg(m), 6) AS davies_bouldin FROM allc""")
def davies_bouldin(spark, sf_dir):
    return quality.davies_bouldin(corpus(spark, sf_dir))


@register("calinski_harabasz", f"""WITH {QUAL_CTE},
mu AS (SELECT i, avg(v) AS value FROM ml GROUP BY i),
bsum AS (SELECT sum(csz.n * dd) AS b, count(*) AS k FROM
         (SELECT c.cluster, sum((c.value - mu.value) * (c.value - mu.value)) AS dd FROM cent_long c JOIN mu ON mu.i = c.i GROUP BY c.cluster) x
         JOIN csz USING (cluster)),
wsum AS (SELECT sum(d * d) AS w, count(*) AS n FROM pdist)
SELECT round(CASE WHEN k > 1 THEN (b / (k - 1)) / (w / (n - k)) ELSE 0.0 END, 6) AS calinski_harabasz FROM bsum, wsum""")
def calinski_harabasz(spark, sf_dir):
    return quality.calinski_harabasz(corpus(spark, sf_dir))
