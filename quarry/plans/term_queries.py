"""Registered queries: normalisation, n-grams, class TF-IDF, keywords."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import terms
from quarry.plans import sqlparts as Q
from quarry.plans.registry import register
from quarry.sources.tables import corpus, table


@register("preprocess_docs", f"""
SELECT doc_id, {Q.preprocess('text')} AS doc FROM documents""")
def preprocess_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.preprocess("text").alias("doc"))


@register("ngram_counts", f"""
WITH {Q.topic_terms_ctes()}
SELECT cluster, term, tf FROM counts""")
def ngram_counts(spark, sf_dir):
    docs = terms.clustered_docs(corpus(spark, sf_dir))
    return terms.class_term_counts(docs)


@register("df_bounds", f"""
WITH {Q.topic_terms_ctes()}
SELECT DISTINCT term, n_classes, CAST(f AS BIGINT) AS f FROM kept""")
def df_bounds(spark, sf_dir):
    docs = terms.clustered_docs(corpus(spark, sf_dir))
    n_cls = terms.n_classes(docs)
    kept = terms.df_bounds(terms.class_term_counts(docs, with_stats=True), n_cls)
    return kept.select("term", "n_classes", "f").distinct()


@register("class_tfidf", f"""
WITH {Q.topic_terms_ctes()}
SELECT cluster, term, tf, round(score, 6) AS score FROM scored""")
def class_tfidf(spark, sf_dir):
    docs = terms.clustered_docs(corpus(spark, sf_dir))
    n_cls = terms.n_classes(docs)
    kept = terms.df_bounds(terms.class_term_counts(docs, with_stats=True), n_cls)
    scored = terms.class_tfidf(kept, n_cls)
    return scored.select("cluster", "term", "tf", F.round("score", 6).alias("score"))


@register("top_terms_per_class", f"""
WITH {Q.topic_terms_ctes(n=20)}
SELECT cluster, rank, term, round(score, 6) AS score FROM ranked""")
def top_terms_per_class(spark, sf_dir):
    tt = terms.topic_terms(corpus(spark, sf_dir), n=terms.TOP_N_WORDS)
    return tt.select("cluster", "rank", "term", F.round("score", 6).alias("score"))


@register("update_topics_100", f"""
WITH {Q.topic_terms_ctes(n=100)}
SELECT cluster, rank, term, round(score, 6) AS score FROM ranked""")
def update_topics_100(spark, sf_dir):
    tt = terms.topic_terms(corpus(spark, sf_dir), n=terms.UPDATED_TOP_N_WORDS)
    return tt.select("cluster", "rank", "term", F.round("score", 6).alias("score"))


@register("top5_keywords", f"""
WITH {Q.topic_terms_ctes(n=20)},
topics AS (SELECT DISTINCT cluster FROM corpus),
firsts AS (SELECT cluster, string_agg(term, ', ' ORDER BY rank) AS words FROM ranked WHERE rank <= 5 GROUP BY cluster)
SELECT t.cluster, CASE WHEN t.cluster = -1 THEN 'Noise' ELSE coalesce(f.words, '') END AS keywords
FROM topics t LEFT JOIN firsts f USING (cluster)""")
def top5_keywords(spark, sf_dir):
    c = corpus(spark, sf_dir)
    tt = terms.topic_terms(c, n=terms.TOP_N_WORDS)
    return terms.keywords_label(tt, c.select("cluster").distinct())
