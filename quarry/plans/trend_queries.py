"""Registered queries: substring counts and keyword trends by year."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import terms as TM, trends as TR
from quarry.plans import sqlparts as Q
from quarry.plans.registry import register
from quarry.session import reliable_checkpoint
from quarry.sources.tables import corpus

TREND_CTE = f"""{Q.topic_terms_ctes(n=100)},
tdocs AS (SELECT doc_id, cluster, year, lower(abstract) AS t FROM corpus WHERE cluster <> -1),
allterms AS (SELECT DISTINCT term FROM ranked),
occ AS (SELECT * FROM (SELECT d.doc_id, a.term, (strlen(d.t) - strlen(replace(d.t, a.term, ''))) // strlen(a.term) AS n
                       FROM tdocs d, allterms a) WHERE n > 0),
tot AS (SELECT term, sum(n) AS n FROM occ o JOIN tdocs d USING (doc_id) WHERE d.year BETWEEN 2015 AND 2025 GROUP BY term),
top20 AS (SELECT CAST(row_number() OVER (ORDER BY n DESC, term) AS INTEGER) AS rank, term, CAST(n AS BIGINT) AS n
          FROM tot QUALIFY rank <= 20)"""


def _trend_inputs(spark, sf_dir):
    c = corpus(spark, sf_dir)
    docs = c.where(F.col("cluster") != -1)
    # the 100-term lists are a bounded table read twice (term list, joins):
    # materialise it once
    terms100 = reliable_checkpoint(TM.topic_terms(c, n=TM.UPDATED_TOP_N_WORDS))
    # a written table: the ranking and the grid read it, the text pass runs once
    occ = TR.term_occurrences(docs, terms100.select("term"))
    return docs, terms100, occ


@register("distinct_terms", f"WITH {TREND_CTE} SELECT term FROM allterms")
def distinct_terms(spark, sf_dir):
    t = TM.topic_terms(corpus(spark, sf_dir), n=TM.UPDATED_TOP_N_WORDS)
    return t.select("term").distinct()


@register("count_substring", f"WITH {TREND_CTE} SELECT doc_id, term, CAST(n AS BIGINT) AS n FROM occ")
def count_substring(spark, sf_dir):
    return _trend_inputs(spark, sf_dir)[2]


@register("top_terms_global", f"WITH {TREND_CTE} SELECT rank, term, n FROM top20")
def top_terms_global(spark, sf_dir):
    docs, _, occ = _trend_inputs(spark, sf_dir)
    lo, hi = TR.GLOBAL_YEARS
    in_range = occ.join(docs.where(F.col("year").between(lo, hi)).select("doc_id"), "doc_id")
    return TR.top_terms_global(in_range, TR.TOP_N_TERMS)


@register("trend_by_year", f"""WITH {TREND_CTE},
grid AS (SELECT term, CAST(unnest(generate_series(2015, 2025)) AS INTEGER) AS year FROM top20),
cnt AS (SELECT o.term, d.year, sum(o.n) AS n FROM occ o JOIN tdocs d USING (doc_id) GROUP BY 1, 2)
SELECT g.term, g.year, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n FROM grid g LEFT JOIN cnt USING (term, year)""")
def trend_by_year(spark, sf_dir):
    docs, _, occ = _trend_inputs(spark, sf_dir)
    lo, hi = TR.GLOBAL_YEARS
    in_range = occ.join(docs.where(F.col("year").between(lo, hi)).select("doc_id"), "doc_id")
    top = TR.top_terms_global(in_range, TR.TOP_N_TERMS)
    return TR.trend_by_year(occ, docs, top, TR.GLOBAL_YEARS)


@register("trend_cluster", f"""WITH {TREND_CTE},
cterms AS (SELECT cluster, term FROM ranked WHERE rank <= 20),
cnt AS (SELECT d.cluster, o.term, d.year, sum(o.n) AS n FROM occ o JOIN tdocs d USING (doc_id)
        JOIN cterms c ON c.cluster = d.cluster AND c.term = o.term WHERE d.year BETWEEN 2020 AND 2025 GROUP BY 1, 2, 3),
seen AS (SELECT DISTINCT cluster, term FROM cnt WHERE n > 0),
grid AS (SELECT cluster, term, CAST(unnest(generate_series(2020, 2025)) AS INTEGER) AS year FROM seen)
SELECT g.cluster, g.term, g.year, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n FROM grid g LEFT JOIN cnt USING (cluster, term, year)""")
def trend_cluster(spark, sf_dir):
    docs, terms100, occ = _trend_inputs(spark, sf_dir)
    cterms = terms100.where(F.col("rank") <= TR.TOP_N_TERMS).select("cluster", "term")
    return TR.trend_by_cluster(occ, docs, cterms, TR.CLUSTER_YEARS)
