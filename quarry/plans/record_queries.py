"""Registered queries: dedupe, combine, fallback and dictionary joins,
lookups with defaults, row index and batch ranges, harvest generation and
payload parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import harvest as H, quality as QU, records as R
from quarry.plans.registry import register
from quarry.plans.sqlparts import corpus_cte
from quarry.sources.tables import corpus, doi_of, table, title_of, TITLE_SQL


@register("dedupe_keep_first", """
SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text""")
def dedupe_keep_first(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return R.keep_first(docs, ["digest"], "doc_id").select("doc_id", "n_copies")


PAGE_ENTRIES_SQL = r"""pe AS (
  SELECT page_id, url,
         nullif(replace(replace(replace(replace(replace(replace(
           regexp_extract(html, '(?s)<title>(.*?)</title>', 1),
           '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '') AS title,
         regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS pub_name,
         CASE WHEN regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/(\d+)', 1) = '' THEN NULL
              ELSE '10.0/' || regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/(\d+)', 1) END AS doi
  FROM pages)"""


@register("feed_entries", f"WITH {PAGE_ENTRIES_SQL} SELECT page_id, url, title, pub_name, doi FROM pe")
def feed_entries(spark, sf_dir):
    return H.page_entries(table(spark, sf_dir, "pages"))


@register("atom_feed", f"""WITH {PAGE_ENTRIES_SQL}
SELECT url, title, pub_name, CASE WHEN page_id % 4 <> 0 THEN doi END AS doi FROM pe WHERE title IS NOT NULL
UNION ALL SELECT url || '?copy', title, pub_name, doi FROM pe WHERE title IS NOT NULL AND page_id % 3 = 0""")
def atom_feed(spark, sf_dir):
    """Atom search pages built from the given pages: every third has two
    entries, every fourth first entry no DOI, pages without title no entry."""
    pe = H.page_entries(table(spark, sf_dir, "pages"))

    def xml(text):
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return text

    def entry(url, doi):
        tag = lambda name, value: F.concat(F.lit(f"<{name}>"), xml(value), F.lit(f"</{name}>"))
        return F.concat(F.lit("<entry>"), tag("prism:url", url), tag("dc:title", F.col("title")),
                        tag("prism:publicationName", F.col("pub_name")),
                        F.coalesce(tag("prism:doi", doi), F.lit("")), F.lit("</entry>"))

    first = entry(F.col("url"), F.when(F.col("page_id") % 4 != 0, F.col("doi")))
    second = F.when(F.col("page_id") % 3 == 0, entry(F.concat(F.col("url"), F.lit("?copy")), F.col("doi")))
    body = F.when(F.col("title").isNotNull(), F.concat(first, F.coalesce(second, F.lit(""))))
    space = f'<feed xmlns="{H.ATOM}" xmlns:prism="http://prismstandard.org/namespaces/basic/2.0/" xmlns:dc="http://purl.org/dc/elements/1.1/">'
    feeds = pe.select(F.concat(F.lit(space), F.coalesce(body, F.lit("")), F.lit("</feed>")).alias("payload"))
    return H.parse_atom_feed(feeds)


@register("combine_queries", f"""WITH {PAGE_ENTRIES_SQL}
SELECT doi, title, min(page_id) AS page_id, count(*) AS n_copies FROM pe
WHERE doi IS NOT NULL AND title IS NOT NULL GROUP BY doi, title""")
def combine_queries(spark, sf_dir):
    links = H.page_entries(table(spark, sf_dir, "pages")).select("doi", "title", "page_id")
    # Two harvests of one table, one with a column that the other lacks
    odd = F.col("page_id") % 2 == 1
    frames = [links.where(odd).withColumn("origin", F.lit("odd")), links.where(~odd)]
    return R.combine(frames, ["doi", "title"], ["doi", "title"], "page_id").drop("origin")


@register("page_links", f"""WITH {PAGE_ENTRIES_SQL}
SELECT page_id, '{H.ARTICLE_BASE}' || coalesce(doi, 'None') || '{H.ARTICLE_SUFFIX}' AS link FROM pe""")
def page_links(spark, sf_dir):
    pe = H.page_entries(table(spark, sf_dir, "pages"))
    return pe.select("page_id", H.article_link(F.col("doi")).alias("link"))


@register("dict_join_last", f"""WITH {PAGE_ENTRIES_SQL},
d AS (SELECT doi, arg_max(url, page_id) AS url FROM pe WHERE doi IS NOT NULL GROUP BY doi)
SELECT x.doc_id, coalesce(d.url, 'Unknown') AS link
FROM documents x LEFT JOIN d ON d.doi = '10.0/' || CAST(x.doc_id AS VARCHAR)""")
def dict_join_last(spark, sf_dir):
    pe = H.page_entries(table(spark, sf_dir, "pages")).where(F.col("doi").isNotNull())
    mapping = R.last_wins(pe, "doi", "url", "page_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", doi_of(F.col("doc_id")).alias("doi"))
    return R.lookup(docs, mapping, "doi", "url", out="link").select("doc_id", "link")


@register("lookup_default", """
SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'Unknown') AS category
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def lookup_default(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("category"))
    return R.lookup(docs, labels, "doc_id", "category")


@register("null_sentinels", """
SELECT doc_id, CASE WHEN CAST(quality AS VARCHAR) IN ('None', '0', '2', '3', '4') THEN NULL
                    ELSE CAST(quality AS VARCHAR) END AS quality FROM labels""")
def null_sentinels(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.select("doc_id", T.null_sentinels(F.col("quality").cast("string")).alias("quality"))


@register("fallback_join", f"""WITH {corpus_cte()},
lft AS (SELECT doc_id, '10.0/' || CAST(doc_id AS VARCHAR) AS doi,
        lower(regexp_replace({TITLE_SQL}, '^[{T.PY_WHITESPACE}]+|[{T.PY_WHITESPACE}]+$', '', 'g')) ||
        lower(regexp_replace(text, '^[{T.PY_WHITESPACE}]+|[{T.PY_WHITESPACE}]+$', '', 'g')) AS k FROM documents),
rdoi AS (SELECT doi, min(doc_id) AS m FROM corpus GROUP BY doi),
rkey AS (SELECT lower(regexp_replace(title, '^[{T.PY_WHITESPACE}]+|[{T.PY_WHITESPACE}]+$', '', 'g')) ||
         lower(regexp_replace(abstract, '^[{T.PY_WHITESPACE}]+|[{T.PY_WHITESPACE}]+$', '', 'g')) AS k, min(doc_id) AS m
         FROM corpus GROUP BY 1)
SELECT l.doc_id, coalesce(rdoi.m, rkey.m) AS matched_id, CASE WHEN rdoi.m IS NOT NULL THEN 'doi' ELSE 'key' END AS matched_by
FROM lft l LEFT JOIN rdoi ON rdoi.doi = l.doi LEFT JOIN rkey ON rkey.k = l.k
WHERE rdoi.m IS NOT NULL OR rkey.m IS NOT NULL""")
def fallback_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    left = docs.select("doc_id", doi_of(F.col("doc_id")).alias("doi"),
                       title_of().alias("title"), F.col("text").alias("abstract"))
    right = corpus(spark, sf_dir).select("doc_id", "doi", "title", "abstract")
    return R.fallback_join(left, right, "doc_id", "doc_id").select(
        "doc_id", "matched_id", "matched_by")


@register("row_index", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx,
       CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / 10000) AS INTEGER) AS batch_id,
       md5(text) AS text_md5, lang, source, n_chars FROM documents""")
def row_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text_md5", F.md5("text")).drop("text")
    idx = R.dense_index(docs, "doc_id")
    return idx.withColumn("batch_id", R.batch_of(F.col("idx")))


@register("batch_ranges", """
WITH i AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents),
t AS (SELECT count(*) AS total FROM documents)
SELECT CAST(floor(idx / 10000) AS INTEGER) AS batch_id, CAST(floor(idx / 10000) * 10000 AS BIGINT) AS start,
       CAST(least((floor(idx / 10000) + 1) * 10000, total) AS BIGINT) AS "end", count(*) AS n
FROM i, t GROUP BY 1, 2, 3""")
def batch_ranges(spark, sf_dir):
    idx = R.dense_index(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return R.batch_ranges(idx)


def _quote_sql(col: str) -> str:
    return (f"replace(replace(replace(replace(url_encode({col}), '+', '%20'), '%7E', '~'), "
            f"'*', '%2A'), '%2F', '/')")


_TPL_SQL = " ".join(
    "WHEN {} THEN '{}' || term || '{}'".format(
        tid, *[p.replace("'", "''") for p in tpl.split("{}")])
    for tid, tpl in H.QUERY_TEMPLATES.items() if tid in (1, 2))


@register("term_page_cross", f"""
WITH terms AS (SELECT DISTINCT p_name AS term FROM part),
q AS (SELECT term, template_id, CASE template_id {_TPL_SQL} END AS query FROM terms, (SELECT unnest([1, 2]) AS template_id)),
r AS (SELECT term, template_id, query, unnest(generate_series(0, 5900, 100)) AS start FROM q)
SELECT term, template_id, query, CAST(start AS INTEGER) AS start,
       '{H.SEARCH_BASE}start=' || CAST(start AS VARCHAR) || '&count=100&query=' || {_quote_sql('query')} AS url FROM r""")
def term_page_cross(spark, sf_dir):
    terms = table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct()
    return H.search_requests(terms, "term", (1, 2))


_ALL_TPL_SQL = " ".join(
    "WHEN {} THEN '{}' || term || '{}'".format(tid, *[p.replace("'", "''") for p in tpl.split("{}")])
    for tid, tpl in H.QUERY_TEMPLATES.items())


@register("term_families", f"""
WITH fam AS (SELECT DISTINCT p_name AS term, unnest([1, 2]) AS template_id FROM part
             UNION ALL SELECT n_name, unnest([3, 4]) FROM nation),
q AS (SELECT term, template_id, CASE template_id {_ALL_TPL_SQL} END AS query FROM fam),
r AS (SELECT term, template_id, query, unnest(generate_series(0, 5900, 100)) AS start FROM q)
SELECT term, template_id, query, CAST(start AS INTEGER) AS start,
       '{H.SEARCH_BASE}start=' || CAST(start AS VARCHAR) || '&count=100&query=' || {_quote_sql('query')} AS url FROM r""")
def term_families(spark, sf_dir):
    """The requests of several term families, each with its templates."""
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("term")).distinct()
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term"))
    return H.search_requests(parts, "term", (1, 2)).unionByName(H.search_requests(nations, "term", (3, 4)))


@register("search_status", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type END AS status_text,
       CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 0
            ELSE coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0) END AS total_results FROM events""")
def search_status(spark, sf_dir):
    """S7 on payloads built from the event log: every fifth is an error, every
    seventh has an unreadable total."""
    total = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise(F.get_json_object("props", "$.k"))
    failed = F.to_json(F.struct(F.struct(F.struct(F.col("event_type").alias("statusText")).alias("status"))
                                .alias("service-error")))
    found = F.to_json(F.struct(F.struct(total.alias("opensearch:totalResults")).alias("search-results")))
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 5 == 0, failed).otherwise(found).alias("payload"))
    err, n = H.search_status(F.col("payload"))
    return ev.select("event_id", err.alias("status_text"), n.alias("total_results"))


@register("document_fields", f"""WITH {PAGE_ENTRIES_SQL}
SELECT page_id, CASE WHEN good THEN title END AS abstract, CASE WHEN good THEN url END AS title,
       CASE WHEN good THEN 'March 2021' END AS date, CASE WHEN good THEN pub_name END AS journal,
       CASE WHEN good THEN 'ok' ELSE 'failed' END AS status
FROM (SELECT *, page_id % 6 <> 0 AND page_id % 4 <> 0 AND title IS NOT NULL AS good FROM pe)""")
def document_fields(spark, sf_dir):
    """Every sixth read failed, every fourth payload is no JSON."""
    pe = H.page_entries(table(spark, sf_dir, "pages"))
    record = F.to_json(F.struct(F.struct(
        F.col("title").alias("dc:description"), F.col("url").alias("dc:title"),
        F.lit("March 2021").alias("prism:coverDisplayDate"), F.col("pub_name").alias("prism:publicationName")
    ).alias("coredata")))
    got = pe.select("page_id", F.when(F.col("page_id") % 4 == 0, F.lit("<html>")).otherwise(record).alias("payload"),
                    (F.col("page_id") % 6 != 0).alias("ok"))
    return H.document_fields(got, "page_id").withColumnRenamed("doi", "page_id")


@register("index_slice", """
SELECT doc_id, idx FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
WHERE idx >= 50 AND idx <= 150""")
def index_slice(spark, sf_dir):
    idx = R.dense_index(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return R.index_slice(idx, 50, 150, inclusive=True).select("doc_id", "idx")


@register("small_batches", """
WITH i AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents),
t AS (SELECT count(*) AS total FROM documents)
SELECT CAST(floor(idx / 64) AS INTEGER) AS batch_id, CAST(floor(idx / 64) * 64 AS BIGINT) AS start,
       CAST(least((floor(idx / 64) + 1) * 64, total) AS BIGINT) AS "end", count(*) AS n
FROM i, t GROUP BY 1, 2, 3""")
def small_batches(spark, sf_dir):
    """P15 with batches of 64 rows: many batches, the last one short."""
    idx = R.dense_index(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return R.batch_ranges(idx, size=64)


@register("cast_all_string", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality, "
                             "CAST(toxic AS VARCHAR) AS toxic FROM labels")
def cast_all_string(spark, sf_dir):
    return R.cast_all_string(table(spark, sf_dir, "labels"))


@register("flag_best", """
WITH t AS (SELECT c_nationkey AS number, round(avg(c_acctbal), 7) AS ss, CAST(count(*) AS DOUBLE) AS dbi,
           CAST(min(c_custkey) AS DOUBLE) AS chi FROM customer GROUP BY c_nationkey),
b AS (SELECT * FROM t ORDER BY number LIMIT 1)
SELECT t.number, round(t.ss, 6) = round(b.ss, 6) AND t.dbi = b.dbi AND t.chi = b.chi AS best FROM t, b""")
def flag_best(spark, sf_dir):
    """P10: one row per nation stands for a trial; the first is the saved best."""
    t = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("number")).agg(
        F.round(F.avg("c_acctbal"), 7).alias("ss"), F.count(F.lit(1)).cast("double").alias("dbi"),
        F.min("c_custkey").cast("double").alias("chi"))
    b = t.orderBy("number").first()
    return QU.flag_best(t, b.ss, b.dbi, b.chi).select("number", "best")


@register("pareto_front", """
WITH t AS (SELECT c_nationkey AS number, CAST(count(*) AS DOUBLE) AS ss, CAST(min(c_custkey) AS DOUBLE) AS dbi,
           CAST(max(c_custkey) AS DOUBLE) AS chi FROM customer GROUP BY c_nationkey),
f AS (SELECT * FROM t a WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.ss >= a.ss AND b.chi >= a.chi AND b.dbi <= a.dbi
      AND (b.ss > a.ss OR b.chi > a.chi OR b.dbi < a.dbi)))
SELECT number, ss, dbi, chi, row_number() OVER (ORDER BY number) = 1 AS best FROM f""")
def pareto_front(spark, sf_dir):
    """M8: one row per nation stands for a trial."""
    t = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("number")).agg(
        F.count(F.lit(1)).cast("double").alias("ss"), F.min("c_custkey").cast("double").alias("dbi"),
        F.max("c_custkey").cast("double").alias("chi"))
    return QU.pareto_front(t)


@register("prefix_label", "SELECT doc_id, source || ': ' || lang AS plain, "
                          "source || ' - Subtheme ' || CAST(n_chars AS VARCHAR) || ': ' || lang || ' - ' || text AS full FROM documents")
def prefix_label(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.prefix_label("source", "lang").alias("plain"),
        T.prefix_label("source", "text", "n_chars", "lang").alias("full"))


@register("fallback_text", """
SELECT doc_id, coalesce(CASE WHEN doc_id % 3 > 0 THEN lang END, substring(CASE WHEN doc_id % 9 > 0 THEN text END, 1, 500),
                        '[SUMMARY FAILED]') AS summary FROM documents""")
def fallback_text(spark, sf_dir):
    """every third summary is missing, every ninth text too."""
    made = F.when(F.col("doc_id") % 3 > 0, F.col("lang"))
    source = F.when(F.col("doc_id") % 9 > 0, F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.fallback_text(made, source).alias("summary"))


@register("attached_docs", f"""WITH {corpus_cte()},
m AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doi END AS doi, title, abstract FROM corpus),
lft AS (SELECT doc_id, doi, lower(regexp_replace(title, '^[{T.PY_WHITESPACE}]+|[{T.PY_WHITESPACE}]+$', '', 'g')) ||
        lower(regexp_replace(abstract, '^[{T.PY_WHITESPACE}]+|[{T.PY_WHITESPACE}]+$', '', 'g')) AS k FROM m),
rkey AS (SELECT lower(regexp_replace(title, '^[{T.PY_WHITESPACE}]+|[{T.PY_WHITESPACE}]+$', '', 'g')) ||
        lower(regexp_replace(abstract, '^[{T.PY_WHITESPACE}]+|[{T.PY_WHITESPACE}]+$', '', 'g')) AS k, min(doc_id) AS d FROM corpus GROUP BY 1),
hit AS (SELECT l.doc_id, coalesce(c.doc_id, r.d) AS matched_id, CASE WHEN c.doc_id IS NULL THEN 'key' ELSE 'doi' END AS matched_by
        FROM lft l LEFT JOIN corpus c ON c.doi = l.doi LEFT JOIN rkey r ON r.k = l.k)
SELECT h.doc_id, h.matched_id, h.matched_by, c.year, c.journal, len(c.embedding) AS dims, round(list_sum(c.embedding), 6) AS vec_sum
FROM hit h JOIN corpus c ON c.doc_id = h.matched_id""")
def attached_docs(spark, sf_dir):
    """Rows that lost every fourth DOI get year, journal and vector of
    the row they match."""
    c = corpus(spark, sf_dir)
    left = c.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("doi")).alias("doi"), "title", "abstract")
    hit = R.fallback_join(left, c.select("doc_id", "doi", "title", "abstract"), "doc_id", "doc_id")
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6)
    return R.attach(hit, c, "matched_id", "doc_id", ["year", "journal", "embedding"]).select(
        "doc_id", "matched_id", "matched_by", "year", "journal", F.size("embedding").alias("dims"), total.alias("vec_sum"))
