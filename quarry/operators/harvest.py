"""Harvest operators: search request generation (J1, F16-F18, P16), feed
and status parsing of landed payloads (S6, S7), link building (P2).

HTTP itself is out of scope: jobs start from landed payloads.  Request
generation is a ``Generate`` (explode of the page axis) per term row, not a
join, so it is linear in the number of terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the reference's search harvest: page axis and templates.
PAGE_SIZE = 100
LAST_START = 5900
QUERY_TEMPLATES = {
    1: "'plastic' AND '{}' AND ('life cycle analysis' OR 'life cycle assessment')",
    2: "('recycling technology' OR 'recycle') AND 'plastic' AND '{}'",
    3: "'{}' AND ('life cycle analysis' OR 'life cycle assessment')",
    4: "('recycling technology' OR 'recycle') AND '{}'",
}
# Credentials are never put into URLs; endpoints are parameters.
SEARCH_BASE = "https://api.example.org/content/search?"
ARTICLE_BASE = "https://api.example.org/content/article/doi/"
ARTICLE_SUFFIX = ""

ATOM = "http://www.w3.org/2005/Atom"


def page_starts() -> Column:
    """0, 100, ..., 5900 (60 pages of 100 results)."""
    return F.sequence(F.lit(0), F.lit(LAST_START), F.lit(PAGE_SIZE))


def build_query(template_id: Column, term: Column) -> Column:
    """fill the Boolean template with the term."""
    expr = F.lit(None).cast("string")
    for tid, tpl in QUERY_TEMPLATES.items():
        left, right = tpl.split("{}")
        expr = F.when(template_id == tid, F.concat(F.lit(left), term, F.lit(right))).otherwise(expr)
    return expr


def python_quote(text: Column) -> Column:
    """F16: ``urllib.parse.quote`` (safe '/'): %20 for space, '~' and '/' raw,
    '*' encoded."""
    enc = F.url_encode(text)
    for a, b in (("+", "%20"), ("%7E", "~"), ("*", "%2A"), ("%2F", "/")):
        enc = F.replace(enc, F.lit(a), F.lit(b))
    return enc


def search_requests(terms: DataFrame, term_col: str, template_ids=(1, 2),
                    base: str = SEARCH_BASE) -> DataFrame:
    """J1 + F17 + F18: one request row per (term, template, page start)."""
    tids = F.array(*[F.lit(t) for t in template_ids])
    q = (terms.select(F.col(term_col).alias("term"))
         .select("term", F.explode(tids).alias("template_id"))
         .withColumn("query", build_query(F.col("template_id"), F.col("term")))
         .select("term", "template_id", "query", F.explode(page_starts()).alias("start")))
    url = F.concat(F.lit(base), F.lit("start="), F.col("start").cast("string"),
                   F.lit(f"&count={PAGE_SIZE}&query="), python_quote(F.col("query")))
    return q.withColumn("url", url)


def article_link(doi: Column, base: str = ARTICLE_BASE, suffix: str = ARTICLE_SUFFIX) -> Column:
    """Base + DOI + suffix, a missing DOI becomes the text 'None'."""
    return F.concat(F.lit(base), F.coalesce(doi, F.lit("None")), F.lit(suffix))


# Where a search payload carries its error and its total.
STATUS_PATH = "$['service-error']['status']['statusText']"
TOTAL_PATH = "$['search-results']['opensearch:totalResults']"


def search_status(payload: Column) -> tuple[Column, Column]:
    """(error text or null, total results as int defaulting to 0)."""
    total = F.get_json_object(payload, TOTAL_PATH)
    return F.get_json_object(payload, STATUS_PATH), F.coalesce(total.try_cast("int"), F.lit(0))


def parse_atom_feed(feeds: DataFrame, payload_col: str = "payload") -> DataFrame:
    """S6 on Atom search pages: one row per ``entry`` with url, title,
    publication name and an optional DOI.  Uses Spark's XML reader on the
    payload column (namespace prefixes are kept in the element names)."""
    schema = ("entry ARRAY<STRUCT<`prism:url`: STRING, `dc:title`: STRING, "
              "`prism:publicationName`: STRING, `prism:doi`: STRING>>")
    parsed = feeds.select(F.from_xml(F.col(payload_col), schema,
                                     {"rowTag": "feed", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}).alias("f"))
    e = F.explode_outer("f.entry").alias("e")
    return (parsed.select(e).where(F.col("e").isNotNull())
            .select(F.col("e.`prism:url`").alias("url"), F.col("e.`dc:title`").alias("title"),
                    F.col("e.`prism:publicationName`").alias("pub_name"),
                    F.col("e.`prism:doi`").alias("doi")))


def xml_unescape(text: Column) -> Column:
    out = text
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                 ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def page_entries(pages: DataFrame) -> DataFrame:
    """S6 re-aimed on landed HTML pages: (page_id, url, title, pub_name, doi).

    Title is the decoded ``<title>`` text; the publication is the URL host;
    the DOI is built from the numeric id in the URL path (null if none)."""
    title = xml_unescape(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1))
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    num = F.regexp_extract("url", r"^[a-z]+://[^/]+/[a-z]+/(\d+)", 1)
    return pages.select(
        "page_id", "url",
        F.when(title == "", F.lit(None)).otherwise(title).alias("title"),
        host.alias("pub_name"),
        F.when(num == "", F.lit(None)).otherwise(F.concat(F.lit("10.0/"), num)).alias("doi"))


# Fields of a fetched article record.
RECORD_FIELDS = {
    "abstract": "$['coredata']['dc:description']",
    "title": "$['coredata']['dc:title']",
    "date": "$['coredata']['prism:coverDisplayDate']",
    "journal": "$['coredata']['prism:publicationName']",
}


def document_fields(records: DataFrame, doi_col: str = "doi", payload_col: str = "payload",
                    ok_col: str = "ok") -> DataFrame:
    """Abstract, title, date and journal of each fetched record.

    A failed read, an unparseable payload or a record without a description
    is *kept* as a row with NULL fields and ``status = 'failed'`` (the
    reference writes placeholder strings, which F23 maps to NULL)."""
    vals = {k: F.get_json_object(F.col(payload_col), p) for k, p in RECORD_FIELDS.items()}
    good = F.coalesce(F.col(ok_col), F.lit(False)) & vals["abstract"].isNotNull()
    return records.select(
        F.col(doi_col).alias("doi"),
        *[F.when(good, v).alias(k) for k, v in vals.items()],
        F.when(good, F.lit("ok")).otherwise(F.lit("failed")).alias("status"))
