"""Feed and status parsing of landed payloads; request generation."""

from pyspark.sql import functions as F

from quarry.operators import harvest as H

FEED = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:dc="http://purl.org/dc/elements/1.1/"
 xmlns:prism="http://prismstandard.org/namespaces/basic/2.0/">
 <entry><prism:url>u1</prism:url><dc:title>First &amp; best</dc:title>
  <prism:publicationName>J1</prism:publicationName><prism:doi>10.1/x</prism:doi></entry>
 <entry><prism:url>u2</prism:url><dc:title>No doi</dc:title>
  <prism:publicationName>J2</prism:publicationName></entry>
</feed>"""
EMPTY = '<feed xmlns="http://www.w3.org/2005/Atom"></feed>'


def test_atom_feed_entries(spark):
    df = spark.createDataFrame([(FEED,), (EMPTY,)], "payload string")
    got = sorted(tuple(r) for r in H.parse_atom_feed(df).collect())
    assert got == [("u1", "First & best", "J1", "10.1/x"), ("u2", "No doi", "J2", None)]


def test_search_status(spark):
    rows = ['{"service-error": {"status": {"statusText": "QUOTA"}}}',
            '{"search-results": {"opensearch:totalResults": "42"}}', "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "p string")
    err, total = H.search_status(F.col("p"))
    got = [tuple(r) for r in df.select(err, total).collect()]
    assert got == [("QUOTA", 0), (None, 42), (None, 0)]


def test_requests_cover_pages(spark):
    terms = spark.createDataFrame([("bag",), ("film",)], "term string")
    req = H.search_requests(terms, "term", (1, 2))
    assert req.count() == 2 * 2 * 60
    starts = sorted({r.start for r in req.select("start").collect()})
    assert starts[0] == 0 and starts[-1] == 5900 and len(starts) == 60
    one = req.where("term = 'bag' AND template_id = 2 AND start = 0").first()
    assert "('recycling technology' OR 'recycle') AND 'plastic' AND 'bag'" == one.query
    assert "%28%27recycling%20technology%27" in one.url


def test_article_link_none(spark):
    df = spark.createDataFrame([("10.1/x",), (None,)], "doi string")
    got = [r[0] for r in df.select(H.article_link(F.col("doi"), "B/", "?s")).collect()]
    assert got == ["B/10.1/x?s", "B/None?s"]


def test_document_fields_keeps_failures(spark):
    ok = '{"coredata": {"dc:description": "An abstract.", "dc:title": "T", "prism:coverDisplayDate": "March 2021", "prism:publicationName": "J"}}'
    no_desc = '{"coredata": {"dc:title": "T2"}}'
    rows = [("d1", ok, True), ("d2", ok, False), ("d3", no_desc, True), ("d4", "not json", True)]
    df = spark.createDataFrame(rows, "doi string, payload string, ok boolean")
    got = {r.doi: tuple(r)[1:] for r in H.document_fields(df).collect()}
    assert got["d1"] == ("An abstract.", "T", "March 2021", "J", "ok")
    for d in ("d2", "d3", "d4"):
        assert got[d] == (None, None, None, None, "failed")
