"""Registered queries of sources, sinks and landing: the given tables go out
through a sink, come back through a source, and must be the same rows.

Files are written below the session's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions.stopwords import default_stop_words, sql_list
from quarry.operators import harvest as H
from quarry.plans.record_queries import PAGE_ENTRIES_SQL
from quarry.plans.registry import register
from quarry.session import checkpoint_dir
from quarry.sources import files as IO
from quarry.sources.tables import table
from quarry.streaming import landing as L

DOC_SCHEMA = "doc_id long, text string, lang string, source string"
HOT_SOURCE = "src0"  # stands for the noise group


def scratch(spark) -> str:
    return f"{checkpoint_dir(spark)}/quarry-io-{uuid.uuid4().hex}"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@register("csv_round_trip", "SELECT doc_id, text, lang, source FROM documents")
def csv_round_trip(spark, sf_dir):
    """K2 -> S1: quotes, line breaks and blanks of whole texts survive."""
    path = scratch(spark)
    IO.write_csv(_docs(spark, sf_dir), path)
    return IO.read_csv(spark, path, DOC_SCHEMA, multi_line=True)


@register("csv_splittable", "SELECT doc_id, quality, toxic FROM labels")
def csv_splittable(spark, sf_dir):
    """A CSV without line breaks in fields, read in splits."""
    path = scratch(spark)
    IO.write_csv(table(spark, sf_dir, "labels"), path)
    return IO.read_csv(spark, path, "doc_id long, quality int, toxic int")


@register("parquet_tree", "SELECT doc_id, quality, toxic FROM labels")
def parquet_tree(spark, sf_dir):
    """K1 -> S4: two gzip folders at different depths, read as one table."""
    path, labels = scratch(spark), table(spark, sf_dir, "labels")
    IO.write_parquet(labels.where("quality = 1"), f"{path}/good")
    IO.write_parquet(labels.where("quality <> 1 OR quality IS NULL"), f"{path}/more/bad")
    return IO.read_parquet_tree(spark, path, "*.parquet").select("doc_id", "quality", "toxic")


@register("parquet_tolerant", "SELECT page_id, url FROM pages")
def parquet_tolerant(spark, sf_dir):
    """The output folder is no input; its siblings, which hold all pages
    between them, and an empty file are.  The output folder has a marked copy
    of every page, so that any leak of it shows."""
    path, pages = scratch(spark), table(spark, sf_dir, "pages").select("page_id", "url")
    odd = F.col("page_id") % 2 == 1
    IO.write_parquet(pages.withColumn("url", F.concat(F.lit("leaked:"), "url")), f"{path}/out")
    IO.write_parquet(pages.where(odd), f"{path}/out_more")
    IO.write_parquet(pages.where(~odd | F.col("page_id").isNull()), f"{path}/more")
    IO.write_parquet(pages.limit(0), f"{path}/empty")
    paths = [f"{path}/{p}" for p in ("out", "out_more", "more", "empty")]
    return IO.read_parquet_tolerant(spark, paths, exclude=f"{path}/out")


@register("parquet_quarantine", """SELECT page_id, url, 'read' AS state FROM pages
UNION ALL SELECT NULL, 'broken', 'quarantined' FROM (SELECT DISTINCT 1 FROM pages)""")
def parquet_quarantine(spark, sf_dir):
    """All pages from whole files; a folder of other files (the pages' html
    as text) between them is listed by folder, not read."""
    path, pages = scratch(spark), table(spark, sf_dir, "pages")
    IO.write_parquet(pages.select("page_id", "url"), f"{path}/pages")
    pages.select(F.coalesce("html", F.lit("-")).alias("value")).write.text(f"{path}/broken")
    rows, bad = IO.read_parquet_checked(spark, [f"{path}/{p}" for p in ("broken", "pages", "none")])
    folders = bad.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("url")).distinct()
    return rows.withColumn("state", F.lit("read")).unionByName(
        folders.withColumn("state", F.lit("quarantined")), allowMissingColumns=True)


@register("group_files", f"SELECT doc_id, text, lang, source FROM documents WHERE source <> '{HOT_SOURCE}'")
def group_files(spark, sf_dir):
    """K3: one CSV folder per source without the noise group."""
    path = scratch(spark)
    IO.write_per_group(_docs(spark, sf_dir), path, "source", noise=HOT_SOURCE)
    return IO.read_csv(spark, path, DOC_SCHEMA, multi_line=True)


@register("append_file", "SELECT doc_id, quality, toxic FROM labels")
def append_file(spark, sf_dir):
    """K4: two appends, read as one table."""
    path, labels = scratch(spark), table(spark, sf_dir, "labels")
    IO.append_csv(labels.where("doc_id % 2 = 0"), path)
    IO.append_csv(labels.where("doc_id % 2 = 1"), path)
    return IO.read_csv(spark, path, "doc_id long, quality int, toxic int")


@register("chunk_files", "SELECT CAST(doc_id % 3 AS INTEGER) AS chunk, doc_id, quality FROM labels")
def chunk_files(spark, sf_dir):
    """K5/O3: numbered chunk files, concatenated in order of their number."""
    path, labels = scratch(spark), table(spark, sf_dir, "labels").select("doc_id", "quality")
    for i in range(3):
        IO.write_csv(labels.where(F.col("doc_id") % 3 == i), f"{path}/Labels_Chunk_{i}")
    return IO.read_chunks(spark, f"{path}/*", "doc_id long, quality int").select("chunk", "doc_id", "quality")


@register("staged", "SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1")
def staged(spark, sf_dir):
    """K6: built once, then resumed from its complete output."""
    path = scratch(spark)
    counts = (table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation"))
              .agg(F.count(F.lit(1)).alias("n")))
    IO.stage(spark, path, lambda: counts)
    return IO.stage(spark, path, lambda: counts.limit(0))


@register("stop_words", f"""SELECT DISTINCT word FROM (
  SELECT p_name AS word FROM part UNION ALL SELECT unnest({sql_list(default_stop_words())})) WHERE word <> ''""")
def stop_words(spark, sf_dir):
    """Words of a file (the parts' names) and the English list."""
    path = scratch(spark)
    table(spark, sf_dir, "part").select("p_name").write.text(path)
    return IO.all_stopwords(spark, path)


@register("landed_links", f"""WITH {PAGE_ENTRIES_SQL},
links AS (SELECT title, pub_name, doi, url AS link, page_id % 2 AS part FROM pe WHERE doi IS NOT NULL AND title IS NOT NULL),
f AS (SELECT doi, title, part, min(struct_pack(pub_name := pub_name, link := link)) AS r FROM links GROUP BY ALL)
SELECT doi, title, r.pub_name AS pub_name, r.link AS link FROM f
QUALIFY row_number() OVER (PARTITION BY doi, title ORDER BY part) = 1""")
def landed_links(spark, sf_dir):
    """Two landings of a file stream, merged without repeats."""
    path = scratch(spark)
    links = H.page_entries(table(spark, sf_dir, "pages"))
    for part in (0, 1):
        (links.where(F.col("page_id") % 2 == part)
         .select("title", "pub_name", "doi", F.col("url").alias("link")).write.mode("append").parquet(f"{path}/landing"))
        L.land_once(spark, f"{path}/landing", f"{path}/target", f"{path}/state")
    return spark.read.schema(L.LINK_SCHEMA).parquet(f"{path}/target").select("doi", "title", "pub_name", "link")
