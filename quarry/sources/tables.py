"""Driver tables and the shared corpus view.

All readers are lazy ``spark.read.parquet`` scans, so Catalyst prunes
columns and pushes filters into the Parquet reader for whatever the
calling query needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")

# Fixed values of the corpus mapping (see FIXTURES.md, "Corpus view"):
# the embedding label that plays the noise cluster, the first year of the
# synthetic year axis, its number of years and the DOI prefix.
NOISE_LABEL = 9
YEAR_BASE = 2015
YEAR_SPAN = 11
DOI_PREFIX = "10.0/"


# Row key of each driver table, by which SPREAD_CONF deals its rows.
TABLE_KEYS = {"documents": "doc_id", "embeddings": "vec_id", "pages": "page_id",
              "labels": "doc_id", "benchmark": "item_id", "conversations": "conv_id",
              "events": "event_id", "orders": "o_orderkey", "part": "p_partkey"}

# Session setting for one-row-group files on one machine (bench.py sets it):
# deal every table to this many partitions by its key.  Unset, as on a
# cluster, a scan stays as its files are split.
SPREAD_CONF = "spark.quarry.scan.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy Parquet scan of one driver table."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    spread, key = spark.conf.get(SPREAD_CONF, None), TABLE_KEYS.get(name)
    return df.repartition(int(spread), key) if spread and key else df


def title_of(text: str = "text") -> Column:
    """A document's title: the first line of its text."""
    return F.substring_index(F.col(text), "\n", 1)


TITLE_SQL = "split_part(text, chr(10), 1)"


def doi_of(doc_id: Column) -> Column:
    return F.concat(F.lit(DOI_PREFIX), doc_id.cast("string"))


def year_of(doc_id: Column) -> Column:
    return (F.lit(YEAR_BASE) + F.pmod(doc_id, F.lit(YEAR_SPAN))).cast("int")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with a vector: the reference's abstracts table.

    The given vectors belong to no document, so document i takes vector
    ``i mod n``; n is the number of vectors, whose ids are 0 to n - 1.
    Columns: doc_id, title, abstract, journal, lang, doi, year, cluster,
    embedding (array<double>).  Cluster -1 is noise.
    """
    docs = table(spark, sf_dir, "documents")
    vecs = table(spark, sf_dir, "embeddings")
    n = vecs.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    return (
        docs.withColumn("_vec", F.pmod("doc_id", n))
        .join(vecs, F.col("_vec") == F.col("vec_id"), "inner")
        .select(
            "doc_id",
            title_of().alias("title"),
            F.col("text").alias("abstract"),
            F.col("source").alias("journal"),
            "lang",
            doi_of(F.col("doc_id")).alias("doi"),
            year_of(F.col("doc_id")).alias("year"),
            F.when(F.col("label") == NOISE_LABEL, F.lit(-1))
            .otherwise(F.col("label")).cast("int").alias("cluster"),
            F.col("embedding").cast("array<double>").alias("embedding"),
        )
    )


def corpus_sql() -> str:
    """The same corpus view as DuckDB SQL (used by oracle queries)."""
    return (
        "SELECT d.doc_id, {title} AS title, d.text AS abstract, "
        "d.source AS journal, d.lang, '{doi}' || CAST(d.doc_id AS VARCHAR) AS doi, "
        "CAST({yb} + (d.doc_id % {ys}) AS INTEGER) AS year, "
        "CAST(CASE WHEN e.label = {nl} THEN -1 ELSE e.label END AS INTEGER) AS cluster, "
        "CAST(e.embedding AS DOUBLE[]) AS embedding "
        "FROM documents d JOIN embeddings e ON d.doc_id % (SELECT count(*) FROM embeddings) = e.vec_id"
    ).format(title=TITLE_SQL, doi=DOI_PREFIX, yb=YEAR_BASE, ys=YEAR_SPAN, nl=NOISE_LABEL)
