"""Keyword trends (A10, A11, A18, A19, P17) built on substring counts.

``term_occurrences`` counts, for every document, the non-overlapping
occurrences of every topic term in the lower-cased raw text (Python
``str.count`` semantics, matches may cross word boundaries).  A block of
terms becomes an Aho-Corasick automaton, once per Python worker; a text
passes it once, and every hit is counted where it is found: only (document,
term, n) leaves the batch.  No documents x terms product, no shuffle of hits.

Documents are counted one by one and summed, instead of matching in one
concatenated string per year; a match spanning two documents is therefore
not counted (documented deviation).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import reliable_checkpoint, written_table

# Fixed values of the reference's trend figures.
GLOBAL_YEARS = (2015, 2025)
CLUSTER_YEARS = (2020, 2025)
TOP_N_TERMS = 20
TERMS_PER_PASS = 50_000  # terms of one automaton


OCCURRENCES = "doc_id long, term string, n long"

_automata: dict = {}  # of this worker: the automaton of the block it is at


def term_occurrences(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id",
                     text_col: str = "abstract", term_col: str = "term") -> DataFrame:
    """F14 for a term table: (doc_id, term, n) for every n > 0, as a table in
    the shared folder.

    The distinct terms are hashed into blocks of about ``TERMS_PER_PASS``; one
    block at a time is broadcast, counted and given up.  Null and empty texts
    and terms give no rows, repeated documents repeated ones."""
    spark = docs.sparkSession
    listed = reliable_checkpoint(terms.select(F.col(term_col).alias("term")).where("term <> ''").distinct())
    n_blocks = max(1, -(-listed.count() // TERMS_PER_PASS))
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lower(F.col(text_col)).alias("text")).where("text <> ''")
    out = spark.createDataFrame([], OCCURRENCES)
    for b in range(n_blocks):
        rows = listed.where(F.pmod(F.xxhash64("term"), F.lit(n_blocks)) == b).collect()
        if rows:
            block = spark.sparkContext.broadcast([r["term"] for r in rows])
            out = out.unionByName(written_table(_occurrences(text, block, uuid.uuid4().hex)))
            block.unpersist()
    return out


def _occurrences(text: DataFrame, block, name: str) -> DataFrame:
    """Counts of one block's terms, text by text."""

    def automaton():
        if name not in _automata:
            _automata.clear()
            built = ahocorasick.Automaton()
            for term in block.value:
                built.add_word(term, term)
            built.make_automaton()
            _automata[name] = built
        return _automata[name]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, counts = [], [], []
            for doc_id, one in zip(batch.column(0).to_pylist(), batch.column(1)):
                free: dict[str, int] = {}  # where the next match of a term may begin
                n: dict[str, int] = {}
                for end, term in automaton().iter(one.as_py()):
                    if end - len(term) + 1 >= free.get(term, 0):
                        free[term] = end + 1
                        n[term] = n.get(term, 0) + 1
                ids += [doc_id] * len(n)
                found += n.keys()
                counts += n.values()
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(found, pa.string()), pa.array(counts, pa.int64())],
                                  ["doc_id", "term", "n"])

    return text.mapInArrow(count, OCCURRENCES)


def year_axis(lo: int, hi: int):
    return F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("year")


def top_terms_global(occ: DataFrame, n: int = TOP_N_TERMS) -> DataFrame:
    """(rank, term, n) of the n most frequent terms (ties: term asc)."""
    tot = occ.groupBy("term").agg(F.sum("n").alias("n"))
    top = tot.orderBy(F.desc("n"), F.asc("term")).limit(n)
    w = Window.orderBy(F.desc("n"), F.asc("term"))
    return top.select(F.row_number().over(w).cast("int").alias("rank"), "term", "n")


def trend_by_year(occ: DataFrame, docs: DataFrame, terms: DataFrame,
                  years=GLOBAL_YEARS) -> DataFrame:
    """A10 global: (term, year, n) for the given terms, zero-filled."""
    lo, hi = years
    counts = (occ.join(docs.select("doc_id", "year"), "doc_id")
              .where(F.col("year").between(lo, hi))
              .join(terms.select("term"), "term")
              .groupBy("term", "year").agg(F.sum("n").alias("n")))
    grid = terms.select("term", year_axis(lo, hi))
    return (grid.join(counts, ["term", "year"], "left")
            .select("term", F.col("year").cast("int").alias("year"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def trend_by_cluster(occ: DataFrame, docs: DataFrame, cluster_terms: DataFrame,
                     years=CLUSTER_YEARS) -> DataFrame:
    """A10 per cluster + A19: (cluster, term, year, n) for each cluster's own
    terms over its own documents; terms never seen in the range are dropped."""
    lo, hi = years
    d = docs.select("doc_id", "cluster", "year").where(F.col("year").between(lo, hi))
    counts = (occ.join(d, "doc_id")
              .join(cluster_terms.select("cluster", "term"), ["cluster", "term"])
              .groupBy("cluster", "term", "year").agg(F.sum("n").alias("n")))
    seen = counts.where(F.col("n") > 0).select("cluster", "term").distinct()
    grid = seen.select("cluster", "term", year_axis(lo, hi))
    return (grid.join(counts, ["cluster", "term", "year"], "left")
            .select("cluster", "term", F.col("year").cast("int").alias("year"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))
