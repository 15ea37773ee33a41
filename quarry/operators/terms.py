"""Class-based term statistics: n-gram counts, document-frequency bounds,
class TF-IDF and ranked keywords (A5-A7, W3, W4, M12, F3).

Design for scale
----------------
* n-grams are formed *inside each document*.  Of every place only the
  longest one is counted, task by task, and shuffled once, by its head (the
  shortest); the shorter ones are its prefixes, so all of a place's n-grams
  are counted where the head's hash lies.  No per-class giant strings are built.
* Per-term statistics (number of classes containing the term, total
  frequency) are taken in the same pass: rows lie sorted by that hash and
  pass through a task stretch by stretch, as whole Arrow columns.  Terms of
  the same figures have the same score, so for the n best terms a task gives
  their number and the n first of them, and the counts are passed once.
* Per-class totals are a C-row aggregate, broadcast to the counts: these
  are never dealt by class.  For the n best terms the class' n-th best score
  goes along, so only terms that reach it are sorted.
* Global scalars (number of classes, mean terms per class) are scalar
  subqueries, evaluated once by Spark and inlined as literals.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from quarry.functions import text as T
from quarry.operators.rewrite import replace_items
from quarry.session import written_table

# Fixed values of the reference's keyword model.
NGRAM_RANGE = (2, 3)
MIN_DF = 0.05
MAX_DF = 0.5
TOP_N_WORDS = 20
UPDATED_TOP_N_WORDS = 100
TOP_KEYWORDS_SHOWN = 5
NOISE_TOPIC = -1
NOISE_NAME = "Noise"
PLACES_AT_ONCE = 1 << 19  # n-grams that a task counts before it passes them on
ROWS_AT_ONCE = 1 << 17  # counted n-grams that a task adds up at a time, if their heads end
FIGURES_AT_ONCE = 1 << 15  # groups of equal figures that a task holds before it passes them on
FEW_TERMS = 128  # so many terms of equal figures are sorted as they are


def clustered_docs(corpus: DataFrame, stop_words=None) -> DataFrame:
    """Normalised documents of non-noise clusters: (doc_id, cluster, doc)."""
    return (corpus.where(F.col("cluster") != NOISE_TOPIC)
            .select("doc_id", "cluster", T.preprocess("abstract", stop_words).alias("doc")))


def _longest_ngrams(lo: int, hi: int, schema: pa.Schema, stop=()):
    """The counter of (class, text) batches: (class, n-gram, n) with the
    longest n-gram, of ``lo`` to ``hi`` words, of every place that has one.
    A row counts the places of one stretch of a task's texts."""
    stop, words_of = frozenset(stop), re.compile(T.TERM_WORDS).findall

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        for cls, grams in held.items():
            yield pa.record_batch([pa.array([cls] * len(grams), schema.field(0).type), pa.array(grams.keys(), pa.string()),
                                   pa.array(grams.values(), pa.int64())], schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, places = defaultdict(Counter), 0
        for batch in batches:
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(text.as_py() or "")
                if stop:
                    words = [w for w in words if w not in stop]
                if len(words) < lo:
                    continue
                held[cls].update(map(" ".join, zip(*[words[i:] for i in range(hi)])))
                held[cls].update(" ".join(words[i:]) for i in range(max(0, len(words) - hi + 1), len(words) - lo + 1))
                places += len(words)
                if places >= PLACES_AT_ONCE:
                    yield from rows(held)
                    held, places = defaultdict(Counter), 0
        yield from rows(held)

    return count


def _term_stats(lo: int, hi: int, schema: pa.Schema):
    """The counter of what ``_longest_ngrams`` gives, after the sorted hash of
    the n-gram's head: (class, term, tf, n_classes, f) of every n-gram of
    ``lo`` to ``hi`` words."""

    def merged(cls: pa.Array, grams: pa.Array, n: np.ndarray):
        """One row per n-gram and class: the n-grams with the place of each row's, the class' place, the sum."""
        of, terms = pc.dictionary_encode(cls, null_encoding="encode"), pc.dictionary_encode(grams)
        width = len(of.dictionary)
        both = pc.dictionary_encode(pa.array(terms.indices.to_numpy().astype(np.int64) * width + of.indices.to_numpy()))
        keys = both.dictionary.to_numpy()
        tf = np.zeros(len(keys), np.int64)
        np.add.at(tf, both.indices.to_numpy(), n)
        return of.dictionary.take(pa.array(keys % width)), terms.dictionary, keys // width, tf

    def stats(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cls, grams, n = (table.column(i).combine_chunks() for i in (1, 2, 3))
        n, words = n.to_numpy(), pc.add(pc.count_substring(grams, " "), 1).to_numpy()
        shorter = None  # of the longer n-grams: class, prefix, tf
        for k in range(hi, lo - 1, -1):
            own = pa.array(words == k)
            c, g, m = cls.filter(own), grams.filter(own), n[words == k]
            if shorter:
                c, g, m = pa.concat_arrays([c, shorter[0]]), pa.concat_arrays([g, shorter[1]]), np.concatenate([m, shorter[2]])
            c, terms, at, tf = merged(c, g, m)
            f = np.zeros(len(terms), np.int64)
            np.add.at(f, at, tf)
            each = terms.take(pa.array(at))
            yield pa.record_batch([c, each, pa.array(tf), pa.array(np.bincount(at, minlength=len(terms))[at]), pa.array(f[at])], schema)
            if k > lo:
                shorter = c, pc.list_element(pc.split_pattern(each, " ", max_splits=1, reverse=True), 0), tf

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows < ROWS_AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            heads = table.column(0).to_numpy()
            end = int(np.searchsorted(heads, heads[-1]))
            if end:
                yield from stats(table.slice(0, end))
                held = table.slice(end).to_batches()
            else:  # all of one head, which may go on
                cls, terms, at, n = merged(*(table.column(i).combine_chunks() for i in (1, 2)), table.column(3).to_numpy())
                held = [pa.record_batch([pa.array(np.full(len(n), heads[-1])), cls, terms.take(pa.array(at)), pa.array(n)], batch.schema)]
            rows = sum(map(len, held))
        if rows:
            yield from stats(pa.Table.from_batches(held))

    return count


def _equal_figures(best: int, schema: pa.Schema):
    """Of what ``_term_stats`` gives: (class, tf, n_classes, f, n, terms), how
    many terms of a task have these figures, and the ``best`` first of them."""

    def add(held: dict, batch: pa.RecordBatch) -> None:
        figures = [batch.column(i) for i in (0, 2, 3, 4)]
        group = np.zeros(len(batch), np.int64)
        for col in figures:
            own = pc.dictionary_encode(col, null_encoding="encode")
            group = group * len(own.dictionary) + own.indices.to_numpy()
            group = pc.dictionary_encode(pa.array(group)).indices.to_numpy().astype(np.int64)
        order = np.argsort(group, kind="stable")
        begin = np.flatnonzero(np.diff(group[order], prepend=-1))
        terms, of = batch.column(1).take(pa.array(order)), pa.array(order[begin])
        keys = zip(*(col.take(of).to_pylist() for col in figures))
        for key, at, n in zip(keys, begin.tolist(), np.diff(begin, append=len(batch)).tolist()):
            same = held.setdefault(key, [0, []])
            same[0] += n
            new = terms.slice(at, n)
            if n > FEW_TERMS and len(same[1]) == best:
                new = new.filter(pc.less(new, same[1][-1]))
            if len(new) > max(best, FEW_TERMS):
                new = new.take(pc.bottom_k_unstable(new, best))
            if len(new):
                same[1] = sorted(same[1] + new.to_pylist())[:best]

    def rows(held: dict) -> Iterator[pa.RecordBatch]:
        columns = [*zip(*held), *zip(*held.values())]
        yield pa.record_batch([pa.array(col, field.type) for col, field in zip(columns, schema)], schema)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            add(held, batch)
            if len(held) >= FIGURES_AT_ONCE:
                yield from rows(held)
                held = {}
        if held:
            yield from rows(held)

    return group


def class_term_counts(docs: DataFrame, class_col: str = "cluster", text_col: str = "doc",
                      ngram_range=NGRAM_RANGE, vectorizer_stop=None, with_stats: bool = False,
                      best: int | None = None) -> DataFrame:
    """A5: (class, term, tf) with n-grams of >= 5-letter tokens.

    ``with_stats`` adds the term's ``n_classes`` and ``f``, which are known
    where it is counted, for ``df_bounds``.  For the ``best`` terms of a class
    by figures and then by term, rows can be groups of terms with the same
    figures: (class, tf, n_classes, f, n, terms), with the number of terms and
    the ``best`` first; a group may have a row per task."""
    lo, hi = ngram_range
    texts = docs.select(F.col(class_col).alias("cls"), F.col(text_col).alias("text"))
    cls = texts.schema["cls"]
    places = StructType([cls, StructField("gram", StringType()), StructField("n", LongType())])
    stats = StructType([cls, StructField("term", StringType()), *[StructField(c, LongType()) for c in ("tf", "n_classes", "f")]])
    head = F.xxhash64(F.substring_index("gram", " ", lo))
    count, out = _term_stats(lo, hi, to_arrow_schema(stats)), stats
    if best is not None:
        out = StructType([cls, *stats.fields[2:], StructField("n", LongType()), StructField("terms", ArrayType(StringType()))])
        each, group = count, _equal_figures(best, to_arrow_schema(out))

        def count(batches):
            return group(each(batches))

    counts = (texts.mapInArrow(_longest_ngrams(lo, hi, to_arrow_schema(places), vectorizer_stop or ()), places)
              .repartition(head).select(head.alias("head"), "cls", "gram", "n").sortWithinPartitions("head")
              .mapInArrow(count, out)
              .withColumnRenamed("cls", class_col))
    return counts if with_stats or best is not None else counts.select(class_col, "term", "tf")


def n_classes(docs: DataFrame, class_col: str = "cluster") -> Column:
    """Number of classes that have at least one document (scalar subquery)."""
    return docs.select(F.count_distinct(class_col)).scalar()


def df_bounds(counts: DataFrame, n_cls: Column, class_col: str = "cluster",
              min_df: float = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """Keep terms whose share of classes lies in [min_df, max_df].

    Adds ``n_classes`` (classes containing the term) and ``f`` (frequency
    over all classes), if the counts do not have them yet."""
    with_df = counts
    if not {"n_classes", "f"} <= set(counts.columns):
        by_term = Window.partitionBy("term")
        with_df = (counts.withColumn("n_classes", F.count(F.lit(1)).over(by_term))
                   .withColumn("f", F.sum("tf").over(by_term)))
    return with_df.where((F.col("n_classes") >= F.lit(min_df) * n_cls)
                         & (F.col("n_classes") <= F.lit(max_df) * n_cls))


def class_tfidf(kept: DataFrame, n_cls: Column, class_col: str = "cluster",
                normalize: bool = True, best: int | None = None) -> DataFrame:
    """W(t,c) = tf(t,c)/|c| * ln(1 + A / f(t)), A = int(mean terms per class).

    Output: (class, term, tf, score).  With ``best``, terms with a score below
    the class' ``best``-th are left out: terms of the same tf and f have the
    same score, so counting such pairs tells it, without sorting any terms.
    Rows may be the groups of ``class_term_counts``, for no more than their
    ``best``: of terms with equal scores the first ones are given."""
    n, term = F.count(F.lit(1)), F.col("term")
    if "terms" in kept.columns:
        n, term = F.sum("n"), F.explode("terms").alias("term")
    # C rows: the grand total is a window over the per-class totals only, so
    # the n-gram stage is shared (exchange reuse) instead of re-run.
    pairs = kept.groupBy(class_col, "tf", "f").agg(n.alias("n"))
    totals = (pairs.groupBy(class_col).agg(F.sum(F.col("tf") * F.col("n")).alias("class_total"))
              .withColumn("grand_total", F.sum("class_total").over(Window.partitionBy())))
    avg_terms = F.floor(F.col("grand_total") / n_cls)
    tf = F.col("tf") / F.col("class_total") if normalize else F.col("tf").cast("double")
    score = tf * F.log(F.lit(1.0) + avg_terms / F.col("f"))
    if best is None:
        return kept.join(F.broadcast(totals), class_col).select(class_col, term, "tf", score.alias("score"))
    better = Window.partitionBy(class_col).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    # Null-safe joins, and a null bound for the null class: a join that asks for a class would put a filter of its own
    # below the pairs of one branch, and they would be counted twice.
    of_class = F.broadcast(totals.withColumnRenamed(class_col, "of"))
    least = (pairs.join(of_class, F.col(class_col).eqNullSafe(F.col("of"))).withColumn("score", score)
             .withColumn("before", F.coalesce(F.sum("n").over(better), F.lit(0)))
             .where(F.col("before") < best)
             .groupBy("of", "class_total", "grand_total").agg(F.min("score").alias("least"))
             .withColumn("least", F.when(F.col("of").isNotNull(), F.col("least"))))
    return (kept.join(F.broadcast(least), F.col(class_col).eqNullSafe(F.col("of"))).withColumn("score", score)
            .where(F.col("score") >= F.col("least")).select(class_col, term, "tf", "score"))


def top_terms(scored: DataFrame, n: int = TOP_N_WORDS, class_col: str = "cluster") -> DataFrame:
    """The n best terms per class, rank 1..n (score desc, term asc).

    ``row_number() <= n`` plans as a WindowGroupLimit, so each task keeps
    only n rows per class before the final window."""
    w = Window.partitionBy(class_col).orderBy(F.desc("score"), F.asc("term"))
    return (scored.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= n)
            .select(class_col, F.col("rank").cast("int").alias("rank"), "term", "score"))


def topic_terms(corpus: DataFrame, n: int = TOP_N_WORDS, stop_words=None,
                ngram_range=NGRAM_RANGE, min_df=MIN_DF, max_df=MAX_DF) -> DataFrame:
    """A5 -> A6 -> A7 -> W3 over the corpus: (cluster, rank, term, score)."""
    docs = clustered_docs(corpus, stop_words)
    n_cls = n_classes(docs)
    counts = class_term_counts(docs, ngram_range=ngram_range, with_stats=True, best=n)
    kept = written_table(df_bounds(counts, n_cls, min_df=min_df, max_df=max_df))  # read for the totals, the n-th score, the terms
    return top_terms(class_tfidf(kept, n_cls, best=n), n)


def keywords_label(terms: DataFrame, topics: DataFrame, k: int = TOP_KEYWORDS_SHOWN,
                   class_col: str = "cluster") -> DataFrame:
    """First k terms joined by ', ' per topic; the noise topic is 'Noise'.

    ``topics`` lists every topic id (including -1) that needs a label."""
    firsts = (terms.where(F.col("rank") <= k)
              .groupBy(class_col)
              .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("ranked")))
    joined = topics.join(firsts, class_col, "left")
    words = F.array_join(F.transform(F.col("ranked"), lambda s: s["term"]), ", ")
    return joined.select(
        class_col,
        F.when(F.col(class_col) == NOISE_TOPIC, F.lit(NOISE_NAME))
        .otherwise(F.coalesce(words, F.lit(""))).alias("keywords"))


MIN_SHARE = 100  # a base is believed if it has a hundredth of the form's documents


def lemma_pairs(docs: DataFrame, tokens_col: str, lemma_table: DataFrame | None = None,
                min_share: int = MIN_SHARE) -> DataFrame:
    """(form, lemma) of the forms of ``docs`` that are not their own lemma.

    A form in ``lemma_table`` (form, lemma) has the table's lemma.  Of any
    other, the detachment rules make candidate bases; those that are forms of
    the corpus themselves, in at least one ``min_share``-th as many documents,
    are accepted, and the shortest is the lemma.  What moves are the distinct
    forms of each task with their counts, never tokens."""
    forms = written_table(docs.select(F.explode(F.array_distinct(tokens_col)).alias("form"))
                          .groupBy("form").agg(F.count(F.lit(1)).alias("n")))
    bases = forms.select(F.col("form"), F.col("n").alias("n_form"), F.explode(T.noun_bases("form")).alias("base"))
    accepted = (bases.join(forms.select(F.col("form").alias("base"), "n"), "base")
                .where(F.col("n") * min_share >= F.col("n_form"))
                .groupBy("form").agg(F.min_by("base", F.struct(F.length("base"), "base")).alias("lemma")))
    if lemma_table is None:
        return accepted
    listed = lemma_table.where("form IS NOT NULL AND lemma IS NOT NULL").groupBy("form").agg(F.min("lemma").alias("lemma"))
    return listed.join(forms, "form", "left_semi").unionByName(accepted.join(listed, "form", "left_anti"))


def lemmatise(docs: DataFrame, tokens_col: str, lemma_table: DataFrame | None = None,
              key: str = "doc_id", min_share: int = MIN_SHARE) -> DataFrame:
    """(key, tokens_col) with each token replaced by its lemma, by a user
    (form, lemma) table of any size and the corpus' own vocabulary.

    Texts are rewritten where they are (``rewrite.replace_items``).  Null and
    empty token lists stay; repeated rows stay repeated; of two lemmas of one
    form in the table the smaller counts."""
    own = docs.select(key, tokens_col)
    pairs = lemma_pairs(own, tokens_col, lemma_table, min_share)
    return replace_items(own, tokens_col, pairs.select(F.col("form").alias("item"), F.col("lemma").alias("value")))
