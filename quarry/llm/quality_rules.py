"""Quality rules by a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams (single tokens and neighbouring pairs;
a token is a run of letters, of digits or of other visible characters) are
counted over *all* documents: one of the trusted target, one of the raw
corpus.  Every bucket gets the weight ``log p_target - log p_raw``.  Both
are smoothed alike: ``SMOOTH`` corpus n-grams are added to each bucket, the
target's share of them to the target, so a bucket with few n-grams says
little and an empty one nothing, in small corpora too.  A document's score
is the mean weight of its n-grams, and it is kept if the score is at least
``threshold``.

The counts are combined on the map side to at most ``BUCKETS`` rows a task.
The weights are one array of ``BUCKETS`` doubles, a bound that no input
changes, handed to the scoring projection as a scalar subquery.  Which
documents are trusted is found by a join of those that a bitmap of fixed size
leaves in question, so the other texts do not move.  Scoring is row-local: no shuffle, and the kept rows are the scanned rows.  Everything
is built-in column functions.

Base rules beside it count words, symbols, repeated lines and repeated
three-word windows (``base_rules``).  Windows are compared by their 64-bit
XXH64, chained over the three words.

Defined results: null and empty texts have no words, fail the base rules and
score 0; an empty table gives an empty result; without trusted documents
all scores are 0 and the method keeps every document; repeated rows each give a row; null
ids are never trusted; columns other than the id and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WORD, bind, whole_text, words

TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]+"
SYMBOLS = r"[#*$%&|<>]"
BUCKETS = 65_536
SMOOTH = 8.0
THRESHOLD = -0.2
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BITMAP_WORDS = 1 << 18  # longs of the bitmap of trusted ids: 2 MiB for any table
FEW = 64  # repeated windows that are looked up one by one instead of sorted with their places


def hashed(n: int, *parts: Column) -> Column:
    h = F.xxhash64(*parts)
    return (h.bitwiseAND(F.lit(n - 1)) if n & (n - 1) == 0 else F.pmod(h, F.lit(n))).cast("int")


def buckets(text: Column, n: int = BUCKETS) -> Column:
    """Buckets of all single tokens, then of all neighbouring pairs."""
    def both(t: Column) -> Column:
        pairs = F.transform(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                            lambda w, i: hashed(n, F.get(t, i), w))
        return F.concat(F.transform(t, lambda w: hashed(n, w)), pairs)

    return bind(words(text, TOKEN), both)


def id_bitmap(ids: DataFrame, words: int = BITMAP_WORDS) -> DataFrame:
    """One row: ``bitmap``, ``words`` longs with a bit set for every id's hash."""
    place = F.pmod(F.xxhash64("__id"), F.lit(64 * words))
    marks = ids.groupBy(F.shiftright(place, 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("m"))
    every = ids.sparkSession.range(words).withColumnRenamed("id", "w").join(marks, "w", "left")
    listed = F.sort_array(F.collect_list(F.struct("w", F.coalesce("m", F.lit(0)).alias("m"))))
    return every.agg(F.transform(listed, lambda x: x["m"]).alias("bitmap"))


def in_bitmap(bitmap: Column, key: Column, words: int = BITMAP_WORDS) -> Column:
    place = F.pmod(F.xxhash64(key), F.lit(64 * words))
    word = F.get(bitmap, F.shiftright(place, 6).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    return F.coalesce(word.bitwiseAND(bit) != 0, F.lit(False))


def log_ratios(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS, smooth: float = SMOOTH,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: ``weights``, the ``n`` weights in order of bucket.
    ``trusted`` has the ids of the target's documents in ``id_col``."""
    mark = trusted.select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct()
    every = docs.select(F.col(id_col).alias("__id"), whole_text(text_col).alias("__text")).withColumn(
        "__maybe", in_bitmap(id_bitmap(mark).scalar(), F.col("__id")))
    # only texts whose id the bitmap has meet the trusted ids, the others stay
    met = every.where("__maybe").join(mark.withColumn("__trusted", F.lit(1)).hint("merge"), "__id", "left")
    rows = every.where(~F.col("__maybe")).select("__text", F.lit(None).cast("int").alias("__trusted")).unionByName(
        met.select("__text", "__trusted"))
    counts = (rows.select(F.coalesce("__trusted", F.lit(0)).alias("t"),
                          F.explode(buckets(F.col("__text"), n)).alias("bucket"))
              .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("t").alias("target")))
    every = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(counts, "bucket", "left").select(
        "bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    table = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "target"))).alias("c"),
                     F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    share = F.col("target") / F.col("raw")
    return table.select(F.transform("c", lambda c: F.when(F.coalesce(F.col("target"), F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.log((c["target"] + smooth * share) / (share * (c["raw"] + smooth))))).alias("weights"))


def score(text: Column, table: Column, n: int = BUCKETS) -> Column:
    """Mean weight of the text's n-grams; 0 without any."""
    mean = lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(
        F.aggregate(g, F.lit(0.0), lambda s, b: s + F.get(table, b)) / F.size(g))
    return bind(buckets(text, n), mean)


def repeat_words(w: Column) -> Column:
    """Words of the word array ``w`` that lie in a three-word window that
    occurs at least twice in it."""
    def words_at(first: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(first, lambda i: F.array(i, i + 1, i + 2)))))

    def few(h: Column, twice: Column) -> Column:
        at = F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i))
        return words_at(F.filter(at, lambda i: i.isNotNull()))

    def many(h: Column) -> Column:
        def again(s: Column) -> Column:
            rep = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
            return words_at(F.transform(rep, lambda x: x["i"]))

        return bind(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), again)

    def covered(h: Column) -> Column:
        def by(twice: Column) -> Column:
            return F.when(F.size(twice) <= FEW, few(h, twice)).otherwise(many(h))

        repeated = lambda s: F.array_distinct(F.filter(s, lambda x, j: x == F.get(s, j - 1)))
        return bind(bind(F.sort_array(h), repeated), by)

    windows = F.transform(F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))),
                          lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x))
    some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(bind(windows, some))


def base_rules(text: Column) -> Column:
    """Struct of the base counts of one text and ``base_failed``."""
    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("word_chars"),
            repeat_words(w).cast("long").alias("n_repeat_words"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return F.struct(
        bind(words(text), of_words).alias("w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))


def _judged(docs: DataFrame, trusted: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__verdict``: base, score, failed, kept.  The verdict is
    one expression that names its parts inside, so a filter on it computes
    them once."""
    def judge(x: Column) -> Column:
        n, rep = x["base"]["w"]["n_words"], x["base"]["w"]["n_repeat_words"]
        failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)
        return F.struct(x["base"].alias("base"), x["score"].alias("score"), failed.alias("failed"),
                        (~failed & (x["score"] >= threshold)).alias("kept"))

    weights = log_ratios(docs, trusted, id_col=id_col, text_col=text_col)
    both = lambda t: bind(F.struct(base_rules(t).alias("base"), score(t, F.col("__weights")).alias("score")), judge)
    return docs.withColumn("__weights", weights.scalar()).withColumn("__verdict", bind(whole_text(text_col), both))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, score per row."""
    v = F.col("__verdict")
    base = v["base"]
    return _judged(docs.select(id_col, text_col), trusted, threshold, id_col, text_col).select(
        F.col(id_col), base["w"]["n_words"].alias("n_words"), base["w"]["word_chars"].alias("word_chars"),
        base["n_symbols"].alias("n_symbols"), base["n_dup_lines"].alias("n_dup_lines"),
        base["w"]["n_repeat_words"].alias("n_repeat_words"), v["failed"].alias("base_failed"),
        v["kept"].alias("kept"), v["score"].alias("score"))


def keep_good(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    return _judged(docs, trusted, threshold, id_col, text_col).where("__verdict.kept").select(
        *[F.col(f"`{c}`") for c in docs.columns])
