"""Summaries of topic documents.

The reference runs a seq2seq model per chunk; here the summariser is a
user ``make_predict_fn`` (text -> text) run by ``predict_batch_udf``, and the
offline default is *extractive*: the sentences closest to the text's own
sentence centroid, kept in their original order.  Splitting, encoding, ranking
and the greedy redundancy filter (M15) work on one text at a time inside an
Arrow batch (``_per_text``), so they neither shuffle nor store vectors.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from quarry.functions import text as T
from quarry.functions.stopwords import label_stop_words
from quarry.operators import models, similarity as S
from quarry.session import reliable_checkpoint

# Fixed values of the reference's summariser.
NO_REPEAT = 3  # fixed: words of a run that a summary has once
MIN_LENGTH = 150
MAX_LENGTH = 1024
SLICE_TEXTS = 256  # texts whose parts are held at once
SLICE_ROWS = 256   # sentences of a text that meet the kept ones at once
NUM_LABELS = 5
MIN_SENTENCE_WORDS = 5
REFINE_THRESHOLD = 0.9
ITERATIVE_THRESHOLD = 0.85
ITERATIONS = 3
CENTROID_THRESHOLD = 0.5
UNLABELED = "Unlabeled Subtheme"
KEYWORD_TOKEN = r"[\p{L}\p{M}\p{N}_]{2,}"  # words of two and more characters


def sentences(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, pos, sentence, n_words) -- F9 + F10, positions from 0."""
    return (df.select(key, F.posexplode(T.split_sentences(text_col)).alias("pos", "sentence"))
            .withColumn("n_words", T.word_count("sentence")))


def _encode_all(predict, texts: list[str], batch_size: int) -> np.ndarray:
    """Vectors of a list of texts, ``batch_size`` at a time."""
    parts = [np.asarray(predict(np.array(texts[i:i + batch_size], dtype=object)), dtype=np.float64)
             for i in range(0, len(texts), batch_size)]
    return np.concatenate(parts) if parts else np.zeros((0, 0))


def _cosines(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of each row to a vector, 0 for zero vectors, as ranked."""
    denom = np.linalg.norm(m, axis=1) * np.linalg.norm(v)
    return np.round(np.where(denom > 0, m @ v / np.where(denom > 0, denom, 1.0), 0.0), models.RANK_DECIMALS)


def _per_text(df: DataFrame, key: str, text_col: str, items: Column | None, fn, out: str,
              make_predict_fn=None, whole_text: bool = False) -> DataFrame:
    """Row-local work on the parts of each text: ``items`` is an array of
    structs with ``part``, computed on the JVM, or None for the text's
    sentences (``sentence_items``).  All parts of ``SLICE_TEXTS`` texts are
    encoded together, so what a task holds does not grow with its Arrow batch,
    and ``fn(text, items, vectors)`` gives the output rows of one text.  No
    shuffle, nothing is materialised.  With ``whole_text`` the text's own
    vector comes first."""
    make = make_predict_fn or models.hashing_encoder()
    size = models.ENCODER_BATCH if make_predict_fn is not None else models.HASH_BATCH
    key_type = dict(df.dtypes)[key]
    names = [c.split()[0] for c in out.split(", ")]
    own = items is None

    def run(batches):
        predict = make()
        for batch in batches:
            for begin in range(0, len(batch), SLICE_TEXTS):
                pdf = batch.iloc[begin:begin + SLICE_TEXTS]
                if own:
                    parts = [sentence_items(t) for t in pdf["_text"]]
                else:
                    parts = [list(x) if x is not None else [] for x in pdf["_items"]]
                flat = []
                for text, xs in zip(pdf["_text"], parts):
                    flat += ([text or ""] if whole_text else []) + [x["part"] for x in xs]
                vecs, at, rows = _encode_all(predict, flat, size), 0, []
                for k, text, xs in zip(pdf[key], pdf["_text"], parts):
                    n = len(xs) + whole_text
                    rows += [(k, *r) for r in fn(text, xs, vecs[at:at + n])]
                    at += n
                yield pd.DataFrame(rows, columns=[key, *names])

    src = df.select(key, F.col(text_col).alias("_text"), *([] if own else [items.alias("_items")]))
    return src.mapInPandas(run, f"{key} {key_type}, {out}")


_SENTENCE_END = re.compile(T.SENTENCE_END)


def sentence_items(text: str | None) -> list[dict]:
    """F9 + F10 of one text, as ``text.split_sentences`` and ``word_count``
    (``str.split`` knows the same white space)."""
    if not text:
        return []
    marked = _SENTENCE_END.sub(r"\1" + T.SENTENCE_SEP, text)
    return [{"part": s, "n_words": len(s.split())} for s in marked.split(T.SENTENCE_SEP) if s]


def dedupe_sentences(df: DataFrame, key: str, text_col: str,
                     threshold: float = REFINE_THRESHOLD, make_predict_fn=None) -> DataFrame:
    """Drop sentences under 5 words, and any sentence whose cosine to an
    already kept sentence is > threshold (greedy, in order).  No sentences:
    text unchanged; all short: ''.  Output (key, refined)."""

    def greedy(text, items, vecs):
        if not items:
            return [(text,)]
        long = [i for i, s in enumerate(items) if s["n_words"] >= MIN_SENTENCE_WORDS]
        return [(" ".join(items[long[i]]["part"] for i in distinct_rows(vecs[long], threshold)),)]

    return _per_text(df, key, text_col, None, greedy, "refined string", make_predict_fn)


def distinct_rows(vecs: np.ndarray, threshold: float) -> list[int]:
    """Rows whose cosine to no earlier kept row is above ``threshold``; a slice
    of rows meets what is kept in one product."""
    norm = np.linalg.norm(vecs, axis=1) if len(vecs) else np.zeros(0)
    kept: list[int] = []

    def near(rows, others):
        denom = np.outer(norm[rows], norm[others])
        cos = np.where(denom > 0, vecs[rows] @ vecs[others].T / np.where(denom > 0, denom, 1.0), 0.0)
        return np.round(cos, models.RANK_DECIMALS) > threshold

    for at in range(0, len(vecs), SLICE_ROWS):
        rows = np.arange(at, min(at + SLICE_ROWS, len(vecs)))
        if kept:
            rows = rows[~near(rows, np.array(kept)).any(axis=1)]
        among = near(rows, rows)
        gone = np.zeros(len(rows), bool)
        for i in range(len(rows)):
            if not gone[i]:
                kept.append(int(rows[i]))
                gone |= among[i]
    return kept


def word_grams(sentence: str, n: int) -> list[tuple[str, ...]]:
    """Runs of ``n`` words, in lower case, in order."""
    w = sentence.lower().split()
    return [tuple(w[i:i + n]) for i in range(len(w) - n + 1)]


def extractive_summary(df: DataFrame, key: str, text_col: str, make_predict_fn=None,
                       min_words: int = MIN_LENGTH, max_words: int = MAX_LENGTH,
                       no_repeat: int | None = None) -> DataFrame:
    """M16 offline default: highest-centrality sentences, original order.
    Output (key, summary, source): ``source`` is the text itself.

    Sentences are ranked by cosine to the mean sentence vector of their
    text; they are taken in rank order until ``min_words`` is reached
    (never beyond ``max_words``), then re-ordered by position.

    ``no_repeat`` (the reference's decoder rule, 3): a sentence that has a run
    of so many words twice, or one of a sentence taken before it, is passed
    over and its words count nothing.  The set of runs taken is kept per text.
    Only the first of the ranking is taken in any case."""

    def central(text, items, vecs):
        if not items:
            return [(None, text)]
        score = _cosines(vecs, vecs.mean(axis=0))
        chosen, words, taken = [], 0, set()
        for r, i in enumerate(np.lexsort((np.arange(len(items)), -score)).tolist()):
            n = items[i]["n_words"]
            if no_repeat is not None:
                grams = word_grams(items[i]["part"], no_repeat)
                if r and (len(set(grams)) < len(grams) or not taken.isdisjoint(grams)):
                    continue
                if words < min_words and (words + n <= max_words or r == 0):
                    taken.update(grams)
            if words < min_words and (words + n <= max_words or r == 0):
                chosen.append(i)
            words += n
        return [(" ".join(items[i]["part"] for i in sorted(chosen)), text)]

    return _per_text(df, key, text_col, None, central, "summary string, source string",
                     make_predict_fn)


def summarise(df: DataFrame, key: str, text_col: str, summariser=None,
              make_predict_fn=None, no_repeat: int | None = None) -> DataFrame:
    """User seq2seq model when given, else the extractive default;
    a failed (null) summary falls back to the first 500 characters (F25)."""
    if summariser is not None:
        udf = predict_batch_udf(summariser, return_type=Ty.StringType(), batch_size=8)
        out = df.select(key, text_col, udf(F.col(text_col)).alias("summary"))
    else:
        out = extractive_summary(df, key, text_col, make_predict_fn, no_repeat=no_repeat).withColumnRenamed("source", text_col)
    return out.select(key, T.fallback_text(F.col("summary"), F.col(text_col)).alias("summary"))


def keyword_labels(df: DataFrame, key: str, text_col: str, n: int = NUM_LABELS,
                   make_predict_fn=None, stop_words=None) -> DataFrame:
    """Candidate 1-3-grams (stop words removed) ranked by cosine to the
    text's vector; output (key, rank, keyword, sim) for the best n."""
    stop = list(stop_words if stop_words is not None else label_stop_words())
    toks = F.filter(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(KEYWORD_TOKEN), 0),
                    lambda t: ~t.isin(stop))
    grams = F.transform(F.array(toks), lambda t: F.array_sort(F.array_distinct(T.ngram_range(t, 1, 3)))).getItem(0)

    def closest(text, items, vecs):
        sims = _cosines(vecs[1:], vecs[0]) if items else np.zeros(0)
        order = np.lexsort((np.arange(len(items)), -sims))[:n].tolist()  # items are sorted by keyword
        return [(r + 1, items[i]["part"], float(sims[i])) for r, i in enumerate(order)]

    return _per_text(df, key, text_col, F.transform(grams, lambda g: F.struct(g.alias("part"))), closest,
                     "rank int, keyword string, sim double", make_predict_fn, whole_text=True)


def best_label(labels: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """M14 label: best keyword title-cased, else 'Unlabeled Subtheme'."""
    best = labels.where(F.col("rank") == 1).select(key, T.title_case("keyword").alias("label"))
    return base.select(key).join(best, key, "left").select(
        key, F.coalesce("label", F.lit(UNLABELED)).alias("label"))


def iterative_summary(df: DataFrame, key: str, text_col: str, iterations: int = ITERATIONS,
                      threshold: float = ITERATIVE_THRESHOLD, summariser=None,
                      make_predict_fn=None) -> DataFrame:
    """Repeat (summarise -> F7 clean -> M15 at 0.85); each pass is
    checkpointed so the plan does not grow with the number of passes."""
    cur = df.select(key, F.col(text_col).alias("text"))
    for _ in range(iterations):
        s = summarise(cur, key, "text", summariser, make_predict_fn)
        s = s.select(key, T.clean_final_summary("summary").alias("text"))
        r = dedupe_sentences(s, key, "text", threshold, make_predict_fn)
        cur = reliable_checkpoint(r.select(key, F.col("refined").alias("text")))
    return cur.withColumnRenamed("text", text_col)


def topic_report(topic_docs: DataFrame, labels_map: DataFrame | None = None,
                 summariser=None, make_predict_fn=None) -> DataFrame:
    """M19 (with M18): one report row per topic.

    ``topic_docs``: (topic, doc_id, rank, text, embedding) -- each topic's
    ranked top documents (bounded by W1).  Steps: P11 centroid filter ->
    M5 sub-themes -> A1 chunks -> M14 labels + M16 summaries -> F24 entries
    joined by newline -> M16 -> F7 -> M17 -> M14 final labels.
    ``documents_used`` is the unfiltered group size; a topic whose filter
    keeps nothing, or whose summary comes out empty, reports nulls and the
    reason in ``error`` instead of failing."""
    # the input is bounded (top documents per topic) and read by several
    # branches: materialise it and the filtered set once
    topic_docs = reliable_checkpoint(topic_docs)
    sizes = topic_docs.groupBy("topic").agg(F.count(F.lit(1)).alias("documents_used"))
    kept = reliable_checkpoint(S.centroid_filter(topic_docs.withColumnRenamed("topic", "cluster"),
                                                 CENTROID_THRESHOLD).withColumnRenamed("cluster", "topic"))
    groups = models.subtheme_groups(kept, "topic", "doc_id", "embedding", "rank")
    chunk = (groups.join(kept.select("topic", "doc_id", "text"), ["topic", "doc_id"])
             .groupBy("topic", "subtheme")
             .agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("s"))
             .select(F.concat_ws("#", F.col("topic").cast("string"), F.col("subtheme").cast("string")).alias("ck"),
                     "topic", "subtheme",
                     F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("chunk")))
    chunk = reliable_checkpoint(chunk)
    sub_lab = best_label(keyword_labels(chunk, "ck", "chunk", make_predict_fn=make_predict_fn), chunk, "ck")
    sub_sum = summarise(chunk, "ck", "chunk", summariser, make_predict_fn).select(
        "ck", T.postprocess_summary("summary").alias("summary"))
    if labels_map is not None:
        tl = labels_map.select(F.col("topic").cast("int").alias("topic"), F.col("label").alias("topic_label"))
    else:
        tl = chunk.select("topic").distinct().withColumn("topic_label", F.lit(None).cast("string"))
    entries = (chunk.join(sub_lab, "ck").join(sub_sum, "ck").join(tl, "topic", "left")
               .withColumn("topic_label", F.coalesce("topic_label",
                                                     F.concat(F.lit("Topic_"), F.col("topic").cast("string"))))
               .withColumn("entry", T.prefix_label("topic_label", "summary", "subtheme", "label")))
    per_topic = (entries.groupBy("topic", "topic_label")
                 .agg(F.array_sort(F.collect_list(F.struct("subtheme", "entry"))).alias("s"))
                 .select("topic", "topic_label",
                         F.array_join(F.transform("s", lambda x: x["entry"]), "\n").alias("subtheme_summaries")))
    per_topic = reliable_checkpoint(per_topic)
    overall = summarise(per_topic, "topic", "subtheme_summaries", summariser, make_predict_fn)
    overall = overall.select("topic", T.clean_final_summary("summary").alias("overall"))
    overall = iterative_summary(overall, "topic", "overall", summariser=summariser,
                                make_predict_fn=make_predict_fn)
    final = keyword_labels(overall, "topic", "overall", make_predict_fn=make_predict_fn)
    final_str = (final.groupBy("topic")
                 .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))),
                                               lambda x: T.title_case(x["keyword"])), ", ").alias("final_topic_labels")))
    return (sizes.join(per_topic, "topic", "left").join(overall, "topic", "left")
            .join(final_str, "topic", "left")
            .select(F.col("topic").alias("topic_id"), F.col("topic_label").alias("topic_labels"),
                    "final_topic_labels", F.col("overall").alias("overall_summary"),
                    "subtheme_summaries", "documents_used",
                    F.when(F.col("subtheme_summaries").isNull(), F.lit("no document near the centroid"))
                    .when(F.coalesce(F.col("overall"), F.lit("")) == "", F.lit("empty summary")).alias("error")))
