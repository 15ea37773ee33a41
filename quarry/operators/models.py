"""Model-backed operators: text embedding (M1), dimension reduction (M3),
per-topic k-means sub-themes (M5), keyword ranking by vector (M10), MMR
re-ranking (M9).

Models are *user supplied*: ``embed`` takes a ``make_predict_fn`` in the
form of ``pyspark.ml.functions.predict_batch_udf`` (loaded once per Python
worker, fed Arrow batches of ``batch_size`` texts).  Without one, a
deterministic feature-hashing encoder is used; it keeps every job runnable
offline but carries no semantic quality claim.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the reference.
ENCODER_BATCH = 64
# The reference's 64-text batch bounds GPU memory of its model; the offline
# hashing encoder has no such bound and runs on whole Arrow batches.
HASH_BATCH = 4096
SUBTHEMES = 10
KMEANS_ROUNDS = 40
MMR_DIVERSITY = 0.99
HASH_DIM = 64
HASH_MEMO = 500_000  # words whose slot a worker remembers
WORDS_AT_ONCE = 1 << 16  # words that a worker hashes at a time, if a text ends
# Cosines are ranked by this many decimals, ties by text.
RANK_DECIMALS = 9


def hashing_encoder(dim: int = HASH_DIM):
    """``make_predict_fn`` of the offline encoder: signed feature hashing of
    lower-cased word unigrams and bigrams, L2-normalised, in doubles.

    A feature's slot and sign come from the first 8 hex digits of its MD5, so
    any engine can compute the same vectors.  Words are memoised per worker
    (bounded); most pairs of words are new ones, so these are hashed at once
    and counted text by text, as whole columns."""

    def make():
        import re
        from hashlib import md5

        word = re.compile(r"[^\W\d_]+|\d+", re.UNICODE)

        def slots_of(features) -> np.ndarray:
            first = np.frombuffer(b"".join([md5(f).digest() for f in features]), ">u4")[::4]
            return first.astype(np.int64) % (2 * dim)  # the upper half counts down

        class Slots(dict):
            def __missing__(self, feature: str) -> int:
                if len(self) >= HASH_MEMO:
                    self.clear()
                slot = self[feature] = int(slots_of([feature.encode()])[0])
                return slot

        slots = Slots()

        def counted(words: list[str], lengths: list[int]) -> np.ndarray:
            """Features by text and slot, of texts that have ``lengths`` of the words."""
            at = np.repeat(np.arange(len(lengths)) * (2 * dim), lengths)  # where a word's text begins
            raw = "\n".join(words).encode().split(b"\n")  # no word has a line end
            pairs = slots_of(map(b" ".join, zip(raw, raw[1:])))
            own = at[1:] == at[:-1]  # both words are of one text
            places = np.concatenate([at + np.fromiter(map(slots.__getitem__, words), np.int64, len(words)),
                                     at[1:][own] + pairs[own]])
            return np.bincount(places, minlength=len(lengths) * 2 * dim).reshape(-1, 2 * dim)

        def predict(texts: np.ndarray) -> np.ndarray:
            out, begin, words, lengths = np.zeros((len(texts), dim)), 0, [], []
            for i, t in enumerate(texts, 1):
                toks = word.findall(str(t).lower()) if t is not None else []
                words += toks
                lengths.append(len(toks))
                if words and (len(words) >= WORDS_AT_ONCE or i == len(texts)):
                    n = counted(words, lengths)
                    out[begin:i] = n[:, :dim] - n[:, dim:]
                    begin, words, lengths = i, [], []
            norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
            return out / np.where(norms > 0, norms, 1.0)

        return predict

    return make


def embedder(make_predict_fn=None, batch_size: int | None = None):
    """The batched embedding UDF (string -> array<float>)."""
    if batch_size is None:
        batch_size = ENCODER_BATCH if make_predict_fn is not None else HASH_BATCH
    return predict_batch_udf(make_predict_fn or hashing_encoder(),
                             return_type=T.ArrayType(T.DoubleType()),
                             batch_size=batch_size)


def embed(df: DataFrame, text_col: str, out_col: str = "embedding",
          make_predict_fn=None, batch_size: int | None = None) -> DataFrame:
    """M1: add a sentence vector per row (as array<double>)."""
    udf = embedder(make_predict_fn, batch_size)
    return df.withColumn(out_col, udf(F.coalesce(F.col(text_col), F.lit(""))).cast("array<double>"))


def reduce_dim(df: DataFrame, vec_col: str = "embedding", k: int = 2,
               out_cols=("x", "y")) -> DataFrame:
    """M3 (re-aimed): L2-normalise then PCA to k dimensions.

    PCA fits on a D x D covariance aggregated across the cluster; the
    projection is a per-row map.  UMAP's non-linear layout is not
    reproduced (results differ by design)."""
    v = df.withColumn("_v", array_to_vector(F.col(vec_col)))
    v = Normalizer(inputCol="_v", outputCol="_n", p=2.0).transform(v)
    model = PCA(k=k, inputCol="_n", outputCol="_p").fit(v)
    out = model.transform(v).withColumn("_a", vector_to_array("_p"))
    axes = model.pc.toArray()
    for i, name in enumerate(out_cols[:k]):
        # the largest loading of an axis is positive
        up = float(np.sign(axes[np.argmax(np.abs(axes[:, i])), i]) or 1.0)
        out = out.withColumn(name, F.col("_a")[i] * up)
    return out.drop("_v", "_n", "_p", "_a")


def _kmeans(x: np.ndarray, k: int, iters: int = KMEANS_ROUNDS) -> np.ndarray:
    """Lloyd iterations from farthest-first centres: the first row, then each
    time the row farthest from all centres (ties: the earlier row).  No
    randomness; distances are compared to ``RANK_DECIMALS`` decimals."""
    def to(c: np.ndarray) -> np.ndarray:
        return np.round(np.sqrt(((x - c) ** 2).sum(1)), RANK_DECIMALS)

    chosen, gap = [0], to(x[0])
    while len(chosen) < k:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, to(x[chosen[-1]]))
    c = x[chosen]
    labels = np.full(len(x), -1)
    for _ in range(iters):
        new = np.column_stack([to(m) for m in c]).argmin(1)
        if np.array_equal(new, labels):
            break
        labels = new
        c = np.array([x[labels == j].mean(0) if (labels == j).any() else c[j] for j in range(k)])
    return labels


def subtheme_groups(docs: DataFrame, group_col: str = "topic", id_col: str = "doc_id",
                    vec_col: str = "embedding", order_col: str = "rank",
                    k: int = SUBTHEMES) -> DataFrame:
    """M5: k = min(k, n) k-means inside each topic's document set.

    Input groups are a topic's ranked top documents (bounded by W1), so one
    group is a small task.  Sub-themes are numbered 1.. in ascending k-means
    label order, as the reference sorts its group keys.
    Output: (topic, subtheme, doc_id, rank)."""

    def per_topic(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order_col).reset_index(drop=True)
        x = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col]])
        kk = min(k, len(pdf))
        labels = _kmeans(x, kk)
        remap = {lab: i + 1 for i, lab in enumerate(sorted(set(labels.tolist())))}
        return pd.DataFrame({
            group_col: pdf[group_col].astype("int32"),
            "subtheme": np.array([remap[v] for v in labels], dtype=np.int32),
            id_col: pdf[id_col].astype("int64"),
            order_col: pdf[order_col].astype("int32"),
        })

    schema = f"{group_col} int, subtheme int, {id_col} long, {order_col} int"
    src = docs.select(F.col(group_col).cast("int").alias(group_col), F.col(id_col).cast("long").alias(id_col),
                      F.col(vec_col), F.col(order_col).cast("int").alias(order_col))
    return src.groupBy(group_col).applyInPandas(per_topic, schema)


def rank_by_vector(cands: DataFrame, group_col: str, term_col: str = "term",
                   sim_col: str = "sim", n: int | None = None) -> DataFrame:
    """Order candidate terms by cosine to their group's vector."""
    w = Window.partitionBy(group_col).orderBy(F.desc(F.round(sim_col, RANK_DECIMALS)), F.asc(term_col))
    out = cands.withColumn("rank", F.row_number().over(w).cast("int"))
    return out.where(F.col("rank") <= n) if n else out


def mmr(cands: DataFrame, group_col: str, top_n: int, diversity: float = MMR_DIVERSITY,
        term_col: str = "term", vec_col: str = "term_vec", topic_vec_col: str = "topic_vec") -> DataFrame:
    """M9: maximal marginal relevance re-ranking per group (greedy).

    score(c) = (1 - diversity) * sim(c, topic) - diversity * max sim(c, chosen).
    Groups are one topic's candidate terms (bounded by the keyword list)."""

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(term_col)  # ties go to the first term, whatever order rows arrive in
        words = pdf[term_col].tolist()
        wv = np.vstack([np.asarray(v, dtype=np.float64) for v in pdf[vec_col]])
        tv = np.asarray(pdf[topic_vec_col].iloc[0], dtype=np.float64)

        def unit(m):
            nr = np.linalg.norm(m, axis=-1, keepdims=True)
            return m / np.where(nr > 0, nr, 1.0)

        wv, tv = unit(wv), unit(tv)
        rel = np.round(wv @ tv, RANK_DECIMALS)
        pair = np.round(wv @ wv.T, RANK_DECIMALS)
        chosen = [int(np.argmax(rel))]
        rest = [i for i in range(len(words)) if i != chosen[0]]
        while rest and len(chosen) < min(top_n, len(words)):
            red = pair[np.ix_(rest, chosen)].max(axis=1)
            score = np.round((1 - diversity) * rel[rest] - diversity * red, RANK_DECIMALS)
            pick = rest[int(np.argmax(score))]
            chosen.append(pick)
            rest.remove(pick)
        return pd.DataFrame({group_col: [pdf[group_col].iloc[0]] * len(chosen),
                             "rank": np.arange(1, len(chosen) + 1, dtype=np.int32),
                             term_col: [words[i] for i in chosen]})

    schema = f"{group_col} int, rank int, {term_col} string"
    return cands.groupBy(group_col).applyInPandas(per_group, schema)
