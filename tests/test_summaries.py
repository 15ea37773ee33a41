"""Summary operators: properties of dedupe, extractive summary, labels."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import models, summaries as SM

TEXT = ("Plastic waste is collected in many cities today. Plastic waste is collected in many cities today! "
        "Short one. Recycling plants sort bottles and films by polymer type. "
        "Recycling plants sort bottles and films by polymer type? Landfill remains cheap in some regions of the world.")


def test_dedupe_sentences_properties(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "Tiny. Also tiny."), (3, "")], "k long, t string")
    got = {r.k: r.refined for r in SM.dedupe_sentences(df, "k", "t", 0.9).collect()}
    kept = got[1].split(" ")
    assert "Short one." not in got[1]
    assert got[1].count("Plastic waste is collected") == 1
    assert got[1].count("Recycling plants sort") == 1
    assert "Landfill remains cheap" in got[1]
    assert got[2] == ""            # every sentence under 5 words
    assert got[3] == ""            # no sentences: unchanged input
    # subset of the input sentences, in order
    assert all(w in TEXT for w in kept)


def test_threshold_is_strict(spark):
    s = "One two three four five six. One two three four five six."
    df = spark.createDataFrame([(1, s)], "k long, t string")
    # identical sentences have cosine 1.0: kept at threshold 1.0 (test is '>')
    assert SM.dedupe_sentences(df, "k", "t", 1.0).first().refined == s
    assert SM.dedupe_sentences(df, "k", "t", 0.99).first().refined == "One two three four five six."


def test_extractive_summary_keeps_order(spark):
    df = spark.createDataFrame([(1, TEXT)], "k long, t string")
    out = SM.summarise(df, "k", "t").first().summary
    sents = [s for s in SM.sentences(df, "k", "t").orderBy("pos").select("sentence").toPandas().sentence]
    picked = [s for s in sents if s in out]
    assert picked and out == " ".join(picked)


def test_encoder_equals_a_plain_pass_with_no_digest_word_by_word(monkeypatch):
    texts = [TEXT, "", None, "One", "one two", "A1b \u00c9t\u00e9_x 12 12\n\u00e9t\u00e9", "!", TEXT.lower() * 3, "two one", "\u0130x y"]
    want = np.zeros((len(texts), 64))
    for row, t in zip(want, texts):
        w = re.findall(r"[^\W\d_]+|\d+", (t or "").lower())
        for feature in w + [" ".join(p) for p in zip(w, w[1:])]:
            h = int(hashlib.md5(feature.encode()).hexdigest()[:8], 16) % 128
            row[h % 64] += 1 if h < 64 else -1
        row /= np.linalg.norm(row) or 1.0
    real, digests = hashlib.md5, []
    monkeypatch.setattr(hashlib, "md5", lambda f: digests.append(f) or real(f))
    for at_once in (1, 7, 1 << 16):
        monkeypatch.setattr(models, "WORDS_AT_ONCE", at_once)
        predict = models.hashing_encoder()()
        assert np.allclose(predict(np.array(texts, dtype=object)), want, atol=1e-12)
        digests.clear()
        predict(np.array(texts, dtype=object))
        assert all(b" " in f for f in digests)  # the words are remembered, the pairs are not looked up
        assert len(predict(np.array([], dtype=object))) == 0


def plain_no_repeat(text, n=3):
    """Greedy choice by rank, sentence by sentence, outside Spark."""
    parts = [x for x in re.split(r"(?<=[.!?])\s+", text) if x]
    vecs = np.asarray(models.hashing_encoder()()(np.array(parts, dtype=object)), float)
    score = SM._cosines(vecs, vecs.mean(axis=0))
    chosen, words, seen = [], 0, []
    for r, i in enumerate(sorted(range(len(parts)), key=lambda i: (-score[i], i))):
        w = parts[i].lower().split()
        runs = [w[k:k + n] for k in range(len(w) - n + 1)]
        if r and (any(runs.count(x) > 1 for x in runs) or any(x in seen for x in runs)):
            continue
        if words < SM.MIN_LENGTH and (words + len(w) <= SM.MAX_LENGTH or r == 0):
            chosen.append(i)
            seen += runs
        words += len(w)
    return " ".join(parts[i] for i in sorted(chosen)), seen


def test_extractive_summary_without_repeated_runs(spark):
    echo = "We say it again we say it again today. " + TEXT
    texts = [TEXT, echo, TEXT + " " + TEXT, "One. Two words. One."]
    df = spark.createDataFrame(list(enumerate([*texts, "", None])), "k long, t string")
    got = {r.k: r.summary for r in SM.summarise(df, "k", "t", no_repeat=3).collect()}
    for k, text in enumerate(texts):
        want, runs = plain_no_repeat(text)
        assert got[k] == want
        assert len(set(map(tuple, runs))) == len(runs)
    assert "we say it again we say it" not in got[1].lower()
    assert got[2].count("Recycling plants sort") == 1 and got[2].count("Landfill remains") == 1
    assert set(got) == set(range(6))


def test_keyword_labels(spark):
    df = spark.createDataFrame([(1, "Recycling of plastic bottles; plastic bottles recycling study"),
                                (2, "the of and")], "k long, t string")
    kw = SM.keyword_labels(df, "k", "t", n=3)
    rows = kw.where("k = 1").orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2, 3]
    assert all("study" not in r.keyword.split() for r in rows)
    lab = {r.k: r.label for r in SM.best_label(kw, df, "k").collect()}
    assert lab[2] == SM.UNLABELED and lab[1] == lab[1].title()


def test_embed_and_kmeans_groups(spark):
    df = spark.createDataFrame([(i, f"doc number {i % 3} about topic {i % 3}") for i in range(12)],
                               "doc_id long, text string")
    e = models.embed(df, "text")
    vecs = e.collect()
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-5 for r in vecs)
    g = models.subtheme_groups(e.withColumn("topic", F.lit(0)).withColumn("rank", F.col("doc_id").cast("int")),
                               k=3)
    groups = {}
    for r in g.collect():
        groups.setdefault(r.subtheme, set()).add(r.doc_id % 3)
    assert sorted(groups) == [1, 2, 3] and all(len(v) == 1 for v in groups.values())


def test_mmr_picks_distinct(spark):
    rows = [(0, "a", [1.0, 0.0], [1.0, 0.1]), (0, "a2", [0.99, 0.01], [1.0, 0.1]),
            (0, "b", [0.0, 1.0], [1.0, 0.1])]
    df = spark.createDataFrame(rows, "topic int, term string, term_vec array<double>, topic_vec array<double>")
    got = [r.term for r in models.mmr(df, "topic", 2).orderBy("rank").collect()]
    # a2 is closest to the topic (0.996 vs 0.995); b is the diverse second pick
    assert got == ["a2", "b"]
