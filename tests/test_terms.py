"""Class TF-IDF against a brute-force restatement of the formula."""

import math
from collections import Counter

from pyspark.sql import functions as F

from quarry.operators import rewrite, terms as TM


def brute(docs, min_df, max_df, n):
    counts = {}
    classes = sorted({c for c, _ in docs})
    for c, d in docs:
        toks = [t for t in d.split(" ") if t.isalpha() and t.isascii() and len(t) >= 5]
        grams = [" ".join(toks[i:i + 2]) for i in range(len(toks) - 1)] + \
                [" ".join(toks[i:i + 3]) for i in range(len(toks) - 2)]
        counts.setdefault(c, Counter()).update(grams)
    C = len(classes)
    dfc = Counter(t for c in counts for t in counts[c])
    kept = {t for t, k in dfc.items() if min_df * C <= k <= max_df * C}
    X = {c: {t: v for t, v in counts.get(c, {}).items() if t in kept} for c in classes}
    f = Counter()
    for c in classes:
        f.update(X[c])
    A = int(sum(sum(X[c].values()) for c in classes) / C)
    out = {}
    for c in classes:
        tot = sum(X[c].values())
        sc = {t: v / tot * math.log(1 + A / f[t]) for t, v in X[c].items()}
        out[c] = sorted(sc.items(), key=lambda kv: (-kv[1], kv[0]))[:n]
    return out


def make_docs():
    words = ["plastic", "waste", "recycling", "bottle", "ocean", "polymer", "membrane",
             "asphalt", "concrete", "battery"]
    docs = []
    for c in range(15):
        for j in range(3):
            seq = [words[(c + j + k) % len(words)] for k in range(8)]
            if c in (1, 7, 8):
                seq += ["shared", "edgeterm", "across"]  # 'edgeterm across' in 3 of 15
            docs.append((c, " ".join(seq)))
    return docs


def test_class_tfidf_matches_brute_force(spark):
    docs = make_docs()
    df = spark.createDataFrame([(i, c, d) for i, (c, d) in enumerate(docs)], "doc_id long, cluster int, doc string")
    n_cls = TM.n_classes(df)
    kept = TM.df_bounds(TM.class_term_counts(df), n_cls, min_df=0.05, max_df=0.5)
    got = TM.top_terms(TM.class_tfidf(kept, n_cls), 5).collect()
    exp = brute(docs, 0.05, 0.5, 5)
    by = {}
    for r in got:
        by.setdefault(r.cluster, []).append((r.rank, r.term, r.score))
    for c, lst in exp.items():
        mine = [(t, round(s, 9)) for _, t, s in sorted(by.get(c, []))]
        assert mine == [(t, round(s, 9)) for t, s in lst], c
    # ranks contiguous from 1
    for c, lst in by.items():
        assert sorted(r for r, _, _ in lst) == list(range(1, len(lst) + 1))


def test_df_bounds_edges(spark):
    # a term in 8 of 15 classes is above max_df = 0.5 (7.5); in 7 it is kept
    rows = []
    for c in range(15):
        toks = "alpha bravo" if c < 8 else "charl delta"
        rows.append((c, c, toks + (" echoo foxtr" if c < 7 else "")))
    df = spark.createDataFrame(rows, "doc_id long, cluster int, doc string")
    n_cls = TM.n_classes(df)
    kept = {r.term for r in TM.df_bounds(TM.class_term_counts(df), n_cls).select("term").distinct().collect()}
    assert "alpha bravo" not in kept and "charl delta" in kept and "echoo foxtr" in kept


ODD_TEXTS = [(1, "alpha bravo charl alpha bravo charl"), (1, "alpha bravo"), (2, "alpha bravo delta echoo"), (2, "alpha"),
             (None, "bravo charl alpha"), (None, None), (3, ""), (3, "x alpha  bravo y charl ab12c delta"), (1, "Alpha bravo")] + [(2, "alpha bravo charl")] * 9


def plain_counts(rows, lo, hi, stop=()):
    tf = Counter()
    for c, t in rows:
        toks = [w for w in (t or "").split(" ") if len(w) >= 5 and w.isalpha() and w.isascii() and w.islower() and w not in stop]
        tf.update((c, " ".join(toks[i:i + k])) for k in range(lo, hi + 1) for i in range(len(toks) - k + 1))
    return tf


def test_term_counts_and_stats_equal_a_plain_pass_in_any_stretches(spark, monkeypatch):
    for places, at_once in ((1, 1), (TM.PLACES_AT_ONCE, TM.ROWS_AT_ONCE), (7, 3)):
        monkeypatch.setattr(TM, "PLACES_AT_ONCE", places)
        monkeypatch.setattr(TM, "ROWS_AT_ONCE", at_once)
        for (lo, hi), stop in (((2, 3), None), ((1, 3), ["bravo"]), ((2, 2), None)):
            rows = [(i, *r) for i, r in enumerate(ODD_TEXTS)]
            docs = spark.createDataFrame(rows, "doc_id long, cluster int, doc string").repartition(3)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2 if places == 1 else 10000)
            got = TM.class_term_counts(docs, ngram_range=(lo, hi), vectorizer_stop=stop, with_stats=True).collect()
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            want = plain_counts(ODD_TEXTS, lo, hi, stop or ())
            f, n = Counter(), Counter(t for _, t in want)
            for (_, t), m in want.items():
                f[t] += m
            assert sorted(map(tuple, got), key=str) == sorted(((c, t, m, n[t], f[t]) for (c, t), m in want.items()), key=str)


def test_terms_are_shuffled_once_and_never_by_class(spark):
    docs = spark.createDataFrame([(i, c, d) for i, (c, d) in enumerate(make_docs())], "doc_id long, cluster int, doc string")
    n_cls = TM.n_classes(docs)
    kept = TM.df_bounds(TM.class_term_counts(docs, with_stats=True), n_cls)
    for best in (None, 5):
        plan = TM.class_tfidf(kept, n_cls, best=best)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning(term" not in plan
        assert "BroadcastHashJoin" in plan


def test_terms_left_out_are_below_the_nth_score(spark):
    docs = spark.createDataFrame([(i, c, d) for i, (c, d) in enumerate(make_docs())], "doc_id long, cluster int, doc string")
    n_cls = TM.n_classes(docs)
    kept = TM.df_bounds(TM.class_term_counts(docs, with_stats=True), n_cls)
    every = TM.class_tfidf(kept, n_cls).collect()
    for n in (1, 3, 1000):
        want = set()
        for c in {r.cluster for r in every}:
            own = sorted((r.score for r in every if r.cluster == c), reverse=True)
            want |= {(c, r.term, r.tf, r.score) for r in every if r.cluster == c and r.score >= own[min(n, len(own)) - 1]}
        best = TM.class_tfidf(kept, n_cls, best=n)
        assert {tuple(r) for r in best.collect()} == want
        # the terms are read from their one shuffle twice: for the pairs of tf and f, and for the best
        final = best._jdf.queryExecution().executedPlan().toString().split("\n+- == Initial Plan ==")[0]
        assert final.count("MapInArrow count") == 3 and "ReusedExchange" in final  # two of them after the shuffle


def test_groups_of_equal_figures_hold_every_term_and_the_first_ones(spark, monkeypatch):
    rows = [(i, *r) for i, r in enumerate(ODD_TEXTS + make_docs())]
    docs = spark.createDataFrame(rows, "doc_id long, cluster int, doc string").repartition(3)
    want = {}
    for r in TM.class_term_counts(docs, with_stats=True).collect():
        want.setdefault((r.cluster, r.tf, r.n_classes, r.f), []).append(r.term)
    for best, held in ((1, 1), (2, TM.FIGURES_AT_ONCE), (1000, 3)):
        monkeypatch.setattr(TM, "FIGURES_AT_ONCE", held)
        monkeypatch.setattr(TM, "ROWS_AT_ONCE", 5)
        monkeypatch.setattr(TM, "FEW_TERMS", best // 2)
        got = {}
        for r in TM.class_term_counts(docs, best=best).collect():
            assert len(r.terms) == min(best, r.n)
            n, terms = got.setdefault((r.cluster, r.tf, r.n_classes, r.f), (0, []))
            got[r.cluster, r.tf, r.n_classes, r.f] = n + r.n, terms + r.terms
        assert {k: n for k, (n, _) in got.items()} == {k: len(t) for k, t in want.items()}
        assert {k: sorted(t)[:best] for k, (_, t) in got.items()} == {k: sorted(t)[:best] for k, t in want.items()}


def test_best_terms_take_one_pass_over_the_counts(spark):
    rows = [(i, c, d) for i, (c, d) in enumerate(make_docs())]
    every = spark.createDataFrame(rows, "doc_id long, cluster int, abstract string")
    docs = TM.clustered_docs(every)
    n_cls = TM.n_classes(docs)
    scored = TM.class_tfidf(TM.df_bounds(TM.class_term_counts(docs, with_stats=True), n_cls), n_cls)
    for n in (1, 5, 1000):
        best = TM.topic_terms(every, n=n)
        assert "MapInArrow" not in best._jdf.queryExecution().executedPlan().toString()  # counted and written once before
        assert sorted(map(tuple, best.collect())) == sorted(map(tuple, TM.top_terms(scored, n).collect()))


def test_keywords_label_noise(spark):
    terms = spark.createDataFrame([(0, i, f"t{i}", 1.0) for i in range(1, 8)], "cluster int, rank int, term string, score double")
    topics = spark.createDataFrame([(0,), (-1,), (3,)], "cluster int")
    got = {r.cluster: r.keywords for r in TM.keywords_label(terms, topics).collect()}
    assert got == {0: "t1, t2, t3, t4, t5", -1: "Noise", 3: ""}


BASES = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"),
         ("men", "man"), ("ies", "y"))


def plain_lemmas(rows, table, min_share):
    n = Counter(t for r in rows for t in set(r or []))

    def lemma(t):
        if t in table:
            return table[t]
        if len(t) < 4 or t.endswith("ss"):
            return t
        bases = {t[:len(t) - len(e)] + b for e, b in BASES if t.endswith(e)}
        good = [b for b in bases if b in n and n[b] * min_share >= n[t]]
        return min(good, key=lambda b: (len(b), b)) if good else t

    return [None if r is None else [lemma(t) for t in r] for r in rows]


LEMMA_ROWS = [["bottles", "mice", "glass", "studies", "bottle"], ["study", "virus", "glas", "series"], [], None, [""],
              ["class", "classes", "clas", "women", "woman", "boxes", "box", "boxe"], ["bottles"] * 3, ["bottles"] * 3]


def test_lemmas_equal_a_plain_pass_in_both_ways(spark, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(LEMMA_ROWS)), "doc_id long, tok array<string>").repartition(3)
    table = spark.createDataFrame([("mice", "mouse"), ("mice", "mus"), ("virus", None)], "form string, lemma string")
    for min_share in (1, 100):
        want = plain_lemmas(LEMMA_ROWS, {"mice": "mouse"}, min_share)
        for most in (rewrite.MAX_ITEMS, 0):
            monkeypatch.setattr(rewrite.replace_items, "__defaults__", (most,))
            got = {r.doc_id: r.tok for r in TM.lemmatise(docs, "tok", table, min_share=min_share).collect()}
            assert [got[i] for i in range(len(LEMMA_ROWS))] == want
    assert want[0] == ["bottle", "mouse", "glass", "study", "bottle"]


def test_a_rare_form_is_no_base_of_a_common_one(spark):
    rows = [["virus"]] * 5 + [["viru", "virus"]]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, tok array<string>")
    assert TM.lemma_pairs(docs, "tok", min_share=5).count() == 0
    assert TM.lemma_pairs(docs, "tok", min_share=6).collect() == [("virus", "viru")]


def test_tokens_are_rewritten_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, ["bottles", "bottle"])], "doc_id long, tok array<string>")
    plan = TM.lemmatise(docs, "tok")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_replace_items_keeps_other_columns(spark):
    df = spark.createDataFrame([("a", ["x", None, "y"], 1.5), (None, None, None)], "`k.1` string, l array<string>, item double")
    table = spark.createDataFrame([("x", "z"), (None, "q")], "item string, value string")
    want = [("a", ["z", None, "y"], 1.5), (None, None, None)]
    for most in (10, 0):
        got = rewrite.replace_items(df, "l", table, most)
        assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert rewrite.replace_items(df.where("false"), "l", table).count() == 0
