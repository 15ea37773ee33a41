"""Substring occurrence counts and trend tables against brute force."""

import random

from quarry.operators import trends as TR

TEXTS = ["Plastic waste and plastic wastes; BIOPLASTIC WASTE.", "waste plastic waste plastic",
         "aaaa aaaa", "", "nothing here"]
TERMS = ["plastic waste", "waste plastic", "aa", "here"]


def test_occurrences_equal_str_count(spark):
    docs = spark.createDataFrame([(i, t, 2015 + i, i % 2) for i, t in enumerate(TEXTS)],
                                 "doc_id long, abstract string, year int, cluster int")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    got = {(r.doc_id, r.term): r.n for r in TR.term_occurrences(docs, terms).collect()}
    exp = {(i, t): t_.lower().count(t) for i, t_ in enumerate(TEXTS) for t in TERMS if t_.lower().count(t)}
    assert got == exp
    occ = TR.term_occurrences(docs, terms)
    top = TR.top_terms_global(occ, 2).collect()
    assert [r.term for r in top] == ["aa", "plastic waste"]
    yearly = TR.trend_by_year(occ, docs, terms.where("term = 'here'"), (2015, 2020)).collect()
    assert len(yearly) == 6 and sum(r.n for r in yearly) == 1
    ct = spark.createDataFrame([(0, "plastic waste"), (0, "here"), (1, "aa")], "cluster int, term string")
    by = TR.trend_by_cluster(occ, docs, ct, (2015, 2019)).collect()
    # 'here' is in a cluster-0 doc (doc 4, cluster 0) -> kept; all zero terms dropped
    kept = {(r.cluster, r.term) for r in by}
    assert kept == {(0, "plastic waste"), (0, "here")}
    assert all(len([r for r in by if (r.cluster, r.term) == k]) == 5 for k in kept)


def test_overlaps_prefixes_and_special_characters(spark):
    terms = ["a", "ab", "aba", "abab", "b a", "c++ code", "(x)", "waste"]
    texts = ["abababab", "aab a ba", "c++ code (x)(x) c++ code", "ab", "wastewaste b a b a", "é aba é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, abstract string")
    got = {(r.doc_id, r.term): r.n for r in TR.term_occurrences(
        docs, spark.createDataFrame([(t,) for t in terms + [None, ""]], "term string")).collect()}
    assert got == {(i, t): x.count(t) for i, x in enumerate(texts) for t in terms if x.count(t)}
    assert TR.term_occurrences(docs, spark.createDataFrame([], "term string")).collect() == []


def test_blocks_of_terms_give_the_same_counts(spark, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abç 😀") for _ in range(rng.choice([0, 30, 4000]))) for _ in range(25)] + [None, "AbA"]
    terms = sorted({"".join(rng.choice("abç 😀") for _ in range(rng.randint(1, 4))) for _ in range(60)})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, abstract string")
    want = {(i, t): x.lower().count(t) for i, x in enumerate(texts) if x for t in terms if x.lower().count(t)}
    listed = spark.createDataFrame([(t,) for t in terms + terms[:5]], "term string")
    for size in (TR.TERMS_PER_PASS, 15):
        monkeypatch.setattr(TR, "TERMS_PER_PASS", size)
        got = [((r.doc_id, r.term), r.n) for r in TR.term_occurrences(docs, listed).collect()]
        assert len(got) == len(want) and dict(got) == want


def test_hits_are_not_shuffled(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, abstract string")
    plans = []
    monkeypatch.setattr(TR, "written_table", lambda df: plans.append(df._jdf.queryExecution().toString()) or df)
    TR.term_occurrences(docs, spark.createDataFrame([("a",)], "term string"))
    assert len(plans) == 1 and "MapInArrow" in plans[0] and "Exchange" not in plans[0]
