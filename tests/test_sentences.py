"""Learned sentence ends on planted abbreviations, initials and numbers, and
against the same rules as SQL."""

import random

import duckdb
import pandas as pd

from quarry.operators import sentences as SE

NOUNS = ["water", "river", "bottle", "plastic", "market", "report", "sample", "filter", "sensor", "harbour"]
VERBS = ["shows", "holds", "moves", "needs", "keeps", "finds"]


def planted(n=400):
    rnd = random.Random(7)

    def noun():
        return rnd.choice(NOUNS)

    def sentence():
        kind = rnd.randrange(8)
        if kind == 0:
            return f"Yesterday Dr. Smith {rnd.choice(VERBS)} the {noun()} near the {noun()}."
        if kind == 1:
            return f"The {noun()} {rnd.choice(VERBS)} parts, e.g. the {noun()}, in the {noun()}."
        if kind == 2:
            return f"A paper by J. Keller {rnd.choice(VERBS)} the {noun()}."
        if kind == 3:
            return f"It {rnd.choice(VERBS)} 3.5 of a {noun()} and no. 12 of the {noun()}."
        if kind == 4:
            return f'He said "the {noun()} {rnd.choice(VERBS)} it."'
        return f"The {noun()} {rnd.choice(VERBS)} a {noun()} with the {noun()} and {rnd.choice(VERBS)} the {noun()}{rnd.choice('...!?')}"

    return [[sentence() for _ in range(rnd.randint(1, 6))] for _ in range(n)]


def sql_sentences(rows):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    return dict(con.execute(f"WITH {SE.sql()} SELECT doc_id, s FROM documents LEFT JOIN sents USING (doc_id)").fetchall())


def test_planted_sentences_come_back(spark):
    truth = planted()
    rows = [(i, " ".join(s)) for i, s in enumerate(truth)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = {r.type for r in SE.abbreviations(SE.token_counts(docs)).collect()}
    assert {"dr", "e.g", "no"} <= known and not known & set(NOUNS)
    got = {r.doc_id: r.sentences for r in SE.learned_sentences(docs).collect()}
    assert got == dict(enumerate(truth))
    assert got == sql_sentences(rows)


def test_edges_equal_the_sql_in_both_ways(spark):
    texts = ["", None, "   ", "One. Two.  ", "A.\n\nB. c", "wait... what? Yes!", "(He left.) She stayed.", "etc., and so on. . . .",
             "3. Oktober war es. 4. oktober", "J. S. Bach. j. bach", "x" * 5000 + ". Y", "Été. École p. 3 p. 4"]
    rows = list(enumerate(texts + [" ".join(s) for s in planted(60)]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sql_sentences(rows)
    unbroken = SE.unbroken_pairs(SE.token_counts(docs))
    for most in (1000, 0):
        got = {r.doc_id: r.sentences for r in SE.split_at(docs, unbroken, max_items=most).collect()}
        assert got == {k: None if v is None else list(v) for k, v in want.items()}
    assert got[0] == [] and got[1] is None and got[3] == ["One.", "Two."]


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert SE.learned_sentences(docs).count() == 0
    twice = spark.createDataFrame([(1, "A boat. C day."), (1, "A boat. C day.")], "doc_id long, text string")
    assert [r.sentences for r in SE.learned_sentences(twice).collect()] == [["A boat.", "C day."]] * 2
