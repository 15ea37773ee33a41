"""Decontamination against every window at every place."""

import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontaminate as D
from quarry.llm import wordhash
from quarry.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def brute(docs, items, size=10, k=5, share=1.0):
    windows = set()
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        windows |= {(item, tuple(w[i:i + n])) for i in range(len(w) - n + 1) if n}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, of = set(), set()
        for item, x in windows:
            n, kk = len(x), min(k, len(x))
            for b in range(len(w) - n + 1):
                same = sum(w[b + i:b + i + kk] == list(x[i:i + kk]) for i in range(n - kk + 1))
                if same >= share * (n - kk + 1) - 1e-9:
                    hit |= set(range(b, b + n))
                    of |= {item} - {None}
        listed = ",".join(sorted(map(str, of)))
        out.append((doc, len(w), len(hit), len(of), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))


VOCAB = "alpha beta gamma delta Über naïve 12 x".split()


def planted(seed):
    r = np.random.default_rng(seed)

    def prose(n):
        return " ".join(r.choice(VOCAB, n))

    items = [(1, prose(30)), (2, prose(10)), (3, prose(4)), (4, "lonely"), (5, prose(12)), (5, prose(15)), (None, prose(11)),
             (7, ""), (8, None), (9, "... !"), (10, prose(30))]
    docs = [(i, prose(int(n))) for i, n in enumerate(r.integers(0, 120, 12))]
    for j, (_, text) in enumerate(items):
        text = text or ""
        docs.append((100 + j, prose(20) + " " + text.upper().replace("Ü", "Ü").replace(" ", " -- ") + " " + prose(5)))
        docs.append((200 + j, text + "," + text))
        half = text.split()
        half[len(half) // 2:len(half) // 2 + 1] = ["changed"]
        docs.append((300 + j, " ".join(half)))
    docs += [(None, items[0][1]), (400, None), (401, ""), (401, items[4][1]), (401, items[4][1])]
    return docs, items


@pytest.mark.parametrize("size,k,share", [(10, 5, 1.0), (10, 5, 0.6), (12, 3, 0.8), (6, 6, 1.0), (1, 1, 1.0)])
def test_equals_every_window_at_every_place(spark, size, k, share):
    docs, items = planted(size)
    got = D.contamination(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                          spark.createDataFrame(items, "item_id long, text string"),
                          window_words=size, shingle_words=k, containment=share).collect()
    want = brute(docs, items, size, k, share)
    assert order(map(tuple, got)) == order(want)
    assert any(r[5] for r in want) and (size == 1 or not all(r[5] for r in want))


def test_long_texts_and_many_places(spark, monkeypatch):
    text = "a b c d e f g h i j k " * 3000
    docs = spark.createDataFrame([(1, text), (2, text), (3, "x" * 400_000)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "A b c d e f g h i j k a b")], "item_id long, text string")
    monkeypatch.setattr(D, "ROW_PLACES", 100)
    got = sorted(map(tuple, D.contamination(docs, items).collect()))
    assert [(r[0], r[1], r[3]) for r in got] == [(1, 33_000, 1), (2, 33_000, 1), (3, 1, 0)]
    assert got[0][2] == got[1][2] == brute([(1, "a b c d e f g h i j k " * 3)], [(7, "A b c d e f g h i j k a b")])[0][2] + 2997 * 11


def test_edges_and_clean(spark, edge, none, real):
    items = spark.createDataFrame([(1, edge.where("doc_id = 7").first().text), (2, "x")], "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    got = D.contamination(edge, items).collect()
    assert order(map(tuple, got)) == order(brute(rows, [tuple(r) for r in items.collect()]))
    kept = D.clean(edge.withColumn("a.b", edge["doc_id"]), items)
    assert kept.columns == [*edge.columns, "a.b"]
    bad = {r.doc_id for r in got if r.contaminated}
    assert len(kept.collect()) == sum(not r.contaminated for r in got) and not bad & {r.doc_id for r in kept.collect()} - {None}
    assert D.contamination(none, items).collect() == []
    assert not any(r.contaminated for r in D.contamination(edge, items.limit(0)).collect())


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(D.sql()).fetchall()
    assert sorted(map(tuple, QUERIES["op12_decontaminate"](spark, sf).collect())) == sorted(want)
    assert sum(r[5] for r in want) > 5


def test_words_and_shingles_of_batches():
    texts = ["", "Ab--c D", "ab", "ß9 z" * 50, "\x7f", "a" * 70_000, "b c d e"]
    arr = pa.array(["skipped", *texts]).slice(1)
    for most in (1, 50, 1 << 20):
        seen = {}
        for lo, hi, w in wordhash.pieces(arr, most):
            h = w.hashes()
            for r in range(lo, hi):
                first, last = w.first[r - lo], w.first[r - lo + 1]
                assert w.text(first, last) == " ".join(words(texts[r]))
                for x, y in zip(words(texts[r]), h[first:last].tolist()):
                    assert seen.setdefault(x, y) == y
            at, s = w.shingles(h, 2)
            assert len(at) == sum(max(0, len(words(texts[r])) - 1) for r in range(lo, hi))
        assert len(set(seen.values())) == len(seen)
