"""Quality rules and source mix against brute force."""

import math
import os
import re
from collections import Counter

import duckdb
import regex
from xxhash import xxh64_intdigest

from quarry.llm import mixing as M
from quarry.llm import quality_rules as Q

TOKEN = regex.compile(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]+")


def signed_mod(h, n):
    return (h - (1 << 64) if h >> 63 else h) % n


def py_buckets(text, n=Q.BUCKETS):
    t = TOKEN.findall(text)
    one = [xxh64_intdigest(x.encode(), 42) for x in t]
    two = [xxh64_intdigest(y.encode(), h) for h, y in zip(one, t[1:])]
    return [signed_mod(h, n) for h in one + two]


def py_base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def py_quality(rows, trusted):
    raw, target = Counter(), Counter()
    for key, text in rows:
        b = py_buckets(text)
        raw.update(b)
        if key is not None and key in trusted:
            target.update(b)
    n_raw, n_target = sum(raw.values()), sum(target.values())

    def weight(b):
        if not n_target:
            return 0.0
        # both multinomials over counts plus 8 corpus n-grams a bucket
        p_target = (target[b] + 8 * n_target / n_raw) / (n_target + 8 * n_target / n_raw * Q.BUCKETS)
        return math.log(p_target) - math.log((raw[b] + 8) / (n_raw + 8 * Q.BUCKETS))

    out = []
    for key, text in rows:
        b = py_buckets(text)
        out.append((key, *py_base(text), sum(map(weight, b)) / len(b) if b else 0.0))
    return out


def test_quality_rules_brute_force(spark, edge, real, real_labels, none):
    few = spark.createDataFrame([(9,), (10,), (10,), (None,)], "doc_id long")
    for docs, trusted in ((edge, few), (real, real_labels.where("quality = 1")), (edge, few.limit(0))):
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        want = py_quality(rows, {r.doc_id for r in trusted.collect()})
        order = lambda x: (x[0] is None, x[0] or 0, x[1:6])
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                       r.score, r.kept) for r in Q.quality_rules(docs, trusted).collect()), key=order)
        for g, w in zip(got, sorted(want, key=order), strict=True):
            assert g[:7] == w[:7] and abs(g[7] - w[7]) < 1e-9, (g, w)
            assert g[8] == (not w[6] and w[7] >= Q.THRESHOLD) or abs(w[7] - Q.THRESHOLD) < 1e-9
    assert Q.quality_rules(none, few).collect() == []


def test_keep_good_keeps_rows_whole(edge, real, real_labels):
    trusted = real_labels.where("quality = 1")
    kept = Counter(r.doc_id for r in Q.quality_rules(real, trusted).where("kept").collect())
    out = Q.keep_good(real, trusted)
    assert out.columns == real.columns and Counter(r.doc_id for r in out.collect()) == kept
    bad = {r.doc_id for r in real_labels.where("quality = 0").collect()}
    good = {r.doc_id for r in real_labels.where("quality = 1").collect()}
    assert len(bad & set(kept)) <= 1 and len(kept) > 100
    long_good = {r.doc_id for r in Q.quality_rules(real, trusted).where("NOT base_failed").collect()} & good
    assert long_good <= set(kept)
    assert Q.keep_good(edge, trusted).columns == edge.columns


def test_repeats_cover_every_window(spark):
    docs = spark.createDataFrame([(1, "a b c a b c"), (2, "a a a a"), (3, "a b c d"), (4, "x y z q x y z r x y z"), (5, "a a a")],
                                 "doc_id long, text string")
    got = {r.doc_id: r.n_repeat_words for r in Q.quality_rules(docs, docs.limit(0)).collect()}
    assert got == {1: 6, 2: 4, 3: 0, 4: 9, 5: 0}


def py_targets(sizes, weights, most):
    """Share by weight, stop at the caps, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > most * sizes[s]}
        if not full:
            target.update({s: level * w[s] for s in free})
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= full
    return target


def py_seats(target, n):
    seats = dict.fromkeys(target, 0)
    order = sorted(target, key=lambda s: (s is None, s or ""))
    for _ in range(n):
        s = max(order, key=lambda s: (target[s] / (2 * seats[s] + 1), -order.index(s)))
        seats[s] += 1
    return seats


def test_targets_and_seats_brute_force(spark):
    for sizes in ({"a": 1000, "b": 10, "c": 500, "d": 0, None: 30}, {"a": 5}, {"a": 0, "b": 0}, {"x": 100, "y": 1, "z": 1}):
        rows = [(s, n, 1) for s, n in sizes.items()]
        goals = M.targets(spark.createDataFrame(rows, "source string, source_size long, n_docs long"))
        got = {r.source: r.target for r in goals.collect()}
        want = py_targets(sizes, M.WEIGHTS, 3)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)
        places = {r.place: r.source for r in goals.collect()}
        seats = Counter()
        for r in M.quotas(goals, block_words=7, shards=5).collect():
            assert r.seats >= 0
            seats[places[r.place]] += r.seats
        n = round(sum(want.values()) / 7)
        assert {s: seats[s] for s in sizes} == py_seats({s: want[s] for s in sizes}, n)


def test_mix_edges(spark, edge, none):
    plan = M.plan(edge).collect()
    assert len(plan) == edge.count()
    taken, target = Counter(), {}
    for r in plan:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r["__source"]] += r.taken
        target[r["__source"]] = r.target
    assert all(abs(taken[s] - target[s]) <= 2 * M.BLOCK_WORDS for s in target)
    out = M.mix(edge)
    assert out.columns == edge.columns
    words = Counter()
    for r in out.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert n > 0 and (r.n_chars == len(r.text))
        words[r.source] += n
    assert words == Counter({s: n for s, n in taken.items() if n})
    assert M.plan(none).collect() == [] and M.mix(none).collect() == []


def test_sources_below_a_block_take_their_target(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(500)), "a", 0) for i in range(40)]
    rows += [(100 + i, " ".join("xyz"[k % 3] for k in range(i % 10 + 1)), f"tiny{i:02}", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    plan = [r for r in M.plan(docs).collect() if r["__source"] != "a"]
    assert all(r.target == 3 * r.source_size for r in plan) and min(r.target for r in plan) == 3
    small = [r for r in plan if r.target < M.BLOCK_WORDS / 2 - 4]
    assert len(small) == 36 and all(r.taken == r.target for r in small)
    assert {r.source for r in M.mix(docs).collect()} == {r[2] for r in rows}
    # several documents, and a target that is no whole multiple of them
    docs = spark.createDataFrame([(i, "one two three", "abc"[i % 3], 0) for i in range(12)], docs.schema)
    taken, target = Counter(), {}
    for r in M.plan(docs, block_words=1000).collect():
        taken[r["__source"]] += r.taken
        target[r["__source"]] = r.target
    assert taken == {"a": 6, "b": 12, "c": 18} == target


def test_mix_keeps_the_other_columns_of_equal_keys(spark):
    text = "one two three four five"
    rows = [(1, text, "a", lang, len(text), at) for lang, at in (
        ("en", "2026-01-01 00:00:00.000001"), ("de", None), (None, None), ("en", "2026-01-01 00:00:00.000002"),
        ("en", "2026-01-01 00:00:00.000002"))] + [(2, "x " * 500, "b", "fr", 1000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, at string")
    docs = docs.withColumn("at", docs["at"].cast("timestamp"))
    got = Counter(r for r in M.mix(docs, block_words=25).collect() if r.doc_id == 1)
    # the small source stops at three times its rows
    assert got == Counter({r: 3 * n for r, n in Counter(r for r in docs.collect() if r.doc_id == 1).items()})
    assert sorted(got.values()) == [3, 3, 3, 6]


def test_mix_equals_sql_and_reruns(real):
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(map(tuple, M.plan(real).select(*cols).collect()))
    assert got == sorted(map(tuple, M.plan(real.repartition(5)).select(*cols).collect()))
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    assert got == sorted(con.execute(M.sql()).fetchall())
    assert os.path.exists("/root/testdata/sf0.001")
