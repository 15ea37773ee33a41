"""SimHash components, SpotSigs and sharding against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quarry.llm import sharding as R
from quarry.llm import simhash as H
from quarry.llm import spotsigs as P


def py_fingerprint(text):
    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def py_components(values, max_bits):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= max_bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_fingerprints_and_components_brute_force(edge, real, none):
    for docs in (edge, real):
        rows = docs.select("doc_id", "text").collect()
        fps = [py_fingerprint(r.text or "") for r in rows]
        group = py_components(fps, 2)
        least = {}
        for r, g in zip(rows, group):
            if r.doc_id is not None:
                least[g] = min(least.get(g, r.doc_id), r.doc_id)
        want = Counter((r.doc_id, f"{fp:016x}", least.get(g)) for r, fp, g in zip(rows, fps, group))
        got = Counter((r.doc_id, r.f, r.component_id) for r in H.components(docs).select(
            "doc_id", H.hex_digits("fp").alias("f"), "component_id").collect())
        assert got == want
        kept = H.near_dedup(docs)
        assert kept.columns == docs.columns
        assert len(kept.collect()) == len(set(group))
        assert {r.doc_id for r in kept.collect()} == {least.get(g) for g in set(group)}
    assert H.components(none).collect() == [] and H.near_dedup(none).collect() == []


def test_trie_links_find_all_components():
    r = random.Random(1)
    for bits, n, d in ((10, 200, 1), (12, 300, 2), (64, 400, 2), (64, 50, 0), (16, 400, 3)):
        seeds = [r.getrandbits(bits) for _ in range(n // 4)]
        values = sorted({s ^ (1 << r.randrange(bits)) ^ (1 << r.randrange(bits)) for s in seeds for _ in range(4)} | set(seeds))
        links = H.trie_links(np.array(values, np.uint64), d, bits)
        assert all((values[i] ^ values[j]).bit_count() <= d for i, j in links)
        group = py_components(values, d)
        assert len(links) == len(values) - len(set(group))
        root = list(range(len(values)))
        for i, j in links:
            a, b = root[i], root[j]
            root = [a if x == b else x for x in root]
        assert len(set(root)) == len(set(group))


def test_links_across_every_part(spark):
    r = random.Random(2)
    values = []
    for a in range(0, 64, 5):
        for b in range(a, 64, 7):
            x = r.getrandbits(64)
            values += [x, x ^ (1 << a) ^ (1 << b) if a != b else x ^ (1 << a)]
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    docs = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {frozenset((e.src, e.dst)) for e in H.links(docs, 2).collect()}
    assert got == {frozenset(signed[i:i + 2]) for i in range(0, len(signed), 2)}


def py_next(rows):
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    return {r[0]: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_spotsigs_brute_force(spark, real, none, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = [(r.doc_id, r.text or "") for r in real.collect()] + [(-5, ""), (100_000, "short"), (100_001, "")]
        docs = spark.createDataFrame(rows + [(None, "no id"), (None, None)], "doc_id long, text string")
        got = P.fingerprints(docs).collect()
        assert P.fingerprints(none).collect() == []
        one = P.fingerprints(docs.where("doc_id = 7")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(one) == 1 and one[0].near_next == 1.0
    assert len(got) == len(rows) + 2 and sum(r.doc_id is None for r in got) == 2
    follows, prints = py_next(rows), {}
    by_id = {r.doc_id: r for r in got}

    def jaccard(a, b):
        a, b = P.signatures(a), P.signatures(b)
        j = len(a & b) / len(a | b) if a | b else 1.0
        return j if j >= P.LEAST else 0.0

    for key, text in rows:
        r, k = by_id[key], len(text) // 2
        new = text[:len(text) - k] + follows[key][:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.near_edited == jaccard(text, new) and r.near_next == jaccard(text, follows[key])
        prints.setdefault(text, set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert len({next(iter(p)) for p in prints.values()}) == len(prints)


def test_spotsigs_repeated_ids_and_likeness(spark):
    docs = spark.createDataFrame([(1, "a"), (3, "the cat sat"), (3, "the cat sat"), (3, "the dog ran"), (2, "b")],
                                 "doc_id long, text string")
    assert Counter(r.doc_id for r in P.fingerprints(docs).collect()) == {1: 1, 2: 1, 3: 3}
    a, b = frozenset(range(100)), frozenset(range(50, 150))
    assert P.likeness(a, b, 0.0) == 1 / 3 and P.likeness(a, b, 0.5) == 0.0 and P.likeness(a, a, 0.9) == 1.0
    assert P.likeness(frozenset(), a) == 0.0 and P.likeness(frozenset(), frozenset()) == 1.0
    assert P.likeness(frozenset([1]), frozenset(range(5000)), 0.02) == 0.0


def test_spotsigs_see_the_whole_text(spark):
    words = [f"w{i}" for i in range(400)]
    bare = " ".join(words)  # no anchor
    few = "the " + bare  # one chain of three words
    for text in (bare, few):
        for at in (3, 200, 399):
            new = " ".join("other" if w == f"w{at}" else w for w in text.split())
            assert P.fingerprint(text, P.signatures(text)) != P.fingerprint(new, P.signatures(new))
            assert 0.98 < P.likeness(P.signatures(text), P.signatures(new)) < 1.0
    # anchors behind the last content word
    assert len({P.signatures(f"the cat sat{end}") for end in ("", " on", " by", " on by")}) == 4
    docs = spark.createDataFrame([(1, bare), (2, bare[:-4] + "last")], "doc_id long, text string")
    a, b = P.fingerprints(docs).collect()
    assert a.fingerprint != b.fingerprint and 0.98 < a.near_next < 1.0
    assert a.n_signatures == b.n_signatures == 400


def py_ring(rows, shards, places, n_slots):
    """One key at a time, in the order of offers: each shard takes up to its
    capacity, the rest walk on."""
    room = {s: len(rows) // shards + (s < len(rows) % shards) for s in range(shards)}
    waiting = sorted(rows)  # (arc, hash, ...)
    at = [a for a, *_ in waiting]
    home = [None] * len(waiting)
    open_ = list(range(len(waiting)))
    while open_:
        offers = {}
        nxt = []
        for i in open_:
            p = at[i]
            while room[places[p]] == 0:
                p = (p + 1) % len(places)
            offers.setdefault(places[p], []).append((i, p))
        for s, keys in offers.items():
            for n, (i, p) in enumerate(keys):
                if n < room[s]:
                    home[i] = s
                else:
                    at[i] = (p + 1) % len(places)
                    nxt.append(i)
        for s, keys in offers.items():
            room[s] -= min(room[s], len(keys))
        open_ = sorted(nxt)
    return Counter(home)


def test_sharding_law_and_slots(spark, edge, real, none):
    for docs, shards in ((edge, 4), (real, 40), (real, 7), (spark.range(5).selectExpr("id AS doc_id", "'x' AS text"), 40)):
        rows = docs.select("doc_id", "text").collect()
        got = R.shard(docs, shards, vnodes=16).collect()
        import zlib
        want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
        n = Counter(r.shard for r in got)
        counts = [n.get(s, 0) for s in range(shards)]
        assert max(counts) - min(counts) <= 1 and set(n) <= set(range(shards))
        for s in n:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
        assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert R.shard(none).collect() == []


def test_sharding_moves_little_and_reruns_agree(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a = {r.doc_id: r.shard for r in R.shard(docs, 20).collect()}
    assert a == {r.doc_id: r.shard for r in R.shard(docs.repartition(5), 20).collect()}
    b = {r.doc_id: r.shard for r in R.shard(docs, 21).collect()}
    assert sum(a[k] != b[k] for k in a) < 0.35 * len(a)


def test_bounded_loads_equal_key_by_key_walk(spark):
    r = random.Random(3)
    places = [r.randrange(5) for _ in range(30)]
    keys = [(r.randrange(30) if r.random() < 0.5 else 4, i) for i in range(203)]
    table = spark.createDataFrame([(i, s, i) for i, s in enumerate(places)], "place int, shard int, slot int")
    counts = spark.createDataFrame(list(Counter(a for a, _ in keys).items()), "arc int, n long")
    room = spark.createDataFrame([(s, 203 // 5 + (s < 203 % 5)) for s in range(5)], "shard int, room long")
    runs = R.bounded_loads(counts, table, room).collect()
    taken = Counter()
    for x in runs:
        taken[x.shard] += x.hi - x.lo
    assert taken == py_ring(keys, 5, places, 30)
    for arc, n in Counter(a for a, _ in keys).items():
        ranges = sorted((x.lo, x.hi) for x in runs if x.arc == arc)
        assert [lo for lo, _ in ranges] == [0] + [hi for _, hi in ranges][:-1] and ranges[-1][1] == n
