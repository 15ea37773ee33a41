"""Held-out accuracy of the classifier; the pipeline stage by stage."""

import math
import os
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import xxhash
import zstandard

import corpus_pipeline
from quarry.llm import mixing, quality_classifier, quality_rules, secret_scan, simhash

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(g.held_out for g, _ in held) and all(0 <= g.score <= 1 for g in got.values())
    assert all(g.predicted == (g.score >= 0.3) for g in got.values())
    assert sum(g.predicted == q for g, q in held) / len(held) > 0.93
    good, bad = [g.score for g, q in held if q], [g.score for g, q in held if not q]
    assert np.mean([x > y for x in good for y in bad]) > 0.93


def spark_hash(*values):
    """Spark's xxhash64 of strings and longs, from left to right."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else int(v).to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - 2**64 if seed >= 2**63 else seed


def plain_scores(texts, quality):
    """Dictionaries, sizes, fit and scores of all texts, one after another."""
    train = {i: q for i, q in quality.items() if zlib.crc32(str(i).encode()) % 5}
    per = {y: sorted((spark_hash(i), i) for i, q in train.items() if q == y)[:2 * 1500] for y in (0, 1)}
    halves = {(y, h): [] for y in (0, 1) for h in (0, 1)}
    for y in (0, 1):
        for i in sorted((i for _, i in per[y]), key=str):
            raw = (texts.get(i) or "").encode()
            if 0 < len(raw) <= 32768:
                halves[y, spark_hash("half", i) % 2].append(raw)

    def parts(raw):
        return [raw[k:k + 512] for k in range(0, len(raw), 512)]

    def dictionary(y):
        pieces = [c for t in halves[y, 1] for c in parts(t)]
        return zstandard.ZstdCompressionDict(zstandard.train_dictionary(112640, pieces).as_bytes())

    packers = [zstandard.ZstdCompressor(level=3, dict_data=dictionary(y), write_content_size=False, write_checksum=False)
               for y in (0, 1)]

    def feature(raw):
        bad, good = (sum(len(p.compress(c)) for c in parts(raw)) for p in packers)
        return (bad - good) / max(good, bad, 1)

    share = [sum(q == y for q in train.values()) for y in (0, 1)]
    rows = [(feature(t), y, share[y] * sum(len(halves[k, 0]) for k in (0, 1)) / sum(share) / len(halves[y, 0]))
            for y in (0, 1) for t in halves[y, 0]]
    a = b = 0.0
    for _ in range(200):  # Newton's method on two numbers
        ga, gb, haa, hab, hbb = -1e-3 * a, -1e-3 * b, 1e-3, 0.0, 1e-3
        for x, y, w in rows:
            p = 1 / (1 + math.exp(-(a * x + b)))
            ga, gb = ga + w * (y - p) * x, gb + w * (y - p)
            v = w * p * (1 - p)
            haa, hab, hbb = haa + v * x * x, hab + v * x, hbb + v
        det = haa * hbb - hab * hab
        da, db = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det
        a, b = a + max(-20, min(20, da)), b + max(-20, min(20, db))
    return {i: 1 / (1 + math.exp(-(a * feature((t or "").encode()) + b))) for i, t in texts.items()}


def test_scores_equal_a_plain_recomputation(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = plain_scores({r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.collect()})
    got = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_held_out_labels_change_nothing(spark, real, real_labels):
    from pyspark.sql import functions as F

    flipped = real_labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a = sorted(map(tuple, quality_classifier.classify(real, real_labels).collect()))
    assert a == sorted(map(tuple, quality_classifier.classify(real, flipped).collect()))


def test_classifier_edges(spark, edge, none, real_labels):
    empty = real_labels.limit(0)
    assert quality_classifier.classify(none, empty).collect() == []
    got = quality_classifier.classify(edge, empty).collect()
    assert len(got) == edge.count() and {r.score for r in got} == {0.5}
    one_class = spark.createDataFrame([(8, 1), (9, 1), (None, 0), (10, None)], "doc_id long, quality int")
    assert len({r.score for r in quality_classifier.classify(edge, one_class).collect()}) == 1
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in edge.collect())


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_near_dedup", "secret_scan", "source_mix", "sentencepiece"]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    assert all(t.columns == docs.columns for t in tables[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = [Counter(r.doc_id for r in t.select("doc_id").collect()) for t in tables]
    judged = quality_rules.quality_rules(docs, labels.where("quality = 1"))
    assert ids[1] == Counter(r.doc_id for r in judged.where("kept").collect())
    assert set(ids[2]) == {r.component_id for r in simhash.components(tables[1]).collect()} and max(ids[2].values()) == 1
    assert ids[3] == ids[2]
    left = secret_scan.secret_scan(tables[3]).collect()
    assert all(r.n_assign == r.n_access == r.n_hex == r.n_entropy == 0 for r in left)
    goals, taken = {}, Counter()
    for r in mixing.plan(tables[3]).collect():
        goals[r["__source"]] = r.target
    for r in tables[4].selectExpr("source", "size(regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)) AS n").collect():
        taken[r.source] += r.n
    assert all(abs(taken[s] - goals[s]) <= 2 * mixing.BLOCK_WORDS for s in goals)
    assert ids[5] == ids[4] and all(r.round_trip for r in tables[5].select("round_trip").collect())
    assert corpus_pipeline.run(spark, SF).count() == sum(ids[5].values())


def test_pipeline_of_no_rows(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []


def test_entry_without_llm(tmp_path):
    """The entry point imports where llm and the pipeline are not there."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = ("import sys\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith('quarry.llm') or name == 'corpus_pipeline':\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            f"sys.path.insert(0, {root!r})\n"
            "import __spark_entry__ as e\n"
            "assert not [n for n in e.queries() if n.startswith('op') and n[2].isdigit() or n == 'pipeline']\n"
            "print(len(e.queries()))\n")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path)
    assert out.returncode == 0 and int(out.stdout.strip().splitlines()[-1]) > 50, out.stderr[-800:]
