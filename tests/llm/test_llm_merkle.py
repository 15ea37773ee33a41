"""Merkle manifest: layout arithmetic, and every proof against a plain tree."""

import hashlib
import zlib

import duckdb
import pytest

from quarry.llm import merkle as M
from quarry.llm.queries import QUERIES


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for c in M.FIELDS:
        v = row[c]
        v = v if v is None else str(v)
        v = v.translate(low) if lower and c == "text" and v is not None else v
        out.append("-" if v is None else f"{len(v.encode())}:{v}")
    return H(out)


def levels_over(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        at = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = (at, levels_over([leaf(r) for r in at]))
    top = levels_over([trees[g][1][-1][0] for g in order])
    root = top[-1][0] if order else None
    out = []
    for t, g in enumerate(order):
        for i, r in enumerate(trees[g][0]):
            wild = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            cur, proof = leaf(r, wild), []
            for levels, k in ((trees[g][1], i), (top, t)):
                for nodes in levels[:-1]:
                    first = k & -8
                    run = nodes[first:first + 8]
                    proof += [x for j, x in enumerate(run) if first + j != k]
                    cur = H(run[:k - first] + [cur] + run[k - first + 1:])
                    k >>= 3
            out.append((r["doc_id"], leaf(r), trees[g][1][-1][0], root, H(proof), cur, cur == root))
    return out


def key(row):
    return tuple((x is not None, x or 0) if i == 0 else x for i, x in enumerate(row))


def test_addresses_fill_the_tree_and_keep_subtrees_together():
    for levels in range(1, 6):
        seen = [M.address(levels, d, i) for d in range(levels) for i in range(8 ** d)]
        assert sorted(seen) == list(range(M.nodes_in(levels)))
    # a subtree below the split is one contiguous stretch
    levels, top = 5, 2
    for j in (0, 5, 63):
        own = [M.address(levels, top + d, (j << 3 * d) + i) for d in range(3) for i in range(8 ** d)]
        assert max(own) - min(own) + 1 == len(own) == M.nodes_in(3)
    assert M.bands(7) == [4, 3] and M.bands(13) == [4, 3, 3, 3] and sum(M.bands(20)) == 20


def test_layout_holds_the_plain_tree():
    bottom = [hashlib.sha256(bytes([i % 251, i // 251])).digest() for i in range(600)]
    out = bytearray(M.nodes_in(5) * M.WIDTH)
    root = M.lay_out(5, bottom, out)
    plain = levels_over([b.hex() for b in bottom])
    assert len(plain) == 5
    assert root.hex() == plain[-1][0]
    for depth, nodes in enumerate(reversed(plain)):
        for i, x in enumerate(nodes):
            at = M.address(5, depth, i) * M.WIDTH
            assert out[at:at + M.WIDTH].hex() == x


@pytest.mark.parametrize("block_levels", [1, 2, 5])
def test_every_proof_of_real_documents(spark, real, block_levels, monkeypatch):
    monkeypatch.setattr(M.bands, "__defaults__", (block_levels,))
    got = [tuple(r) for r in M.proofs(real).collect()]
    assert sorted(got) == sorted(brute([r.asDict() for r in real.collect()]))
    assert {r[6] for r in got} == {True, False}


def test_edges(spark, edge, none):
    assert M.proofs(none).collect() == []
    rows = [r.asDict() for r in edge.collect()]
    got = [tuple(r) for r in M.proofs(edge).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    one = edge.where("doc_id = 6")
    r = M.proofs(one).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == H([])
    many = edge.select("doc_id", "text", "source", "n_chars", edge["text"].substr(1, 1).alias("lang"))  # more than eight groups
    assert sorted((tuple(r) for r in M.proofs(many).collect()), key=key) == sorted(
        brute([r.asDict() for r in many.collect()]), key=key)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(M.sql()).fetchall()
    assert sorted(map(tuple, QUERIES["op11_merkle"](spark, sf).collect())) == sorted(want)
