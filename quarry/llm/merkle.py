"""Merkle dataset manifest in van Emde Boas layout.

*Leaves.*  A row's leaf is the SHA-256 of its named fields, each ``-`` if null,
else its UTF-8 byte count, a colon and its value.  The leaves of a group
(``group_col``) in order of id, ties by leaf, are the bottom level of an 8-ary
tree: every eight consecutive nodes, the last run may hold fewer, become the
hash of their hex digests.  The groups' roots in order of group, null first,
are the leaves of one tree more, whose root stands for the dataset.

*Layout.*  A tree of L levels is stored as its top ``L // 2`` levels, then each
of the subtrees below them, every part split again at half height: the van
Emde Boas order, in which any path crosses few contiguous stretches whatever
the size of a page.  ``address`` finds a node's place by arithmetic alone.
Splitting stops to be one table row where a subtree has at most
``BLOCK_LEVELS`` levels: such an aligned subtree is a *block*, its nodes in the
same order inside one binary value.

*Construction* goes band by band from below: a task gets the nodes under one
block (at most ``8^BLOCK_LEVELS``), builds the block by recursing over the
roots of its own subtrees, and the block roots are the next band's input.  A
band has a 512th to a 32,768th of the rows of the one below, so three or four
rounds serve any table, and no task sees more than one block.

*Retrieval* goes band by band from above: a block with the path of its own
root gives every node under it its path, read from the block by address.

Defined results: null ids come first and are never tampered with; rows with
equal ids are ordered by leaf, fully equal rows stand side by side; null and
empty values differ in a leaf; a group of one row has its leaf as root; a
single group's root is the dataset's; an empty table has no root and gives no
rows; columns that are not fields are not read.  Ids of any type that sorts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lower_ascii
from quarry.operators.records import dense_index
from quarry.session import reliable_checkpoint

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BITS = 3  # eight children
FAN = 1 << BITS
BLOCK_LEVELS = 5
MAX_HEIGHT = 20
WIDTH = 32  # bytes of a digest


# -- address arithmetic ------------------------------------------------------

def nodes_in(levels: int) -> int:
    """Nodes of a complete subtree."""
    return ((1 << BITS * levels) - 1) // (FAN - 1)


def address(levels: int, depth: int, index: int) -> int:
    """Place of node ``index`` of level ``depth`` (the root's is 0) in the van
    Emde Boas order of a complete tree of ``levels`` levels."""
    place = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        under = BITS * (depth - top)
        place += nodes_in(top) + (index >> under) * nodes_in(levels - top)
        index &= (1 << under) - 1
        depth, levels = depth - top, levels - top
    return place


def bands(levels: int, most: int = BLOCK_LEVELS) -> list[int]:
    """Levels of the bands of blocks, from the bottom up."""
    if levels <= most:
        return [levels]
    top = levels // 2
    return bands(levels - top, most) + bands(top, most)


def combined(digests: Sequence[bytes]) -> bytes:
    return hashlib.sha256("".join([d.hex() for d in digests]).encode()).digest()


def parents(nodes: Sequence[bytes]) -> list[bytes]:
    return [combined(nodes[i:i + FAN]) for i in range(0, len(nodes), FAN)]


def lay_out(levels: int, bottom: Sequence[bytes], out: bytearray, base: int = 0) -> bytes:
    """Write the subtree over its bottom nodes into ``out`` from place ``base``;
    returns its root.  Its lower subtrees come first, the top one is built
    over their roots."""
    if levels == 1:
        out[base * WIDTH:(base + 1) * WIDTH] = bottom[0]
        return bottom[0]
    top, low = levels // 2, levels - levels // 2
    width, at = 1 << BITS * (low - 1), base + nodes_in(top)
    roots = [lay_out(low, bottom[k:k + width], out, at + j * nodes_in(low))
             for j, k in enumerate(range(0, len(bottom), width))]
    return lay_out(top, parents(roots), out, base)


# -- paths -------------------------------------------------------------------
# A path is one binary value: for each level from below the place in the run,
# the number of siblings and their digests.

def step(index: int, count: int, node) -> bytes:
    """One level of a path: ``node(i)`` is the digest of node ``i`` of the
    level's ``count`` nodes."""
    first = index & -FAN
    others = [node(i) for i in range(first, min(first + FAN, count)) if i != index]
    return bytes((index - first, len(others))) + b"".join(others)


def block_path(nodes: bytes, levels: int, block: int, rounds: int, n: int, index: int) -> bytes:
    """The path from node ``index`` of the block's bottom level up to the
    block's root, which is left out.  ``rounds`` hashing rounds lie below that
    level, in a tree of ``n`` leaves."""
    out = []
    for depth in range(levels - 1, 0, -1):
        first = block << BITS * depth
        count = -(-n >> BITS * rounds)

        def node(i: int) -> bytes:
            at = address(levels, depth, i - first) * WIDTH
            return nodes[at:at + WIDTH]

        out.append(step(index, count, node))
        index >>= BITS
        rounds += 1
    return b"".join(out)


def read_path(path: bytes):
    """(place in the run, siblings) for each level."""
    at = 0
    while at < len(path):
        place, k = path[at], path[at + 1]
        yield place, [path[at + 2 + WIDTH * j:at + 2 + WIDTH * (j + 1)] for j in range(k)]
        at += 2 + WIDTH * k


def proof_digest(path: bytes) -> str:
    return hashlib.sha256("".join([d.hex() for _, run in read_path(path) for d in run]).encode()).hexdigest()


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that ``leaf`` and the siblings of ``path`` lead to."""
    for place, run in read_path(path):
        leaf = combined([*run[:place], leaf, *run[place:]])
    return leaf


# -- Spark -------------------------------------------------------------------

def leaf_digest(fields: dict[str, Column]) -> Column:
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[part(c) for c in fields.values()]), 256))


def _height(n: Column) -> Column:
    """Hashing rounds over ``n`` leaves."""
    powers = F.array(*[F.lit(1 << BITS * k).cast("long") for k in range(MAX_HEIGHT)])
    return F.size(F.filter(powers, lambda p: p < n))


def _bands(n: Column) -> Column:
    every = F.array(*[F.array(*[F.lit(x) for x in bands(h + 1)]) for h in range(MAX_HEIGHT + 1)])
    return F.get(every, _height(n))


def _under(index: Column, levels: Column, low: bool) -> Column:
    """The block over a node that enters it: a bottom node of the lowest band,
    a block root of any other."""
    return F.call_function("shiftright", index, BITS * (levels - (1 if low else 0)))


@dataclass
class Forest:
    """Trees by number.  ``blocks[k]``: rows (tree, n, rounds, levels, block,
    root, nodes) of band k, the lowest first."""

    blocks: list[DataFrame]
    roots: DataFrame  # (tree, n, root)


BLOCK_SCHEMA = "tree long, n long, rounds int, levels int, block long, root binary, nodes binary"


def _block(low: bool):
    def build(rows: pa.Table) -> pa.Table:
        one = {c: rows.column(c)[0].as_py() for c in ("tree", "n", "rounds", "levels", "block")}
        order = rows.column("idx").to_pylist()
        digests = rows.column("digest").to_pylist()
        level = [digests[i] for i in sorted(range(len(order)), key=order.__getitem__)]
        out = bytearray(nodes_in(one["levels"]) * WIDTH)
        root = lay_out(one["levels"], level if low else parents(level), out)
        return pa.table({"tree": pa.array([one["tree"]], pa.int64()), "n": pa.array([one["n"]], pa.int64()),
                         "rounds": pa.array([one["rounds"]], pa.int32()),
                         "levels": pa.array([one["levels"]], pa.int32()),
                         "block": pa.array([one["block"]], pa.int64()), "root": [root], "nodes": [bytes(out)]})

    return build


def grow(nodes: DataFrame) -> Forest | None:
    """The trees over ``nodes`` (tree, n, idx, digest), where ``idx`` counts the
    ``n`` leaves of a tree from 0; None without nodes."""
    depth = nodes.agg(F.max(F.size(_bands(F.col("n"))))).first()[0]
    if depth is None:
        return None
    done, made, rounds = [], [], F.lit(0)
    for k in range(depth):
        levels = F.get(_bands(F.col("n")), F.lit(k))
        rows = nodes.where(levels.isNotNull()).select(
            "tree", "n", "idx", "digest", rounds.cast("int").alias("rounds"), levels.alias("levels"),
            _under(F.col("idx"), levels, k == 0).alias("block"))
        blocks = reliable_checkpoint(rows.groupBy("tree", "block").applyInArrow(_block(k == 0), BLOCK_SCHEMA))
        made.append(blocks)
        done.append(blocks.where(F.size(_bands(F.col("n"))) == k + 1).select("tree", "n", "root"))
        # the next band's bottom nodes are the parents of these roots
        rounds = F.col("rounds")
        nodes = blocks.select("tree", "n", F.col("block").alias("idx"), F.col("root").alias("digest"),
                              (F.col("rounds") + F.col("levels")).alias("rounds"))
    roots = done[0]
    for more in done[1:]:
        roots = roots.unionByName(more)
    return Forest(made, roots)


def _child_paths(children: pa.Table, blocks: pa.Table) -> pa.Table:
    """Paths of the block roots under one block."""
    tree, idx, path = [], [], []
    if blocks.num_rows and children.num_rows:
        b = blocks.to_pylist()[0]
        under = dict(zip(children.column("idx").to_pylist(), children.column("root").to_pylist()))
        count = -(-b["n"] >> BITS * (b["rounds"] - 1))
        above: dict[int, bytes] = {}
        for i in under:
            if i >> BITS not in above:
                above[i >> BITS] = block_path(b["nodes"], b["levels"], b["block"], b["rounds"], b["n"], i >> BITS)
            tree.append(b["tree"])
            idx.append(i)
            path.append(step(i, count, under.__getitem__) + above[i >> BITS] + b["path"])
    return pa.table({"tree": pa.array(tree, pa.int64()), "block": pa.array(idx, pa.int64()),
                     "path": pa.array(path, pa.binary())})


def lowest_blocks(forest: Forest, root_paths: DataFrame) -> DataFrame:
    """The lowest band's blocks with ``path``, the path of the block's root,
    that of the tree's root (``root_paths``: tree, path) included."""
    held = None
    for k in range(len(forest.blocks) - 1, -1, -1):
        blocks = forest.blocks[k]
        own = blocks.where(F.size(_bands(F.col("n"))) == k + 1).join(root_paths, "tree")
        if held is not None:
            own = own.unionByName(blocks.join(held, ["tree", "block"]))
        if k == 0:
            return own
        children = forest.blocks[k - 1].join(blocks.select("tree", F.col("levels").alias("__l")).distinct(), "tree").select(
            "tree", F.col("block").alias("idx"), "root", _under(F.col("block"), F.col("__l"), False).alias("block"))
        held = reliable_checkpoint(
            children.groupBy("tree", "block").cogroup(own.groupBy("tree", "block"))
            .applyInArrow(_child_paths, "tree long, block long, path binary"))
    return held


@dataclass
class Manifest:
    """``leaves``: tree, idx, n, key, digest, now (the leaf to verify);
    ``groups``: tree, group, n; ``trees`` over the leaves, ``top`` over the
    groups' roots, and ``root``, the dataset's."""

    leaves: DataFrame
    groups: DataFrame
    trees: Forest
    top: Forest
    root: bytes


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, now: Column | None = None, id_col: str = "doc_id",
             group_col: str = "lang") -> Manifest | None:
    """The manifest of ``docs``; None of an empty table.  ``now`` is the leaf
    that is verified against it, the original by default."""
    own = leaf_digest({c: F.col(c) for c in fields})
    rows = docs.select(F.col(id_col).alias("key"), F.col(group_col).alias("group"), own.alias("digest"),
                       (own if now is None else now).alias("now"))
    placed = reliable_checkpoint(dense_index(rows, ["group", "key", "digest"], "at"))
    sizes = placed.groupBy("group").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = reliable_checkpoint(dense_index(sizes, "first", "tree"))
    leaves = (placed.join(groups.withColumnRenamed("group", "__g"), F.col("group").eqNullSafe(F.col("__g")))
              .select("tree", "n", (F.col("at") - F.col("first")).alias("idx"), "key", "digest", "now"))
    trees = grow(leaves.select("tree", "n", "idx", "digest"))
    if trees is None:
        return None
    total = trees.roots.agg(F.count(F.lit(1))).first()[0]
    top = grow(trees.roots.select(F.lit(0).cast("long").alias("tree"), F.lit(total).cast("long").alias("n"),
                                  F.col("tree").alias("idx"), F.col("root").alias("digest")))
    return Manifest(leaves, groups.select("tree", "group", "n"), trees, top, bytes(top.roots.first()["root"]))


def _subroot_paths(children: pa.Table, blocks: pa.Table) -> pa.Table:
    """Paths of the leaves of one lowest block, by tree."""
    tree, path = [], []
    if blocks.num_rows:
        b = blocks.to_pylist()[0]
        for i in children.column("idx").to_pylist():
            tree.append(i)
            path.append(block_path(b["nodes"], b["levels"], b["block"], 0, b["n"], i) + b["path"])
    return pa.table({"tree": pa.array(tree, pa.int64()), "path": pa.array(path, pa.binary())})


def _verify(root: bytes):
    def verify(leaves: pa.Table, blocks: pa.Table) -> pa.Table:
        b = blocks.to_pylist()[0]
        out = []
        for i, now in zip(leaves.column("idx").to_pylist(), leaves.column("now").to_pylist()):
            path = block_path(b["nodes"], b["levels"], b["block"], 0, b["n"], i) + b["path"]
            folded = fold(now, path)
            out.append((proof_digest(path), folded.hex(), folded == root))
        proof, folded, same = zip(*out)
        k = len(out)
        return pa.table({
            "key": leaves.column("key"), "leaf": [d.hex() for d in leaves.column("digest").to_pylist()],
            "subroot": [b["subroot"].hex()] * k, "root": [root.hex()] * k, "proof_sha256": proof,
            "folded_root": folded, "verified": same, "tree": leaves.column("tree"), "place": leaves.column("idx")})

    return verify


def verified(m: Manifest) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified, tree,
    place: every leaf's proof, and the root that its ``now`` leads to."""
    nothing = m.top.roots.select("tree", F.lit(b"").alias("path"))
    top = lowest_blocks(m.top, nothing)
    subroots = m.trees.roots.select(F.lit(0).cast("long").alias("t"), F.col("tree").alias("idx"))
    subroots = subroots.join(m.top.blocks[0].select("tree", "levels").distinct(), F.col("t") == F.col("tree")).select(
        F.col("t").alias("tree"), "idx", _under(F.col("idx"), F.col("levels"), True).alias("block"))
    root_paths = reliable_checkpoint(
        subroots.groupBy("tree", "block").cogroup(top.groupBy("tree", "block"))
        .applyInArrow(_subroot_paths, "tree long, path binary"))
    low = lowest_blocks(m.trees, root_paths).join(
        m.trees.roots.select("tree", F.col("root").alias("subroot")), "tree")
    levels = F.get(_bands(F.col("n")), F.lit(0))
    leaves = m.leaves.withColumn("block", _under(F.col("idx"), levels, True))
    kind = m.leaves.schema["key"].dataType.simpleString()
    return leaves.groupBy("tree", "block").cogroup(low.groupBy("tree", "block")).applyInArrow(
        _verify(m.root), f"key {kind}, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean, tree long, place long")


def tampered(id_col: str = "doc_id", text_col: str = "text", every: int = 3) -> Column:
    """True where ``every`` divides the CRC-32 of the decimal id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % every == 0, F.lit(False)) & F.col(text_col).isNotNull()


def proofs(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
           text_col: str = "text") -> DataFrame:
    """``id_col``, leaf, subroot, root, proof_sha256, folded_root, verified per
    row, after a third of the texts were lower-cased behind the manifest's back."""
    changed = {c: lower_ascii(F.col(c)) if c == text_col else F.col(c) for c in fields}
    now = F.when(tampered(id_col, text_col), leaf_digest(changed)).otherwise(leaf_digest({c: F.col(c) for c in fields}))
    m = manifest(docs, fields, now, id_col, group_col)
    if m is None:
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"`{id_col}` {kind}, leaf string, subroot string, root string, proof_sha256 string, "
            "folded_root string, verified boolean")
    return verified(m).select(F.col("key").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                              "verified")


def sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def leaf(text: str) -> str:
        parts = [f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in FIELDS]
        return "sha256(" + " || ".join(
            f"coalesce(CAST(octet_length(encode({p})) AS VARCHAR) || ':' || {p}, '-')" for p in parts) + ")"

    def level(name: str, keys: str, start: str) -> str:
        cols = f"{keys}, " if keys else ""
        return (f"{name} AS ({start} UNION ALL SELECT {cols}r + 1, i // 8, (max(n) + 7) // 8, "
                f"sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY {cols}r, i // 8)")

    crc = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda c: CAST(ascii(c) AS BIGINT))), lambda s, b: list_reduce(list_prepend(xor(s, b), "
           "[CAST(x AS BIGINT) FOR x IN range(8)]), lambda u, _: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295)")
    run = ("coalesce(string_agg({t}.h, '' ORDER BY {t}.i) FILTER ({t}.i < {own}), '') AS before, "
           "coalesce(string_agg({t}.h, '' ORDER BY {t}.i) FILTER ({t}.i > {own}), '') AS after")
    return f"""WITH RECURSIVE d AS (SELECT doc_id, lang, {leaf("text")} AS leaf,
  CASE WHEN {crc} % 3 = 0 THEN {leaf(f"translate(text, '{upper}', '{lower}')")} ELSE {leaf("text")} END AS now FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY lang) AS n FROM d),
{level("lv(lang, r, i, n, h)", "lang", "SELECT lang, 0, i, n, leaf FROM x").replace("FROM lv(lang, r, i, n, h)", "FROM lv")},
subs AS (SELECT lang, r AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t,
  count(*) OVER () AS groups FROM lv WHERE n = 1),
{level("top(r, i, n, h)", "", "SELECT 0, t, groups, subroot FROM subs").replace("FROM top(r, i, n, h)", "FROM top")},
sib AS (SELECT x.lang, x.i, lv.r AS k, {run.format(t="lv", own="(x.i >> (3 * lv.r))")}
  FROM x JOIN lv ON x.lang IS NOT DISTINCT FROM lv.lang AND lv.n > 1 AND lv.i // 8 = x.i >> (3 * lv.r + 3)
  GROUP BY x.lang, x.i, lv.r
  UNION ALL SELECT x.lang, x.i, s.height + top.r, {run.format(t="top", own="(s.t >> (3 * top.r))")}
  FROM x JOIN subs s ON x.lang IS NOT DISTINCT FROM s.lang JOIN top ON top.n > 1 AND top.i // 8 = s.t >> (3 * top.r + 3)
  GROUP BY x.lang, x.i, s.height, top.r),
proof AS (SELECT lang, i, sha256(string_agg(before || after, '' ORDER BY k)) AS p, count(*) AS steps FROM sib GROUP BY lang, i),
f(lang, i, k, cur) AS (SELECT lang, i, 0, now FROM x
  UNION ALL SELECT f.lang, f.i, f.k + 1, sha256(before || cur || after) FROM f JOIN sib
  ON f.lang IS NOT DISTINCT FROM sib.lang AND f.i = sib.i AND f.k = sib.k),
ends AS (SELECT lang, i, arg_max(cur, k) AS folded FROM f GROUP BY lang, i),
root AS (SELECT h FROM top WHERE n = 1)
SELECT x.doc_id, x.leaf, s.subroot, root.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, e.folded AS folded_root,
  e.folded = root.h AS verified
FROM x JOIN subs s ON x.lang IS NOT DISTINCT FROM s.lang JOIN ends e ON x.lang IS NOT DISTINCT FROM e.lang AND x.i = e.i
LEFT JOIN proof p ON x.lang IS NOT DISTINCT FROM p.lang AND x.i = p.i, root"""
