"""SimHash near-duplicates by a binary-trie self-join.

*Fingerprints.*  A text's words (ASCII white space cuts them, A-Z are
lower-cased) give all shingles of ``shingle_words`` words, repeats included;
each shingle's XXH64 (UTF-8, seed 42) votes, and a fingerprint bit is 1 if
over half of the hashes set it.  Fewer words: the whole sequence is the one
shingle; no words: the fingerprint is zero.

*Trie self-join.*  The different fingerprints form a binary trie; walking it
against itself in pairs of nodes, the differing bits of two paths add up and
a pair is dropped when they exceed the budget ``max_bits``.  To spread the
walk, the 64 bits are cut into ``PARTS`` parts; two fingerprints within the
budget agree on at least ``PARTS - max_bits`` whole parts.  For every choice
of that many parts the trie is read with those parts first: pairs that agree
there are one subtree, and all pairs that could spend budget in that prefix
are found under another choice.  A subtree is walked in one task.  It holds
different fingerprints that agree on all but ``8 * max_bits`` bits, so never
more than 2^16 for a budget of 2, whatever the number of documents.

A subtree returns links that span its components (not all its pairs), and
the components of all links come from large-star/small-star.  Exact copies
share a fingerprint and are one node, so a group of copies costs one row.

Defined results: null text is the empty text; fingerprints of empty texts
are zero and link like any other; a null id gets its component's smallest id
(null only if no member has an id); repeated rows each give a row; an empty
table gives none; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import whole_text
from quarry.operators.components import star_forest
from quarry.session import reliable_checkpoint

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
PARTS = 8  # of 8 bits each
BITS_AT_ONCE = 65_536  # shingles whose bits are unpacked at once


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit fingerprint of one text (UTF-8)."""
    from xxhash import xxh64_intdigest

    w = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not w:
        return 0
    n = max(1, len(w) - shingle_words + 1)
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = (ends[shingle_words - 1:] if len(w) >= shingle_words else ends[-1:]).tolist()
    h = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)
    votes = np.zeros(64, np.int64)
    for i in range(0, n, BITS_AT_ONCE):
        part = h[i:i + BITS_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id",
                 text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(``id_col``, *keep, fp): ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), shingle_words) for t in b.column(b.num_columns - 1)]
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], names=[*b.schema.names[:-1], "fp"])

    rows = docs.select(F.col(id_col), *keep, whole_text(text_col).alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*fields, "fp long"]))


def trie_links(values: np.ndarray, max_bits: int, bits: int = 64) -> list[tuple[int, int]]:
    """Index pairs that span the components of ``values`` (different, sorted
    unsigned integers of ``bits`` bits) under Hamming distance <= max_bits.

    Node pairs of the trie go down together, level by level; a node is the
    range of values that share its prefix, and a pair carries its differing
    bits so far."""
    n = len(values)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links: list[tuple[int, int]] = []
    if n < 2:
        return links
    pairs = np.array([[0, n, 0, n, 0]], np.int64)  # lo, hi of both nodes, differing bits
    for level in range(bits - 1, -1, -1):
        # first index of each node whose bit at this level is 1
        ones = np.concatenate(([0], np.cumsum((values >> np.uint64(level)) & np.uint64(1)).astype(np.int64)))
        a0, a1, b0, b1, d = pairs.T
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        down = [np.column_stack((a0, am, b0, bm, d)), np.column_stack((am, a1, bm, b1, d)),
                np.column_stack((a0, am, bm, b1, d + 1)),
                np.column_stack((am, a1, b0, bm, d + 1))[~same]]
        pairs = np.concatenate(down)
        alone = (pairs[:, 0] == pairs[:, 2]) & (pairs[:, 1] - pairs[:, 0] < 2)  # a leaf with itself
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= max_bits) & ~alone]
    for i, j in pairs[:, [0, 2]].tolist():
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            links.append((i, j))
    return links


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(src, dst): links between different fingerprints of column ``fp`` that
    span the components under Hamming distance <= max_bits."""
    if not 0 <= max_bits < PARTS:
        raise ValueError(f"max_bits must be 0 to {PARTS - 1}")
    part = [F.shiftrightunsigned(F.col("fp"), 56 - 8 * i).bitwiseAND(F.lit(255)) for i in range(PARTS)]

    def prefix(chosen: tuple[int, ...]) -> Column:
        mask = sum(255 << (56 - 8 * i) for i in chosen)
        mask -= (mask >> 63) << 64  # as a signed long
        return F.struct(F.lit(sum(1 << i for i in chosen)).alias("parts"),
                        F.col("fp").bitwiseAND(F.lit(mask).cast("long")).alias("prefix"))

    assert len(part) == PARTS
    choices = [prefix(c) for c in combinations(range(PARTS), PARTS - max_bits)]
    spread = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # every node becomes many rows
    subtrees = (fps.select("fp").distinct().repartition(spread)
                .select("fp", F.explode(F.array(*choices)).alias("root"))
                .groupBy("root").agg(F.collect_list("fp").alias("fps"))
                .where(F.size("fps") > 1).select("fps"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, dst = [], []
            for fp in b.column(0):
                v = np.sort(np.asarray(fp.values, np.int64).view(np.uint64))
                ids = v.view(np.int64)
                for i, j in trie_links(v, max_bits):
                    src.append(int(ids[i]))
                    dst.append(int(ids[j]))
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())],
                                             names=["src", "dst"])

    return subtrees.mapInArrow(walk, "src long, dst long")


def components(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
               id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """(``id_col``, *keep, fp, root, component_id) per row.  ``component_id``
    is the smallest id that links reach from the row, itself included;
    ``root`` is the component's smallest fingerprint."""
    rows = reliable_checkpoint(fingerprints(docs, shingle_words, id_col, text_col, keep))
    nodes = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    forest = star_forest(links(rows, max_bits))
    linked = nodes.join(forest.withColumnRenamed("id", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    member = linked.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return rows.join(member, "fp").select(*rows.columns, "root", "component_id")


def near_dedup(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id
    (a null id comes last; rows with equal ids in order of their text's
    hash; of rows equal in both, one).  All columns are kept."""
    keys = ["__no_id", "__id", "__text_hash"]
    no_id, text_hash = F.col(id_col).isNull(), F.xxhash64(whole_text(text_col))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    found = components(docs, shingle_words, max_bits, id_col, text_col, (text_hash.alias("__text_hash"),))
    first = F.struct(no_id.alias("__no_id"), F.col(id_col).alias("__raw"), "__text_hash", name.alias("__id"))
    stay = found.groupBy("root").agg(F.min(first).alias("first")).select(*[f"first.{k}" for k in keys])
    keyed = docs.withColumns({"__no_id": no_id, "__id": name, "__text_hash": text_hash})
    # the join has dealt the rows by these keys, so the last step moves none
    return keyed.join(stay, keys, "left_semi").dropDuplicates(keys).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def hex_digits(fp: str | Column = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


