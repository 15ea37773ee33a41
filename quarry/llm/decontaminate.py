"""Benchmark decontamination by a prefix-filtered set join.

*Sets.*  An item's windows are its runs of ``window_words`` words (an item of
fewer, but not none, is one window).  A window is the set of its word shingles
of ``shingle_words`` words, each with its offset (a shorter window is one
shingle).  A place in a document has the set of the window that would begin
there, and *contains* an item's window if at least the share ``containment``
of the item's set stands there; at 1 that is the window word by word.

*Rarity.*  All shingles of all windows are counted over all documents, and a
window's shingles are put in order of that count, rarest first.  Of n shingles
``n - ceil(containment * n) + 1`` are the *prefix*: a place that lacks all of
them cannot reach the share.

*Join.*  Documents emit only the places whose shingle may be in a prefix: they
test a bitmap of ``MAX_BITS`` bits at most, whatever the number of items, and
Spark joins what passes to the prefix shingles by hash.  A shingle at word p
that has offset o in a window puts its begin at ``p - o``.  The length bound
drops begins outside the text; the positional bound drops a match at rank r of
the order if the ``n - r`` shingles that may follow cannot make the share.
Copies of a text are joined once.

*Verification.*  What is left is compared word by word: every emitted place
carries the words around it, at most twice a window.

Defined results: null and empty texts have no words and no hits; items without
words are in nothing; items with equal ids are one item with several texts; an
item without an id marks words as hit but is not among the items; repeated
documents each give a row; empty tables give no hits; columns other than the
ids and texts are not read, ``clean`` keeps them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import whole_text
from quarry.llm.wordhash import Words, pieces
from quarry.session import reliable_checkpoint

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
MIN_BITS, MAX_BITS = 1 << 16, 1 << 25
BITS_PER_SHINGLE = 64
ROW_PLACES = 4_096  # places in one row of the scan


def text_key(col: str = "text") -> Column:
    return F.unhex(F.sha2(whole_text(col), 256))


# -- items -------------------------------------------------------------------

def item_windows(items: DataFrame, window_words: int = WINDOW_WORDS, shingle_words: int = SHINGLE_WORDS,
                 id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words, length, k, hashes) of every window: its words joined by
    blanks, their number, the words of a shingle and the shingles' hashes in
    order of offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0)
            out: list[tuple] = []
            rows: list[int] = []
            for lo, hi, w in pieces(b.column(1)):
                own = w.hashes()
                by_size: dict[int, np.ndarray] = {}
                for r in range(hi - lo):
                    first, last = int(w.first[r]), int(w.first[r + 1])
                    length = min(window_words, last - first)
                    k = min(shingle_words, length)
                    if not length:
                        continue
                    if k not in by_size:
                        at, hashed = w.shingles(own, k)
                        by_size[k] = np.zeros(len(own), np.int64)
                        by_size[k][at] = hashed.view(np.int64)
                    for i in range(first, last - length + 1):
                        rows.append(lo + r)
                        out.append((w.text(i, i + length), length, k, by_size[k][i:i + length - k + 1]))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()),
                 pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int64()))],
                names=["item", "words", "length", "k", "hashes"])

    kind = items.schema[id_col].dataType.simpleString()
    return items.select(F.col(id_col), whole_text(text_col).alias("__text")).mapInArrow(
        run, f"item {kind}, words string, length int, k int, hashes array<long>")


# -- the bitmap that documents test -------------------------------------------

def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of column ``hash``, of 64 bits a hash and ``MAX_BITS`` at most;
    Spark makes its words, the driver gets at most one row for each."""
    n = hashes.agg(F.count(F.lit(1))).first()[0]
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_SHINGLE * max(n, 1) - 1).bit_length()))
    place = F.pmod("hash", F.lit(bits))
    rows = hashes.groupBy(F.shiftright(place, 6).alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("m"))
    got = rows.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["m"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(words) * 64 - 1)
    return (words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def found_shingles(w: Words, sizes: list[int], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the texts' shingles of these sizes that the bitmap has."""
    own, at, hashed = w.hashes(), [], []
    for k in sizes:
        i, h = w.shingles(own, k)
        hit = in_bitmap(words, h)
        at.append(i[hit])
        hashed.append(h[hit])
    return (np.concatenate(at), np.concatenate(hashed)) if at else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def shingle_counts(docs: DataFrame, sizes: list[int], words: np.ndarray, text_col: str = "text") -> DataFrame:
    """(hash, n): occurrences over all documents of the shingles that the
    bitmap has, summed up in each batch first."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [found_shingles(w, sizes, held.value)[1] for _, _, w in pieces(b.column(0))]
            values, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], names=["hash", "n"])

    return (docs.select(whole_text(text_col).alias("__text")).mapInArrow(run, "hash long, n long")
            .groupBy("hash").agg(F.sum("n").alias("n")))


def prefixes(windows: DataFrame, counts: DataFrame, containment: float) -> DataFrame:
    """(hash, words, length, k, size, need, at, rank): the prefix shingles of
    every window (``words`` names it), rarest first."""
    each = windows.select("words", "length", "k", F.posexplode("hashes").alias("at", "hash"))
    ranked = each.join(counts, "hash", "left").groupBy("words", "length", "k").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "at"))).alias("order"))
    # a little less, so that a share such as 0.8 of 5 needs 4
    need = F.ceil(F.lit(containment) * F.size("order") - 1e-9).cast("int")
    sized = ranked.withColumn("size", F.size("order")).withColumn("need", F.greatest(need, F.lit(1)))
    prefix = F.slice("order", F.lit(1), F.col("size") - F.col("need") + 1)
    return sized.select("words", "length", "k", "size", "need", F.posexplode(prefix).alias("rank", "s")).select(
        "s.hash", "words", "length", "k", "size", "need", "s.at", "rank")


# -- documents ----------------------------------------------------------------

def scan(docs: DataFrame, sizes: list[int], words: np.ndarray, window_words: int, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(doc, key, n_words, whole, places): one row per text (``whole``), and
    more for texts of many places.  A place has the hash, its word, the first
    word of its surroundings and their words."""
    held = docs.sparkSession.sparkContext.broadcast(words)
    place = pa.struct([("hash", pa.int64()), ("pos", pa.int64()), ("first", pa.int64()), ("around", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, n_words, whole, places = [], [], [], []
            for lo, hi, w in pieces(b.column(2)):
                at, hashed = found_shingles(w, sizes, held.value)
                text = np.searchsorted(w.first, at, "right") - 1
                by_text: dict[int, list[dict]] = {}
                for r, p, h in zip(text.tolist(), at.tolist(), hashed.view(np.int64).tolist()):
                    first, last = int(w.first[r]), int(w.first[r + 1])
                    begin = max(first, p - window_words)
                    by_text.setdefault(r, []).append({
                        "hash": h, "pos": p - first, "first": begin - first,
                        "around": w.text(begin, min(last, p + window_words))})
                sizes_of = np.diff(w.first).tolist()
                for r in range(hi - lo):
                    own = by_text.get(r, [])
                    for k in range(0, max(len(own), 1), ROW_PLACES):
                        row.append(lo + r)
                        n_words.append(sizes_of[r])
                        whole.append(k == 0)
                        places.append(own[k:k + ROW_PLACES])
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array(n_words, pa.int64()), pa.array(whole, pa.bool_()),
                 pa.array(places, pa.list_(place))], names=["doc", "key", "n_words", "whole", "places"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_key(text_col).alias("__key"), whole_text(text_col).alias("__text")).mapInArrow(
        run, f"doc {kind}, key binary, n_words long, whole boolean, "
        "places array<struct<hash: long, pos: long, first: long, around: string>>")


@dataclass
class Passages:
    """``texts``: doc, key, n_words per document.  ``found``: key, words,
    length, begin, cover, one row per text and contained window.  ``owners``:
    words, item."""

    texts: DataFrame
    found: DataFrame
    owners: DataFrame


def passages(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS, shingle_words: int = SHINGLE_WORDS,
             containment: float = 1.0, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
             item_text_col: str = "text") -> Passages:
    """All places of ``docs`` that contain a window of ``items``."""
    if not (0 < containment <= 1 and window_words > 0 and shingle_words > 0):
        raise ValueError("containment must be over 0 and at most 1, windows and shingles of a word at least")
    every = reliable_checkpoint(item_windows(items, window_words, shingle_words, item_col, item_text_col))
    windows = every.dropDuplicates(["words"]).select("words", "length", "k", "hashes")
    shingles = windows.select(F.explode("hashes").alias("hash")).distinct()
    sizes = sorted(r.k for r in windows.select("k").distinct().collect())  # 1 to shingle_words
    counts = shingle_counts(docs, sizes, bitmap(shingles), text_col)
    prefix = reliable_checkpoint(prefixes(windows, counts, containment))
    texts = reliable_checkpoint(scan(docs, sizes, bitmap(prefix.select("hash").distinct()), window_words, id_col, text_col))

    places = texts.where(F.size("places") > 0).select("key", "n_words", F.explode("places").alias("p")).select(
        "key", "n_words", "p.*").dropDuplicates(["key", "pos", "hash"])
    begin = F.col("pos") - F.col("at")
    near = places.join(prefix, "hash").withColumn("begin", begin).where(
        (F.col("begin") >= 0) & (F.col("begin") + F.col("length") <= F.col("n_words"))  # length
        & (F.col("size") - F.col("rank") >= F.col("need"))).dropDuplicates(["key", "words", "begin"])  # position
    there = F.slice(F.split("around", " "), (F.col("begin") - F.col("first") + 1).cast("int"), F.col("length"))
    both = near.withColumn("there", there).withColumn("here", F.split("words", " "))
    same = F.filter(F.sequence(F.lit(1), F.col("size")), lambda i: F.slice("there", i, F.col("k")) == F.slice("here", i, F.col("k")))
    found = both.withColumn("same", F.size(same)).where(F.col("same") >= F.col("need")).select(
        "key", "words", "length", "begin", (F.col("same") / F.col("size")).alias("cover"))
    return Passages(texts.where("whole").select("doc", "key", "n_words"), reliable_checkpoint(found),
                    every.select("words", "item").distinct())


def marked(p: Passages) -> DataFrame:
    """(key, n_hit, n_items, item_list) of every text with a passage: its words
    inside any contained window, and the items that these are of."""
    upto = F.col("begin") + F.col("length")
    # running windows over one text's places, never over more
    so_far = F.max("upto").over(Window.partitionBy("key").orderBy("begin", "upto").rowsBetween(Window.unboundedPreceding, -1))
    covered = (p.found.select("key", "begin", upto.alias("upto")).distinct().withColumn("done", so_far)
               .withColumn("new", F.greatest(F.lit(0), F.col("upto") - F.greatest("begin", F.coalesce("done", F.lit(0)))))
               .groupBy("key").agg(F.sum("new").alias("n_hit")))
    of = (p.found.select("key", "words").distinct().join(p.owners.where("item IS NOT NULL"), "words")
          .select("key", F.col("item").cast("string").alias("item")).distinct()
          .groupBy("key").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("item_list")))
    return covered.join(of, "key", "left")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``id_col``, n_words, n_hit, n_items, items_sha256, contaminated per row."""
    p = passages(docs, items, id_col=id_col, **how)
    return p.texts.join(marked(p), "key", "left").select(
        F.col("doc").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("item_list", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without a passage of ``items``, with all columns."""
    bad = passages(docs, items, text_col=text_col, **how).found.select(F.col("key").alias("__key")).distinct()
    return docs.withColumn("__key", text_key(text_col)).join(bad, "__key", "left_anti").select(
        *[F.col(f"`{c}`") for c in docs.columns])


def sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = (r"regexp_extract_all(translate(coalesce(text, ''), "
             rf"'{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WINDOW_WORDS}) AS l, array_to_string(w[p:p + least(len(w), {WINDOW_WORDS}) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW_WORDS}, 0) + 2)) AS p FROM b WHERE len(w) > 0)),
places AS (SELECT r, p, l, array_to_string(w[p:p + l - 1], ' ') AS words
  FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM win))),
hit AS (SELECT r, p, l, item_id FROM places JOIN win USING (l, words)),
cover AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(p, p + l)) AS spot FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN items USING (r)"""
