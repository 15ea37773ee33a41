"""SpotSigs fingerprints and the likeness of texts.

*Signatures.*  Every common word (``ANCHORS``, of four languages) that occurs
in a text opens a chain of the next ``CHAIN`` content words; the anchor with
its chain, hashed to 64 bits, is one signature.  At the text's end chains are
shorter, down to the anchor alone.  The text's first words are a chain of
their own.  Fallback: a content word in no anchor's chain opens a chain under
the mark ``^``, so every word of a text is in a signature, with few anchors or
none as well.  The set of signatures is what texts are compared by; the
fingerprint is its size, sum and xor, which no order of words or rows changes.

*Likeness.*  Sets are partitioned by length: partition k holds lengths of
``(1/least)^k`` up to ``(1/least)^(k+1)``.  Sets of partitions that are not
neighbours cannot reach the Jaccard likeness ``least`` and are not compared;
others are compared through the smaller set, which ends as soon as the
elements not found push the bound below ``least``.  Likeness below ``least``
is 0, any other is exact; with the default of 0 all are.

*Neighbours.*  ``next_in_order`` gives every document the text of its
successor in descending id without a global window: the ids alone are cut
into ranges at existing ids, the rows move once to their range, and the row
at the head of a range goes to the range before as well.  Tasks stream their
sorted range and hold two rows.

Defined results: null text is the empty text, without signatures; two empty
sets have likeness 1, an empty and another 0; after the smallest id comes the
largest; a single document follows itself; rows with equal ids follow each
other in order of their text's hash; a row without an id is its own
successor; an empty table gives none; only id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import whole_text

# Fixed list: common words of English, French, German and Spanish.
ANCHORS = frozenset("""
a an the is are was were be to of in on at for and or by with that this it as from
le la les un une des du de et est en que qui dans pour par sur au aux
der die das und ist ein eine einen von zu mit den dem des nicht sich auf im
el los las y del al se su por con para es lo
""".split())
CHAIN = 3
LEAST = 0.0
WORD = re.compile(r"\w+")


def signatures(text: str) -> frozenset[int]:
    """The 64-bit signatures of one text."""
    from xxhash import xxh64_intdigest

    content: list[str] = []
    spots: list[tuple[str, int]] = []
    chained = 0  # the chains of anchors end before this content word
    for w in WORD.findall(text.lower()):
        if w in ANCHORS:
            spots.append((w, len(content)))
            chained = len(content) + CHAIN
        else:
            if len(content) >= chained:
                spots.append(("^", len(content)))
            content.append(w)
    spots.append(("^", 0))
    if not content:  # anchors alone: their sequence is the one chain
        words = [a for a, _ in spots[:-1]]
        return frozenset([xxh64_intdigest("^ " + " ".join(words))] if words else [])
    return frozenset(xxh64_intdigest(f"{a} {' '.join(content[i:i + CHAIN])}") for a, i in spots)


def fingerprint(text: str, sigs: frozenset[int]) -> str:
    """Size, sum and xor of the set, in hex; of a text without any word the
    text's own digest."""
    if not sigs:
        return "0-" + hashlib.sha256(text.encode()).hexdigest()[:32]
    x = 0
    for s in sigs:
        x ^= s
    return f"{len(sigs):x}-{sum(sigs) & (2 ** 64 - 1):016x}{x:016x}"


def length_partition(n: int, least: float) -> int:
    return int(math.log(n) / -math.log(least) + 1e-9)


def likeness(a: frozenset[int], b: frozenset[int], least: float = LEAST) -> float:
    """Jaccard likeness, 0 if below ``least``."""
    if not a or not b:
        return float(len(a) == len(b))
    if 0 < least < 1 and abs(length_partition(len(a), least) - length_partition(len(b), least)) > 1:
        return 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    both = len(a) + len(b)
    # Jaccard >= least needs this many common elements
    missing = len(small) - math.ceil(least * both / (1 + least) - 1e-9)
    common = 0
    for x in small:
        if x in large:
            common += 1
        else:
            missing -= 1
            if missing < 0:
                return 0.0
    found = common / (both - common)
    return found if found >= least else 0.0


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to the following text's first."""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k]


def next_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, __text, __part, __role), dealt and sorted: within a part
    the rows of role 0 in descending id, then the head of the next part (role
    1); rows of role 2 have no id.  Ids must be numbers."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # all of these are ids of the table: the heads of the ranges
    heads = docs.agg(F.max(id_col), F.percentile_approx(
        id_col, [i / parts for i in range(1, parts)] or [1.0], F.lit(100 * parts))).first()
    first, rest = heads[0], sorted({h for h in heads[1] or [] if h != heads[0]}, reverse=True)
    cuts = F.array(*[F.lit(c) for c in rest]) if rest else F.array().cast("array<long>")
    key = F.col(id_col)
    n = len(rest) + 1
    part = F.size(F.filter(cuts, lambda c: c >= key))
    own = F.struct(part.alias("part"), F.lit(0).alias("role"))
    ahead = F.struct(((part + (n - 1)) % n).alias("part"), F.lit(1).alias("role"))
    is_head = (key == F.lit(first)) | F.array_contains(cuts, key) if rest else key == F.lit(first)
    spread = F.struct(F.pmod(F.xxhash64("__text"), F.lit(n)).cast("int").alias("part"), F.lit(2).alias("role"))
    places = F.when(key.isNull(), F.array(spread)).when(is_head, F.array(own, ahead)).otherwise(F.array(own))
    return (docs.select(key, whole_text(text_col).alias("__text")).withColumn("__place", F.explode(places))
            .select(key, "__text", F.col("__place.part").alias("__part"), F.col("__place.role").alias("__role"))
            .repartitionById(n, F.col("__part"))
            .sortWithinPartitions("__part", "__role", F.desc(id_col), F.xxhash64("__text")))


def fingerprints(docs: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_signatures per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key, text, sigs, following, its):
            new = edited(text, following)
            new_sigs = signatures(new)
            return (key, len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprint(text, sigs),
                    fingerprint(new, new_sigs), likeness(sigs, new_sigs, least), likeness(sigs, its, least), len(sigs))

        held = None  # (part, id, text, signatures) of the row that waits for its successor
        for b in batches:
            out = []
            for key, value, part, role in zip(*(c.to_pylist() if i != 1 else c for i, c in enumerate(b.columns))):
                if role == 1 and (held is None or held[0] != part):
                    continue  # a further row with the id of the next part's head
                text = value.as_py()
                sigs = signatures(text)
                if role == 2:
                    out.append(row(key, text, sigs, text, sigs))
                    continue
                if held is not None:
                    out.append(row(*held[1:], text, sigs))
                held = (part, key, text, sigs) if role == 0 else None
            cols = list(zip(*out)) if out else [[] for _ in range(8)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (b.schema.types[0], pa.int64(), pa.string(), pa.string(),
                                                       pa.string(), pa.float64(), pa.float64(), pa.int64()))],
                names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                       "near_next", "n_signatures"])

    rows = next_in_order(docs, id_col, text_col)
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                           "edited_fingerprint string, near_edited double, near_next double, n_signatures long")
