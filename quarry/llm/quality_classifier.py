"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled
texts.  A text is compressed with both in independent chunks of ``CHUNK``
bytes (so the dictionaries matter along the whole text, not only at its
start); the difference of the two sizes over the larger one is its feature,
and a logistic fit turns it into the probability of label 1.

*Bounds.*  Training reads at most ``DICT_DOCS`` texts per class for the
dictionaries and as many others for the calibration, each of at most
``MAX_BYTES`` bytes; which ones is fixed by a hash of their id.  They are the
only rows that reach the driver.  Calibration weighs the classes by their
share among all training labels.  Scoring reads every text whole, in one
``mapInArrow`` over the scan; nothing is shuffled.

Defined results: null and empty texts have feature 0 and its score; if a
class has no training text every score is the (smoothed) share of label 1;
null labels train nothing; of an id that is labelled twice the larger label
counts; repeated rows each give a row; an empty table gives none; ids,
sources and languages are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import whole_text

DICT_DOCS = 1_500
MAX_BYTES = 32_768
DICT_BYTES = 112_640
CHUNK = 512
LEVEL = 3
HELD_OUT_MOD = 5
CUT = 0.3


def chunks(text: bytes) -> list[bytes]:
    return [text[i:i + CHUNK] for i in range(0, len(text), CHUNK)]


def train_dictionary(texts: list[bytes]) -> bytes:
    """A dictionary from the texts' chunks; the chunks themselves where they
    are too few to train on."""
    import zstandard as zstd

    parts = [c for t in texts for c in chunks(t)]
    try:
        return zstd.train_dictionary(DICT_BYTES, parts).as_bytes()
    except (zstd.ZstdError, ValueError):
        return b"".join(parts)[-DICT_BYTES:]


class Sizes:
    """Compressed sizes of texts under the dictionary of good and of bad text."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zstd

        self.good, self.bad = (
            zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False).compress
            for d in map(zstd.ZstdCompressionDict, (good, bad)))

    def feature(self, text: bytes) -> float:
        """(bad - good) / larger: above 0 where the good dictionary fits better."""
        parts = chunks(text)
        good, bad = sum(len(self.good(c)) for c in parts), sum(len(self.bad(c)) for c in parts)
        return (bad - good) / max(good, bad, 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, intercept) of the weighted fit, by Newton's method."""
    a = np.column_stack((x, np.ones_like(x)))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (y - p)) - ridge * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -20, 20)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def held_out(id_col: str = "doc_id") -> Column:
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % HELD_OUT_MOD == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> dict:
    """The model: ``good`` and ``bad`` dictionaries, ``slope``, ``intercept``."""
    train = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y")))
    share = {r["__y"]: r["n"] for r in train.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = {"good": b"", "bad": b"", "slope": 0.0,
             "intercept": float(np.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1)))}
    # per class the ids with the least hashes; half of them, by another hash, calibrate
    first = [train.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(2 * DICT_DOCS) for y in (0, 1)]
    picked = first[0].union(first[1]).withColumn("__half", F.pmod(F.xxhash64(F.lit("half"), "__id"), F.lit(2)))
    text = whole_text(text_col)
    sample = (docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
              .where((F.octet_length("__text") <= MAX_BYTES) & (F.col("__text") != ""))
              .join(F.broadcast(picked), "__id")  # at most 4 * DICT_DOCS ids
              .groupBy("__id", "__y", "__half").agg(F.min("__text").alias("__text")))
    rows = sorted((r["__y"], r["__half"], str(r["__id"]), r["__text"].encode()) for r in sample.collect())
    odd = {y: [t for c, k, _, t in rows if c == y and k] for y in (0, 1)}
    even = {y: [t for c, k, _, t in rows if c == y and not k] for y in (0, 1)}
    if not (odd[0] and odd[1] and even[0] and even[1]):
        return prior
    good, bad = train_dictionary(odd[1]), train_dictionary(odd[0])
    sizes = Sizes(good, bad)
    x = np.array([sizes.feature(t) for y in (0, 1) for t in even[y]])
    y = np.array([float(y) for y in (0, 1) for _ in even[y]])
    total = share[0] + share[1]
    weight = np.where(y == 1, share[1] / total / len(even[1]), share[0] / total / len(even[0])) * len(y)
    slope, intercept = logistic(x, y, weight)
    return {"good": good, "bad": bad, "slope": slope, "intercept": intercept}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, held_out, score, predicted per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model["good"], model["bad"])
        for b in batches:
            x = np.array([sizes.feature(t.as_buffer().to_pybytes()) for t in b.column(2)], float)
            p = 1 / (1 + np.exp(-np.clip(model["slope"] * x + model["intercept"], -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(p), pa.array((p >= CUT).astype(np.int32))],
                names=[id_col, "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), whole_text(text_col).alias("__text"))
    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """Fit on the labelled rows that are not held out, score all rows."""
    return score(docs, fit(docs, labels, **columns),
                 **{k: v for k, v in columns.items() if k in ("id_col", "text_col")})
