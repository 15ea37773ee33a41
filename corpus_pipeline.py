"""The corpus pipeline: documents to token ids in five stages.

Every stage works on all rows that the one before kept, is written as
Parquet and reread.  All stages but the last return the columns of
``documents``:

1. quality rules: rejected documents go;
2. SimHash near-dedup: one document of each group stays;
3. secret scan: secrets are replaced in the texts;
4. source mix: documents are taken as often as their source's target says;
5. SentencePiece: texts become piece ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing, quality_rules, secret_scan, sentencepiece_codec, simhash
from quarry.llm.common import documents
from quarry.session import checkpoint_dir, ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality_rules.keep_good(docs, documents(spark, sf_dir, "labels").where("quality = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.near_dedup(docs, shingle_words=3, max_bits=2)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secret_scan.redact_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return sentencepiece_codec.encode(docs, keep=tuple(c for c in docs.columns if c not in ("doc_id", "text")))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("secret_scan", secrets),
    ("source_mix", source_mix),
    ("sentencepiece", sentencepiece),
]

# Not in SQL: hashed n-grams, SimHash and Viterbi; tests hold every stage
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them are written to
    the folder that executors share (``spark.checkpoint.dir``)."""
    folder = f"{checkpoint_dir(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
