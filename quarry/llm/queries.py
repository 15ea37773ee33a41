"""The operators applied to the given tables, one query each.

Every query reads its whole table and returns one row per document (or per
row of its result) with the digest columns of its contract.  ``SQL`` has the
DuckDB text of those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import license_scan as licenses
from quarry.llm import decontaminate, hard_negatives, merkle, mixing
from quarry.llm import quality_classifier as classifier
from quarry.llm import quality_rules as rules
from quarry.llm import secret_scan as secrets
from quarry.llm import sentencepiece_codec as pieces
from quarry.llm import sharding, simhash, spotsigs
from quarry.llm import token_counts as tokens
from quarry.llm.common import documents

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(build: Builder) -> Builder:
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build
    return keep


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir))


@query("op2_license_scan", sql=licenses.sql())
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = documents(spark, sf_dir, "labels").where("quality = 1")
    return rules.quality_rules(documents(spark, sf_dir), trusted)


@query("op4_source_mix", sql=mixing.sql())
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_sentencepiece")
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query("op7_spotsigs")
def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(documents(spark, sf_dir))


@query("op8_secret_scan", sql=secrets.sql())
def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir))


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


@query("op11_merkle", sql=merkle.sql())
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(documents(spark, sf_dir))


@query("op12_decontaminate", sql=decontaminate.sql())
def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query("op13_hard_negatives", sql=hard_negatives.sql())
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)
