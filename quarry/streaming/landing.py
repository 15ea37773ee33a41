"""Incremental landing of harvested batches.

The reference processes index ranges as separate batch jobs, each writing
its own file, and de-duplicates when combining.  Here new landed Parquet
files are picked up by a file-source stream (``trigger(availableNow)``, the
checkpoint is the resume point), and every batch is de-duplicated on (doi,
title) and merged into the target, so a record seen in an earlier batch is
never emitted again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import reliable_checkpoint

BUCKETS = 64
LINK_SCHEMA = "title string, pub_name string, doi string, link string"


def landed_links(spark: SparkSession, landing: str, schema: str = LINK_SCHEMA) -> DataFrame:
    """Stream of link rows from Parquet files landed in a folder."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000)
            .parquet(landing))


def first_links(links: DataFrame, keys=("doi", "title")) -> DataFrame:
    """Rows that have all keys, one per key: the one with the smallest other
    columns, whatever order they arrive in (map-side ``min``)."""
    others = [c for c in links.columns if c not in keys]
    return (links.dropna("any", subset=list(keys)).groupBy(*keys)
            .agg(F.min(F.struct(*others)).alias("_r")).select(*keys, "_r.*").select(*links.columns))


def merge_batch_into(target_df: DataFrame, batch: DataFrame, keys=("doi", "title")) -> DataFrame:
    """The first row of each key of a batch that the target does not have."""
    return first_links(batch, keys).join(target_df.select(*keys), list(keys), "left_anti").select(*batch.columns)


def _bucket(keys, n_buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(n_buckets)).cast("int")


def known_links(spark: SparkSession, target: str, buckets: list[int], batch_id: int, schema: str = LINK_SCHEMA) -> DataFrame:
    """What other batches left in the given buckets of the target; the files of
    all other buckets stay unread."""
    return (spark.read.schema(f"{schema}, bucket int, batch long").parquet(target)
            .where(F.col("bucket").isin(buckets) & (F.col("batch") != batch_id)))


def land_once(spark: SparkSession, landing: str, target: str, checkpoint: str,
              schema: str = LINK_SCHEMA, keys=("doi", "title"), n_buckets: int = BUCKETS) -> None:
    """Process everything landed so far, add rows with new keys, stop.

    The target itself is what earlier batches are known by, so the stream
    keeps no growing state.  It is laid out by a hash of the keys
    (``bucket=b/batch=i``): a batch reads only the buckets its own keys fall
    in, and writes only its own folders, over again if it is run again after a
    failure.  ``n_buckets`` must not change in the life of a target."""

    def write(batch: DataFrame, batch_id: int) -> None:
        new = reliable_checkpoint(first_links(batch, keys).withColumn("bucket", _bucket(keys, n_buckets)))
        buckets = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        try:
            known = known_links(spark, target, buckets, batch_id, schema)
            new = new.join(known.select(*keys, "bucket"), [*keys, "bucket"], "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        (new.withColumn("batch", F.lit(batch_id)).repartition("bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(target))

    q = (landed_links(spark, landing, schema).writeStream.foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
