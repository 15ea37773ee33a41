"""Incremental landing: records seen in an earlier batch are not re-emitted."""

import os

from pyspark.sql import functions as F

from quarry.streaming import landing as L


def test_land_twice_dedupes_across_batches(spark, tmpdir_path):
    land = os.path.join(tmpdir_path, "landing")
    target = os.path.join(tmpdir_path, "target")
    ck = os.path.join(tmpdir_path, "ck")
    b1 = spark.createDataFrame([("T1", "J", "d1", "l1"), ("T1", "J", "d1", "l1b"), (None, "J", "d2", "l2")],
                               L.LINK_SCHEMA)
    b1.write.mode("append").parquet(land)
    L.land_once(spark, land, target, ck)
    assert spark.read.parquet(target).count() == 1
    b2 = spark.createDataFrame([("T1", "J", "d1", "again"), ("T3", "J", "d3", "l3")], L.LINK_SCHEMA)
    b2.write.mode("append").parquet(land)
    L.land_once(spark, land, target, ck)
    got = sorted((r.doi, r.title, r.link) for r in spark.read.parquet(target).collect())
    assert got == [("d1", "T1", "l1"), ("d3", "T3", "l3")]
    L.land_once(spark, land, target, ck)  # nothing new
    assert spark.read.parquet(target).count() == 2


def test_merge_batch_into_skips_known_keys(spark):
    target = spark.createDataFrame([("T1", "J", "d1", "l1")], L.LINK_SCHEMA)
    batch = spark.createDataFrame([("T1", "J", "d1", "x"), ("T2", "J", "d2", "y"), ("T2", "J", "d2", "z"),
                                   (None, "J", "d3", "w")], L.LINK_SCHEMA)
    got = sorted((r.doi, r.title) for r in L.merge_batch_into(target, batch).collect())
    assert got == [("d2", "T2")]


def test_small_batch_reads_few_files_and_a_replay_changes_nothing(spark, tmpdir_path):
    land, target = os.path.join(tmpdir_path, "landing"), os.path.join(tmpdir_path, "target")
    rows = [(f"T{i}", "J", f"d{i}", f"l{i}") for i in range(400)]
    spark.createDataFrame(rows, L.LINK_SCHEMA).write.mode("append").parquet(land)
    L.land_once(spark, land, target, os.path.join(tmpdir_path, "ck"))
    spark.createDataFrame([rows[7], ("T7", "J", "new", "l")], L.LINK_SCHEMA).write.mode("append").parquet(land)
    L.land_once(spark, land, target, os.path.join(tmpdir_path, "ck"))

    def stored():
        return sorted((r.doi, r.title, r.link) for r in spark.read.parquet(target).collect())

    first = stored()
    assert len(first) == 401
    some = L.known_links(spark, target, [0, 1], 99)
    read = {r.f for r in some.select(F.input_file_name().alias("f")).distinct().collect()}
    assert 0 < len(read) <= 4 and all("bucket=0/" in f or "bucket=1/" in f for f in read)
    assert "bucket" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1].split("]")[0]
    # a new stream state sees both landings as one batch again
    L.land_once(spark, land, target, os.path.join(tmpdir_path, "ck2"))
    assert stored() == first
