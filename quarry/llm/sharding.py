"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

A key's ring slot is the top ``RING_BITS`` bits of its hash; every shard has
``vnodes`` places on the ring, and a key belongs to the first place at or
after its slot (its arc).  A shard takes at most its capacity, ``n // shards``
rows (one more for the first ``n % shards`` shards): keys that find it full
go on clockwise to the next place of a shard with room.  The capacities add
up to n, so the counts of any two shards differ by at most one (law
``rows``).

Only counts walk the ring.  Rows are counted per arc; in each round every
arc's waiting keys are offered to the next open place, a shard accepts in
ring order up to its room, and the rest go on.  A round with keys left over
fills at least one shard, so there are at most ``shards + 1`` rounds, on a
table of at most ``shards * (vnodes + rounds)`` rows whatever the input.  A
row finds its shard by its rank in its arc: an arc's accepted runs are
disjoint ranges of ranks.  Ranks come from one window per arc, and rows that
are equal in everything that counts are one row with a multiplicity there.

Defined results: null text has no bytes (size 16); rows with a null id are
spread by size and checksum; repeated rows each get a slot; an empty table
gives none; only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import whole_text
from quarry.session import reliable_checkpoint

SHARDS = 40
VNODES = 256
RING_BITS = 16
ROW_BYTES = 16


def ring(spark: SparkSession, shards: int, vnodes: int) -> DataFrame:
    """(place, shard, slot): the places in ring order; of places on one slot
    the lowest shard's stays."""
    places = spark.range(shards * vnodes).select(
        F.floor(F.col("id") / vnodes).cast("int").alias("shard"), (F.col("id") % vnodes).alias("v"))
    slot = F.shiftrightunsigned(F.xxhash64(F.lit("place"), "shard", "v"), 64 - RING_BITS)
    return (places.groupBy(slot.cast("int").alias("slot")).agg(F.min("shard").alias("shard"))
            .select((F.row_number().over(Window.orderBy("slot")) - 1).alias("place"), "shard", "slot"))


def _arcs(places: DataFrame, spark: SparkSession) -> DataFrame:
    """(slot, arc): the place that every slot of the ring belongs to."""
    after = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = spark.range(2 ** RING_BITS).select(F.col("id").cast("int").alias("slot"))
    return slots.join(places, "slot", "left").select(
        "slot", F.coalesce(F.min("place").over(after), F.lit(0)).alias("arc"))


def bounded_loads(counts: DataFrame, places: DataFrame, capacity: DataFrame) -> DataFrame:
    """(arc, lo, hi, shard, base): the ranks lo to hi - 1 of an arc go to
    ``shard``, where the first of them is row ``base``.

    ``counts`` has (arc, n), ``places`` (place, shard, slot) and ``capacity``
    (shard, room)."""
    n_places = places.count()
    waiting = counts.select("arc", F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"), F.col("arc").alias("at"))
    room = capacity.select("shard", F.col("room"), F.lit(0).cast("long").alias("used"))
    settled: list[DataFrame] = []
    while True:
        here = Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        free = places.join(room, "shard").withColumn("open", F.when(F.col("room") > 0, F.col("place")))
        nearest = free.select("place", F.coalesce(F.min("open").over(here), F.min("open").over(Window.partitionBy()))
                              .alias("to"))
        offer = (waiting.join(nearest, F.col("at") == F.col("place")).drop("place")
                 .join(free.select(F.col("place").alias("to"), "shard", "room", "used"), "to"))
        ahead = Window.partitionBy("shard").orderBy("arc", "lo").rowsBetween(Window.unboundedPreceding, -1)
        size = F.col("hi") - F.col("lo")
        offer = (offer.withColumn("ahead", F.coalesce(F.sum(size).over(ahead), F.lit(0)))
                 .withColumn("taken", F.greatest(F.least(size, F.col("room") - F.col("ahead")), F.lit(0))))
        step = reliable_checkpoint(offer.select(
            "arc", "lo", "hi", "shard", "taken", (F.col("used") + F.col("ahead")).alias("base"),
            F.pmod(F.col("to") + 1, F.lit(n_places)).alias("at")))
        settled.append(step.where("taken > 0").select(
            "arc", "lo", (F.col("lo") + F.col("taken")).alias("hi"), "shard", "base"))
        waiting = step.where("taken < hi - lo").select("arc", (F.col("lo") + F.col("taken")).alias("lo"), "hi", "at")
        if waiting.isEmpty():
            break
        taken = step.groupBy("shard").agg(F.sum("taken").alias("taken"))
        room = reliable_checkpoint(room.join(taken, "shard", "left").select(
            "shard", (F.col("room") - F.coalesce("taken", F.lit(0))).alias("room"),
            (F.col("used") + F.coalesce("taken", F.lit(0))).alias("used")))
    runs = settled[0]
    for more in settled[1:]:
        runs = runs.union(more)
    return runs


def shard(docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``id_col``, size, text_crc32, law, shard, slot, grown_shard per row."""
    spark = docs.sparkSession
    text = whole_text(text_col)
    key = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("null"), "size", "text_crc32")).otherwise(
        F.xxhash64(F.col(id_col)))
    places = reliable_checkpoint(ring(spark, shards, vnodes))
    arcs = F.broadcast(_arcs(places, spark))  # 2^RING_BITS rows
    keyed = (docs.select(F.col(id_col), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
                         F.crc32(text.cast("binary")).alias("text_crc32"))
             .groupBy(id_col, "size", "text_crc32").agg(F.count(F.lit(1)).alias("__n"))
             .withColumn("__hash", key)
             .withColumn("slot", F.shiftrightunsigned("__hash", 64 - RING_BITS).cast("int"))
             .join(arcs, "slot").drop("slot"))
    keyed = reliable_checkpoint(keyed)  # small rows: the texts are read once
    counts = reliable_checkpoint(keyed.groupBy("arc").agg(F.sum("__n").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    capacity = (spark.range(shards).select(F.col("id").cast("int").alias("shard"), total.alias("n"))
                .select("shard", (F.floor(F.col("n") / shards)
                                  + F.when(F.col("shard") < F.col("n") % shards, 1).otherwise(0)).alias("room")))
    runs = F.broadcast(bounded_loads(counts, places, capacity))  # at most shards * (vnodes + rounds) rows
    ahead = Window.partitionBy("arc").orderBy("__hash", id_col, "text_crc32", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    ranked = (keyed.withColumn("__first", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
              .withColumn("__rank", F.explode(F.sequence("__first", F.col("__first") + F.col("__n") - 1))))
    placed = ranked.join(runs, (ranked["arc"] == runs["arc"]) & (F.col("__rank") >= F.col("lo"))
                         & (F.col("__rank") < F.col("hi")))
    return placed.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                         (F.col("base") + F.col("__rank") - F.col("lo")).cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"))
