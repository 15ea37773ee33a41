"""Replace the items of a list column by the values of a table, text by text.

A table of at most ``MAX_ITEMS`` rows is broadcast and each batch of lists is
rewritten where it is: no list is shuffled.  A larger one is joined to the
distinct items of each list, of which only those found travel, and comes back
as one map a row.  Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.session import reliable_checkpoint, written_table

MAX_ITEMS = 500_000  # rows of a broadcast table


def replace_items(df: DataFrame, list_col: str, table: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """``df`` with each item of ``list_col`` (array of strings) replaced by its
    ``value`` in ``table`` (item, value), or left as it is.

    Of several values of an item the smallest counts; null items, lists and
    values are left alone; repeated rows stay repeated."""
    listed = reliable_checkpoint(table.where("item IS NOT NULL AND value IS NOT NULL")
                                 .groupBy("item").agg(F.min("value").alias("value")))
    if listed.count() > max_items:
        return _joined(df, list_col, listed)
    rows = listed.collect()
    if not rows:
        return df
    known = df.sparkSession.sparkContext.broadcast(
        (pa.array([r["item"] for r in rows], pa.string()), pa.array([r["value"] for r in rows], pa.string())))
    place = df.columns.index(list_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, values = known.value
        for batch in batches:
            column = batch.column(place)
            flat = pc.list_flatten(column)
            at = pc.index_in(flat, value_set=items.cast(flat.type))
            flat = pc.coalesce(values.cast(flat.type).take(at), flat)
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(column), 0))
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
            lists = pa.ListArray.from_arrays(offsets, flat, mask=pc.is_null(column))
            yield pa.RecordBatch.from_arrays(
                [lists if i == place else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # mapInArrow takes no names with dots
    return plain.mapInArrow(rewrite, plain.schema).toDF(*df.columns)


def _joined(df: DataFrame, list_col: str, listed: DataFrame) -> DataFrame:
    rows = written_table(df.withColumn("__row", F.monotonically_increasing_id()))
    found = (rows.select("__row", F.explode(F.array_distinct(list_col)).alias("item")).join(listed, "item")
             .groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("item", "value"))).alias("__found")))
    both = rows.join(found, "__row", "left")
    new = F.when(F.col("__found").isNull(), F.col(list_col)).otherwise(
        F.transform(list_col, lambda t: F.coalesce(F.try_element_at("__found", t), t)))
    return both.select(*[new.alias(c) if c == list_col else F.col(f"`{c}`") for c in df.columns])
