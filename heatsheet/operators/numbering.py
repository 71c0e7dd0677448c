"""Consecutive numbers without sorting an unbounded group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heatsheet.operators.lineage import stable

# Most rows of one group that a single task may have to sort in number_within.
CHUNK_KEYS = 1 << 20

# monotonically_increasing_id keeps the partition in the upper bits and the row in these.
_ROW_BITS = 33


def number_rows(
    df: DataFrame, order: list[Column], name: str, partitions: int | None = None
) -> DataFrame:
    """Add ``name``: 1, 2, 3, ... over the whole of ``df`` in the given order.

    The order must be total (end in a unique column): equal rows cannot be split.
    Rows are range-partitioned and sorted inside each partition, then numbered as
    (rows in earlier partitions) + (row inside the partition). Only the per-partition
    counts meet in one task: one row for each shuffle partition. The sorted rows are
    checkpointed, so a recomputed range boundary cannot change the numbers.
    """
    ranged = (
        df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    )
    place = F.monotonically_increasing_id()
    placed = stable(
        ranged.sortWithinPartitions(*order)
        .withColumn("_place", place)
        .withColumn("_part", F.shiftright("_place", _ROW_BITS))
        .withColumn("_row", F.col("_place") - F.shiftleft("_part", _ROW_BITS))
        .drop("_place")
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_row") + 1)
        .drop("_part", "_row", "_before")
    )


def number_within(
    df: DataFrame, group: list[str], key: str, name: str, chunk_keys: int = CHUNK_KEYS
) -> DataFrame:
    """Add ``name``: 1, 2, 3, ... inside each group, ordered by a unique integer key.

    The key's range is cut into chunks: rows are numbered inside (group, chunk), at most
    ``chunk_keys`` of them even when one group has a third of the table, and shifted by the
    pre-aggregated size of the group's earlier chunks. No job runs while the plan is made.
    """
    chunked = df.withColumn("_chunk", F.col(key) - F.pmod(F.col(key), F.lit(chunk_keys)))
    inside = Window.partitionBy(*group, "_chunk").orderBy(key)
    earlier = (
        Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        chunked.groupBy(*group, "_chunk")
        .agg(F.count("*").alias("_size"))
        .select(*group, "_chunk", F.sum("_size").over(earlier).alias("_before"))
        .filter(F.col("_before") > 0)
    )
    return (
        chunked.withColumn("_inside", F.row_number().over(inside))
        .join(shifts, [*group, "_chunk"], "left")
        .withColumn(name, F.col("_inside") + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_chunk", "_inside", "_before")
    )
