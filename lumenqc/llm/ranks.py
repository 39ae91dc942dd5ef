"""Exact ranks in groups of any size: rows are cut into ranges of equal size, numbered there, and offset by what earlier ranges hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenqc.llm.common import is_small, written


def ranked(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with their ``rank`` (from 0) in the order of ``order``, nulls first, among those of the same ``group``.

    ``rows`` should be narrow: they are written, sorted by range once and written again.  Equal rows are told apart by where they
    were written, so that a group of copies doesn't stay in one range.  Group columns must not be null.  Nothing is gathered: the
    table of offsets has a row for a group in a range.
    """
    salted = written(rows.withColumn("_salt", F.monotonically_increasing_id()), f"{name}-rows")
    keys = [*group, *order, "_salt"]
    sorted_rows = salted.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the id holds the range's number in its upper bits and the place in the range in its lower 33
    ranges = written(sorted_rows.withColumn("_at", F.monotonically_increasing_id()).drop("_salt"), f"{name}-ranges")
    ranges = ranges.withColumn("_range", F.shiftright("_at", 33))
    counts = ranges.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    offsets = written(offsets, f"{name}-offsets")
    placed = ranges.join(F.broadcast(offsets) if is_small(offsets) else offsets, [*group, "_range"])
    return placed.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_range", "_first", "_before")
