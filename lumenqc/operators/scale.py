"""Ranks and quantiles of groups of any size: exact, without a group's rows ever meeting in one task.

Rows are sorted once by group and order into ranges of about equal size, whatever the groups are, and written with their places.
A group's rows in a range are counted, and a row's rank is its place in the range plus the group's rows in the ranges before.
The table of these counts has at most a row a group and one more a range; it is broadcast only if it was measured to be small.
For quantiles equal values count as one, weighted, so a value that holds a third of all rows is one row.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenqc.operators.shared import shared_path

#: Counts of ranges, and groups to look up, are broadcast up to so many rows and characters of group names; others are joined by shuffle.
FEW_ROWS, FEW_CHARACTERS = 200_000, 10_000_000


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a table in the shared folder, so that later steps see the same ranges even after a loss."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def few(table: DataFrame, group: str) -> bool:
    """Whether ``table``, which is written, has so few rows and characters of group names that it may be broadcast."""
    n, characters = table.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.col(group).cast("string"))), F.lit(0))).first()
    return n <= FEW_ROWS and characters <= FEW_CHARACTERS


def ranged(rows: DataFrame, keys: list[str], parts: int | None) -> DataFrame:
    """``rows`` sorted by ``keys`` over all ranges, with ``at``, which ascends in that order, and the range's number ``part``."""
    cut = rows.repartitionByRange(*([parts] if parts else []), *keys).sortWithinPartitions(*keys)
    # the id has the range's number in its upper bits and the place in the range in its lower 33
    return written(cut.withColumn("at", F.monotonically_increasing_id()), "ranges").withColumn("part", F.shiftright("at", 33))


def with_counts(cut: DataFrame, group: str, weight: Column) -> DataFrame:
    """``cut`` with, by group and range, the ``first`` place, the ``own`` weight, that of ``earlier`` ranges and ``of`` the group."""
    counts = cut.groupBy(group, "part").agg(F.min("at").alias("first"), F.sum(weight).alias("own"))
    whole = Window.partitionBy(group)  # a row a range
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"earlier": F.coalesce(F.sum("own").over(before), F.lit(0)), "of": F.sum("own").over(whole)})
    counts = written(counts.withColumnsRenamed({group: "c_group", "part": "c_part"}), "counts")
    same = cut[group].eqNullSafe(counts["c_group"]) & (cut["part"] == counts["c_part"])
    return cut.join(F.broadcast(counts) if few(counts, "c_group") else counts, same).drop("c_group", "c_part")


def numbered(rows: DataFrame, group: str, order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with their ``place`` in the group by ``order``, from 1, and how many the group is ``of``.

    ``order`` should tell a group's rows apart: equal ones stay in one range, in any order.  Nulls go first.
    """
    placed = with_counts(ranged(rows, [group, *order], parts), group, F.lit(1))
    return placed.withColumn("place", F.col("at") - F.col("first") + F.col("earlier") + 1).drop("at", "part", "first", "own", "earlier")


def last_rows(placed: DataFrame, group: str, size: int, made: Callable[[Window], dict[str, Column]], block: int = 10_000) -> DataFrame:
    """Columns over each row and the ``size`` - 1 rows before it in ``placed``, which ``numbered`` gave.

    Blocks of places are treated apart; the last rows of a block are also carried to the next, where they only go before others.
    """
    own = F.floor((F.col("place") - 1) / block)
    carried = (F.col("place") - 1) % block >= block - (size - 1)
    copies = placed.withColumn("block", F.explode(F.when(carried, F.array(own, own + 1)).otherwise(F.array(own))))
    window = Window.partitionBy(group, "block").orderBy("place").rowsBetween(-(size - 1), 0)
    return copies.withColumns(made(window)).where(F.col("block") == own).drop("block")


def quantiles(rows: DataFrame, group: str, value: str, ranks: dict[str, Callable[[Column], Column]], parts: int | None = None) -> DataFrame:
    """A row per group: the values at ranks, from 1, that are given by how many values the group has; nulls don't count.

    Only ranges that hold a wanted rank are summed up value by value.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    cut = with_counts(ranged(counts, [group, value], parts), group, F.col("n"))
    held = [(F.col("earlier") < rank(F.col("of"))) & (rank(F.col("of")) <= F.col("earlier") + F.col("own")) for rank in ranks.values()]
    within = Window.partitionBy(group, "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    upto = cut.where(reduce(Column.__or__, held)).withColumn("upto", F.sum("n").over(within) + F.col("earlier"))
    return upto.groupBy(group).agg(*(F.min(F.when(F.col("upto") >= rank(F.col("of")), F.col(value))).alias(name) for name, rank in ranks.items()))


def interpolated(name: str, share: float) -> tuple[dict[str, Callable[[Column], Column]], Callable[[Column], Column]]:
    """Ranks below and above a quantile, and the quantile from their values and the number of values."""
    at = lambda n: (n - 1) * share
    low, high = f"{name}_low", f"{name}_high"
    return {low: lambda n: F.floor(at(n)) + 1, high: lambda n: F.ceil(at(n)) + 1}, lambda n: F.col(low) + (F.col(high) - F.col(low)) * (at(n) - F.floor(at(n)))
