"""State of a batch: what is done, which attempt wins, what is written once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenqc.functions import scores, text
from lumenqc.operators import scale


def pending(items: DataFrame, cache: DataFrame, key: str = "key", fingerprint: str = "fp") -> DataFrame:
    """Items that the cache doesn't hold as done under the same fingerprint; ``cache`` has ``done``."""
    return items.join(cache.where("done").select(key, fingerprint), [key, fingerprint], "left_anti")


def insert_once(new: DataFrame, old: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``old`` and, of each key that it lacks, the first new row by the ascending columns ``order``; combined before the shuffle."""
    row = F.struct(*(c for c in new.columns if c != key))
    fresh = new.join(old.select(key), key, "left_anti").groupBy(key).agg(F.min_by(row, F.struct(*order)).alias("row")).select(key, "row.*")
    return old.unionByName(fresh)


def upsert(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key that is last by the columns ``order``; combined before the shuffle, so no key's rows meet in one place."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(*order)).alias("row")).select(key, "row.*").select(*rows.columns)


def best_match(left: DataFrame, right: DataFrame, on: str, ranks: list[Column]) -> DataFrame:
    """Left join that keeps, of each left row's partners, the first by ``ranks``, none of which is null.

    Of the partners of one value of ``on`` the best is found first, in partial aggregates, so the join adds no rows.
    """
    best = right.groupBy(on).agg(F.min_by(F.struct(*(c for c in right.columns if c != on)), F.struct(*ranks)).alias("best")).select(on, "best.*")
    return left.join(best, on, "left")


def winner(attempts: DataFrame, key: str, attempt: str, gate: Column, candidate: Column) -> DataFrame:
    """Of each ladder the first attempt that passed its gate, else the last that gave a candidate."""
    found = attempts.groupBy(key).agg(F.min(F.when(gate, F.col(attempt))).alias("passed"), F.max(F.when(candidate, F.col(attempt))).alias("last"), F.count(F.lit(1)).alias("attempts"))
    return found.select(key, F.coalesce("passed", "last").alias("winner"), F.col("passed").isNotNull().alias("gate_ok"), "attempts")


def so_far(attempts: DataFrame, key: str, attempt: str, flag: Column) -> DataFrame:
    """Whether ``flag`` has held in this attempt or an earlier one."""
    ladder = Window.partitionBy(key).orderBy(attempt).rowsBetween(Window.unboundedPreceding, 0)
    return attempts.withColumn("seen", F.max(flag.cast("int")).over(ladder) == 1)


def spent(attempts: DataFrame, key: str, attempt: str, gate: Column, seconds: Column) -> DataFrame:
    """Seconds of the attempts that ran: up to the first that passed, else all."""
    stop = attempts.groupBy(key).agg(F.min(F.when(gate, F.col(attempt))).alias("stop"))
    return attempts.join(stop, key).where(F.col("stop").isNull() | (F.col(attempt) <= F.col("stop"))).groupBy(key).agg(F.sum(seconds).alias("seconds"), F.count(F.lit(1)).alias("ran"))


def whole_sums(rows: DataFrame, group: str, value: str, order: list[str]) -> DataFrame:
    """A row per group: ``whole``, its sum of doubles as added one after another by ``order``, rounded down; nulls don't count.

    A sum's last bits hang on the order of adding. By any two orders it differs by less than n * 2**-52 times the sum of sizes, so
    the whole part is open only for sums that lie about that near to a whole number: only these groups' rows are added again in order,
    where a group's rows pass one task, sorted on disk if they are many. All other groups are combined before the shuffle.
    Rows that are equal in ``order`` are added by their value.
    """
    slack = F.count(value) * F.sum(F.abs(value)) * 2.0**-51
    sums = scale.written(rows.groupBy(group).agg(F.sum(value).alias("sum"), slack.alias("slack")), "sums")
    near = F.coalesce(F.abs(F.col("sum") - F.rint("sum")) <= F.col("slack"), F.lit(False))
    open_ones = sums.where(near).select(F.col(group).alias("c_group"))
    again = rows.join(F.broadcast(open_ones) if scale.few(open_ones, "c_group") else open_ones, rows[group].eqNullSafe(F.col("c_group")), "left_semi")
    ordered = Window.partitionBy(group).orderBy(*order, value).rowsBetween(Window.unboundedPreceding, 0)
    upto = again.select(group, F.sum(value).over(ordered).alias("upto"), F.count(F.lit(1)).over(ordered).alias("place"))
    added = upto.groupBy(group).agg(F.max_by("upto", "place").alias("sum"))
    return sums.where(~near).select(group, "sum").unionByName(added).select(group, F.floor("sum").alias("whole"))


def rolling_rate(items: DataFrame, group: str, order: list[str], seconds: str, size: int = 40) -> DataFrame:
    """The mean seconds of the last ``size`` items with a time over 0, how many remain, and the time that they will take."""
    placed = scale.numbered(items.where(F.col(seconds) > 0), group, order)
    timed = scale.last_rows(placed, group, size, lambda last: {"mean": F.avg(seconds).over(last)})
    return timed.withColumn("left", F.col("of") - F.col("place")).withColumns({"eta": F.col("mean") * F.col("left"), "per_minute": 60.0 / F.col("mean")}).drop("place", "of")


def timing(state: DataFrame) -> DataFrame:
    """Seconds an item, time left and items a minute of a batch: (total, processed, edited, elapsed, mean_edit, ...).

    By the mean of the last edits if there were any, else by all edited items, else by all processed ones; nothing done gives zeros.
    """
    done, left = F.col("processed"), F.greatest(F.lit(0), F.col("total") - F.col("processed"))
    by = lambda n: (F.col(n) > 0) & (F.col("elapsed") > 0)
    each = F.when(F.col("mean_edit").isNotNull(), F.col("mean_edit")).when(by("edited"), F.col("elapsed") / F.col("edited")).when(by("processed"), F.col("elapsed") / done).otherwise(0.0)
    timed = state.withColumns({"remaining": left, "per_item": each}).withColumns({"eta": F.col("remaining") * F.col("per_item"), "per_minute": F.when(F.col("per_item") > 0, 60.0 / F.col("per_item")).otherwise(0.0)})
    return timed.withColumn("eta_text", F.when(done > 0, scores.duration(F.col("eta"))).otherwise("--:--"))


def progress(items: DataFrame, group: str, order: list[str]) -> DataFrame:
    """How much of the group is done with each row, in percent."""
    return scale.numbered(items, group, order).withColumn("percent", 100.0 * F.col("place") / F.col("of")).drop("place", "of")


def largest_until(parts: DataFrame, group: str, size: str, key: str, share: float, most: int) -> DataFrame:
    """The largest parts of a group, until they have crossed ``share`` of it, ``most`` at the most."""
    ordered = Window.partitionBy(group).orderBy(F.desc(size), key)
    before = F.coalesce(F.sum(size).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = parts.withColumns({"rank": F.row_number().over(ordered), "before": before, "whole": F.sum(size).over(Window.partitionBy(group))})
    return ranked.where((F.col("rank") <= most) & (F.col("before") < share * F.col("whole")))


def every_kth(items: DataFrame, group: str, order: list[str], take: int) -> DataFrame:
    """A systematic sample of each group: every k-th row in order, ``take`` at the most, where k is the group's rows by ``take``."""
    at, step = F.col("place") - 1, F.greatest(F.lit(1), F.floor(F.col("of") / take))
    return scale.numbered(items, group, order).where((at % step == 0) & (at / step < take)).drop("place", "of")


def ids_of(*columns: tuple[DataFrame, str]) -> DataFrame:
    """The distinct non-empty ids of several places."""
    out = None
    for df, name in columns:
        one = df.select(F.trim(F.col(name).cast("string")).alias("id")).where(F.col("id") != "")
        out = one if out is None else out.union(one)
    return out.distinct()


def with_ids(files: DataFrame, path: str = "path") -> DataFrame:
    """Stable id and normalised path of each file."""
    return files.withColumns({"id": text.stable_id(F.col(path)), "normal_path": text.normal_path(F.col(path))})
