"""Analytics over decisions, tags and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenqc.operators import scale


#: Under this name a map of timings also counts its item.
ITEMS = "\0items"


def tag_counts(items: DataFrame, group: str, tags: Column, most: int | None = None) -> DataFrame:
    """How often each tag occurs in each group, by (-count, tag); the ``most`` first of a group, or all."""
    counted = items.select(group, F.explode_outer(tags).alias("tag")).where(F.col("tag").isNotNull()).groupBy(group, "tag").agg(F.count(F.lit(1)).alias("n"))
    place = Window.partitionBy(group).orderBy(F.desc("n"), "tag")  # a row a tag
    ranked = counted.withColumn("rank", F.row_number().over(place))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def summary(items: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, median, minimum and maximum of a value by group."""
    at = items.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    ranks, median = scale.interpolated("median", 0.5)
    return with_quantiles(at, items, group, value, ranks).select(group, "n", "mean", median(F.col("n")).alias("median"), "least", "most")


def with_quantiles(at: DataFrame, items: DataFrame, group: str, value: str, ranks: dict) -> DataFrame:
    """A row per group joined with the values at ``ranks``; groups without a value have nulls there."""
    found = scale.quantiles(items, group, value, ranks).withColumnRenamed(group, "q_group")
    return at.join(found, at[group].eqNullSafe(found["q_group"]), "left").drop("q_group")


def co_occurrence(items: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """In how many rows each pair of rules holds; the pair of a rule with itself is its own count."""
    names = list(rules)
    wide = items.agg(*(F.count_if(rules[a] & rules[b]).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j))
    pairs = F.array(*(F.struct(F.lit(a).alias("rule_a"), F.lit(b).alias("rule_b"), F.col(f"{i}_{j}").alias("n")) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j))
    return wide.select(F.explode(pairs).alias("p")).select("p.*")


def transitions(items: DataFrame, old: str, new: str, states: list[str]) -> DataFrame:
    """A row per old state, a column per new one, and how many changed."""
    counts = [F.count_if(F.col(new) == s).alias(s) for s in states]
    return items.groupBy(F.col(old).alias("old")).agg(*counts, F.count_if(F.col(old) != F.col(new)).alias("flips"))


def confusion(items: DataFrame, good: Column, passed: Column) -> DataFrame:
    """Counts of good and bad items that passed or not, and accuracy (of one item at least)."""
    counts = items.agg(F.count_if(good & passed).alias("good_pass"), F.count_if(good & ~passed).alias("good_caught"), F.count_if(~good & passed).alias("bad_pass"), F.count_if(~good & ~passed).alias("bad_caught"))
    n = F.col("good_pass") + F.col("good_caught") + F.col("bad_pass") + F.col("bad_caught")
    return counts.withColumn("accuracy", (F.col("good_pass") + F.col("bad_caught")) / F.greatest(n, F.lit(1)))


def stage_profile(timings: DataFrame, stage: str, seconds: str) -> DataFrame:
    """Mean, median and three kinds of 95th percentile: interpolated, nearest rank, and the rank cut down."""
    at = timings.groupBy(stage).agg(F.count(seconds).alias("n"), F.avg(seconds).alias("mean"), F.min(seconds).alias("least"), F.max(seconds).alias("most"))
    (ranks, median), (p95_ranks, p95) = scale.interpolated("median", 0.5), scale.interpolated("p95", 0.95)
    ranks |= p95_ranks | {
        "p95_nearest": lambda n: F.least(n, F.greatest(F.lit(1), F.round(0.95 * (n - 1)) + 1)),
        "p95_cut": lambda n: F.greatest(F.lit(1), F.floor(0.95 * n)),
    }
    n = F.col("n")
    return with_quantiles(at, timings, stage, seconds, ranks).select(stage, "n", "mean", p95(n).alias("p95"), median(n).alias("median"), "least", "most", "p95_nearest", "p95_cut")


def stage_means(items: DataFrame, timings: str, part: str) -> DataFrame:
    """From a map of stage seconds an item: sum and mean by stage over items with any timing, and ``part``'s share of all in percent."""
    number = F.map_filter(F.transform_values(timings, lambda _, v: v.try_cast("double")), lambda _, v: v.isNotNull())  # what isn't a number doesn't count
    parts = items.select(number.alias("timings")).where(F.size("timings") > 0).select(F.explode(F.map_concat("timings", F.create_map(F.lit(ITEMS), F.lit(1.0)))).alias("stage", "seconds"))
    sums = parts.groupBy("stage").agg(F.sum("seconds").alias("seconds"))
    total = Window.partitionBy(F.lit(1))  # a row a stage
    over = lambda x: F.sum(x).over(total)
    made = sums.select(
        "stage", "seconds", (F.col("seconds") / over(F.when(F.col("stage") == ITEMS, F.col("seconds")))).alias("mean"),
        (100.0 * over(F.when(F.col("stage") == part, F.col("seconds"))) / over(F.when(F.col("stage") != ITEMS, F.col("seconds")))).alias("part_percent"),
    )
    return made.where(F.col("stage") != ITEMS)


def production(items: DataFrame, status: str, statuses: list[str], attempted: list[str]) -> DataFrame:
    """Counts by status and their share, in percent, of the attempted items, or of all if none was attempted."""
    counts = items.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses))
    tried = sum((F.col(f"n_{s}") for s in attempted), F.lit(0))
    base = F.when(tried > 0, tried).otherwise(F.greatest("total", F.lit(1)))
    return counts.select("total", *(f"n_{s}" for s in statuses), *((100.0 * F.col(f"n_{s}") / base).alias(f"percent_{s}") for s in statuses))


def alarms(items: DataFrame, window: Column, review: Column, passed: Column, least: int = 8, reviews: float = 0.90, passes: float = 0.05) -> DataFrame:
    """Windows with at least ``least`` items of which too many go to review and too few pass."""
    rates = items.groupBy(window.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.avg(review.cast("double")).alias("review_rate"), F.avg(passed.cast("double")).alias("pass_rate"))
    return rates.withColumn("alarm", (F.col("n") >= least) & (F.col("review_rate") > reviews) & (F.col("pass_rate") < passes))


def bench_summary(rows: DataFrame, seconds: str, rescued: Column, status: str, statuses: list[str]) -> DataFrame:
    """A run as one row: how many, mean, median and 95th percentile of the seconds, the rescue rate and counts by status."""
    one = rows.withColumn("run", F.lit(0))
    at = one.groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.count(seconds).alias("n"), F.avg(seconds).alias("mean"), F.count_if(rescued).alias("rescued"), *(F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses))
    (ranks, p50), (p95_ranks, p95) = scale.interpolated("p50", 0.5), scale.interpolated("p95", 0.95)
    found, n = with_quantiles(at, one, "run", seconds, ranks | p95_ranks), F.col("n")
    return found.select(F.col("rows").alias("n"), "mean", p50(n).alias("p50"), p95(n).alias("p95"), (F.col("rescued") / F.greatest("rows", F.lit(1))).alias("rescue_rate"), *(f"n_{s}" for s in statuses))


def flips(items: DataFrame, old: str, new: str, was: str, now: str, order: list[Column], most: int = 8) -> DataFrame:
    """The first items, for a report, whose decision went from ``was`` to ``now``."""
    return best_of(items, (F.col(old) == was) & (F.col(new) == now), order, most)


def engine_summary(rows: DataFrame, engine: str, ok: Column, seconds: str) -> DataFrame:
    """By engine: rows that worked, their mean seconds, the peak, and the accept rate."""
    return rows.groupBy(engine).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.avg(F.when(ok, F.col(seconds))).alias("mean_ok"), F.max(seconds).alias("peak"), (F.count_if(ok) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("accept_rate")
    )


def best_of(items: DataFrame, where: Column, order: list[Column], most: int) -> DataFrame:
    """A report of the first rows that pass ``where``: sorted in part by each task, never as a whole."""
    return items.where(where).orderBy(*order).limit(most)


def by_variant(rows: DataFrame, key: str, variant: str, variants: list[str], value: str) -> DataFrame:
    """A row an item with a column a variant, and what the last differs from the first by."""
    wide = rows.groupBy(key).agg(*(F.max(F.when(F.col(variant) == v, F.col(value))).alias(v) for v in variants))
    return wide.withColumn("change", F.col(variants[-1]) - F.col(variants[0]))


def first_seen(rows: DataFrame, value: str, position: Column) -> DataFrame:
    """The distinct values, with the position at which each was first."""
    return rows.groupBy(value).agg(F.min(position).alias("first"))
