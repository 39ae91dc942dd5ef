"""Ordered, distinct tag lists as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Tags = Column


def none() -> Tags:
    return F.array().cast("array<string>")


def listed(x: Column) -> Tags:
    """``x``, or an empty list for null."""
    return F.coalesce(x, none())


def collected(*lists: Column) -> Tags:
    """The distinct tags of all lists, in order; null lists count as empty."""
    return F.array_distinct(F.concat(*map(listed, lists)))


def without(tags: Tags, other: Tags) -> Tags:
    return F.array_except(tags, other)


def has(tags: Tags, *any_of: str) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, any_of))) if len(any_of) > 1 else F.array_contains(tags, any_of[0])


def added(tags: Tags, tag: str, when: Column | None = None) -> Tags:
    """``tags`` with ``tag`` at the end, if it isn't there yet."""
    missing = ~F.array_contains(tags, tag)
    return F.when(missing if when is None else when & missing, F.array_append(tags, F.lit(tag))).otherwise(tags)


def removed(tags: Tags, tag: str, when: Column | None = None) -> Tags:
    out = F.array_remove(tags, F.lit(tag))
    return out if when is None else F.when(when, out).otherwise(tags)


def raised(*rules: tuple[Column, str]) -> Tags:
    """The tags whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in rules))) if rules else none()


def first_of(order: list[str], tags: Tags) -> Column:
    """The first tag of ``order`` that is in ``tags``, else null."""
    return F.get(F.array_intersect(F.array(*map(F.lit, order)), tags), F.lit(0))
