"""Measures of small rasters held as array columns: no Python, no explosion of pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def share(x: Column, test) -> Column:
    """The share of the pixels that pass ``test``."""
    return F.size(F.filter(x, test)) / F.greatest(F.size(x), F.lit(1))


def mean_where(x: Column, test, otherwise: float = 0.0) -> Column:
    kept = F.filter(x, test)
    return F.when(F.size(kept) > 0, total(kept) / F.size(kept)).otherwise(otherwise)


def iou(a: Column, b: Column, threshold: float) -> Column:
    """Intersection over union of two masks."""
    both = F.zip_with(a, b, lambda x, y: F.when((x >= threshold) & (y >= threshold), 1.0).otherwise(0.0))
    either = F.zip_with(a, b, lambda x, y: F.when((x >= threshold) | (y >= threshold), 1.0).otherwise(0.0))
    return total(both) / F.greatest(total(either), F.lit(1.0))


def mean_difference(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.greatest(F.size(a), F.lit(1))


def cells(x: Column, side: int, cell: int) -> Column:
    """The mean of each cell x cell square of a side x side raster, row by row."""
    n = side // cell
    inside = lambda i: F.transform(F.sequence(F.lit(0), F.lit(cell * cell - 1)), lambda k: F.get(x, (F.floor(i / n) * cell + F.floor(k / cell)) * side + (i % n) * cell + k % cell))
    return F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: total(inside(i)) / (cell * cell))


def survival(raw: Column, final: Column, keep: float) -> tuple[Column, Column]:
    """Of the cells with evidence in ``raw``: the share that is kept in ``final``, and how many are lost."""
    pairs = F.filter(F.zip_with(raw, final, lambda r, f: F.struct(r.alias("r"), f.alias("f"))), lambda p: p["r"] > 0)
    lost = F.size(F.filter(pairs, lambda p: p["f"] < keep * p["r"]))
    return 1.0 - lost / F.greatest(F.size(pairs), F.lit(1)), lost


def corner_share(x: Column, side: int, corner: int, bar: float) -> Column:
    """The share of the first corner's pixels that reach ``bar``."""
    inside = F.filter(F.transform(x, lambda v, i: F.when((F.floor(i / side) < corner) & (i % side < corner), v)), lambda v: v.isNotNull())
    return share(inside, lambda v: v >= bar)
