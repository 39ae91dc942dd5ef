"""Neighbourhood operations on square rasters in array columns (row by row), without a shuffle and without Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CROSS = ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
SQUARE = tuple((y, x) for y in (-1, 0, 1) for x in (-1, 0, 1))


def let(value: Column, body) -> Column:
    """``body(value)`` with value evaluated once a row: else the optimiser may move its expression into a loop over pixels."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pixels(side: int, body) -> Column:
    """An array of ``body(y, x)`` over all pixels."""
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: body(F.floor(i / side).cast("int"), (i % side).cast("int")))


def edge(raster: Column, side: int, y: Column, x: Column) -> Column:
    """The pixel at (y, x); outside, the nearest one inside."""
    inside = lambda k: F.greatest(F.lit(0), F.least(F.lit(side - 1), k))
    return F.get(raster, (inside(y) * side + inside(x)).cast("int"))


def outside(raster: Column, side: int, y: Column, x: Column, value: float) -> Column:
    """The pixel at (y, x); outside, ``value``."""
    return F.when(y.between(0, side - 1) & x.between(0, side - 1), F.get(raster, (y * side + x).cast("int"))).otherwise(F.lit(value))


def gradient(raster: Column, side: int) -> Column:
    """Magnitude of central differences; the border is repeated."""

    def at(y: Column, x: Column) -> Column:
        gx, gy = (edge(raster, side, y, x + 1) - edge(raster, side, y, x - 1)) * 0.5, (edge(raster, side, y + 1, x) - edge(raster, side, y - 1, x)) * 0.5
        return F.sqrt(gx * gx + gy * gy)

    return pixels(side, at)


def box_mean(raster: Column, side: int, size: int = 3) -> Column:
    k = range(-(size // 2), size // 2 + 1)
    return pixels(side, lambda y, x: sum((edge(raster, side, y + a, x + b) for a in k for b in k), F.lit(0.0)) / (size * size))


def local_std(raster: Column, side: int, size: int = 3) -> Column:
    squares = F.transform(raster, lambda v: v * v)
    return F.zip_with(box_mean(raster, side, size), box_mean(squares, side, size), lambda m, q: F.sqrt(F.greatest(F.lit(0.0), q - m * m)))


def dilated(mask: Column, side: int, shape: Sequence[tuple[int, int]] = CROSS) -> Column:
    """1 where a neighbour is 1; outside counts as 0."""
    return pixels(side, lambda y, x: F.greatest(*(outside(mask, side, y + a, x + b, 0.0) for a, b in shape)))


def eroded(mask: Column, side: int, shape: Sequence[tuple[int, int]] = CROSS) -> Column:
    """1 where all neighbours are 1; outside counts as 0."""
    return pixels(side, lambda y, x: F.least(*(outside(mask, side, y + a, x + b, 0.0) for a, b in shape)))


def opened(mask: Column, side: int, shape: Sequence[tuple[int, int]] = CROSS) -> Column:
    return let(eroded(mask, side, shape), lambda m: dilated(m, side, shape))


def closed(mask: Column, side: int, shape: Sequence[tuple[int, int]] = CROSS) -> Column:
    return let(dilated(mask, side, shape), lambda m: eroded(m, side, shape))


def components(mask: Column, side: int, shape: Sequence[tuple[int, int]] = CROSS) -> Column:
    """A label a pixel: the largest place (from 1) that its component holds; 0 off the mask.

    Labels spread by a pixel a round and then jump to the label of their label's pixel, so rounds halve the way left; the number of
    rounds is bounded by the longest path that a raster of this size can hold.
    """

    def spread(labels: Column) -> Column:
        return pixels(side, lambda y, x: F.when(edge(labels, side, y, x) > 0, F.greatest(*(outside(labels, side, y + a, x + b, 0.0) for a, b in shape))).otherwise(0.0))

    def jump(labels: Column) -> Column:
        return F.transform(labels, lambda v: F.when(v > 0, F.get(labels, (v - 1).cast("int"))).otherwise(0.0))

    first = let(mask, lambda m: pixels(side, lambda y, x: F.when(edge(m, side, y, x) >= 1, (y * side + x + 1).cast("double")).otherwise(0.0)))
    rounds = F.sequence(F.lit(1), F.lit(side * side // 2 + 1))
    again = lambda labels: let(spread(labels), jump)
    # a settled raster is passed on as it is
    state = F.aggregate(
        rounds, F.struct(first.alias("now"), F.lit(False).alias("done")),
        lambda s, _: F.when(s["done"], s).otherwise(let(again(s["now"]), lambda n: F.struct(n.alias("now"), (n == s["now"]).alias("done")))),
    )
    return state["now"]


def sizes(labels: Column) -> Column:
    """The components' sizes, the largest first."""
    kinds = F.array_distinct(F.filter(labels, lambda v: v > 0))
    return F.reverse(F.array_sort(F.transform(kinds, lambda k: F.size(F.filter(labels, lambda v: v == k)))))


def filled(mask: Column, side: int) -> Column:
    """The mask with its holes: background that doesn't reach the border."""
    framed = side + 2
    around = let(mask, lambda m: pixels(framed, lambda y, x: F.lit(1.0) - outside(m, side, y - 1, x - 1, 0.0)))
    return let(components(around, framed), lambda b: pixels(side, lambda y, x: F.when(edge(b, framed, y + 1, x + 1) == F.get(b, F.lit(0)), 0.0).otherwise(1.0)))


def border_share(mask: Column, side: int) -> Column:
    """The share of the frame's pixels that are on the mask."""
    on = let(mask, lambda m: pixels(side, lambda y, x: F.when((y.isin(0, side - 1) | x.isin(0, side - 1)) & (edge(m, side, y, x) >= 1), 1.0).otherwise(0.0)))
    return F.aggregate(on, F.lit(0.0), lambda a, v: a + v) / (4 * side - 4)


def box(mask: Column, side: int) -> Column:
    """First and last row and column of the mask, named; null for an empty one."""
    on = let(mask, lambda m: F.filter(pixels(side, lambda y, x: F.when(edge(m, side, y, x) >= 1, F.struct(y.alias("y"), x.alias("x")))), lambda p: p.isNotNull()))

    def bounds(on: Column) -> Column:
        ys, xs = F.transform(on, lambda p: p["y"]), F.transform(on, lambda p: p["x"])
        return F.when(F.size(on) > 0, F.struct(F.array_min(ys).alias("top"), F.array_max(ys).alias("bottom"), F.array_min(xs).alias("left"), F.array_max(xs).alias("right")))

    return let(on, bounds)
