"""Filters of rasters held as array columns, row after row: one-dimensional steps, applied to the rows and then to the columns.

A raster of ``height`` x ``width`` is an array of numbers; beyond its border the nearest pixel counts.  No Python runs and nothing is
shuffled.  A null raster gives null.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenqc.functions.neighbourhood import let

Line = Callable[[Column], Column]


def turned(raster: Column, height: int, width: int) -> Column:
    """Rows become columns."""
    places = F.sequence(F.lit(0), F.lit(height * width - 1))
    return F.when(raster.isNotNull(), F.transform(places, lambda i: F.get(raster, (i % height * width + F.floor(i / height)).cast("int"))))


def by_rows(raster: Column, height: int, width: int, step: Line) -> Column:
    starts = F.sequence(F.lit(0), F.lit(height - 1))
    return F.when(raster.isNotNull(), F.flatten(F.transform(starts, lambda y: let(F.slice(raster, y * width + 1, F.lit(width)), step))))


def by_both(raster: Column, height: int, width: int, step: Line) -> Column:
    """``step`` along the rows and then along the columns; a line keeps its length."""
    rows = lambda x: by_rows(x, height, width, step)
    columns = lambda x: by_rows(x, width, height, step)
    across = let(raster, rows)
    down = let(let(across, lambda x: turned(x, height, width)), columns)
    return let(down, lambda x: turned(x, width, height))


def nearest(line: Column, at: Column) -> Column:
    return F.get(line, F.greatest(F.lit(0), F.least(F.size(line) - 1, at)))


# ---- weights


def weighted(taps: list[float]) -> Line:
    """The sum of the neighbours by ``taps``, an odd number of weights."""
    middle = len(taps) // 2

    def step(line: Column) -> Column:
        near = lambda i: sum((w * nearest(line, i + (k - middle)) for k, w in enumerate(taps)), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.size(line) - 1), near)

    return step


def gaussian_taps(sigma: float, truncate: float = 4.0) -> list[float]:
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


def gaussian(raster: Column, height: int, width: int, sigma: float) -> Column:
    return by_both(raster, height, width, weighted(gaussian_taps(sigma)))


# ---- windows


def prefix_sums(line: Column) -> Column:
    """Sums of the first 0, 1, 2, ... values."""
    return F.aggregate(line, F.array(F.lit(0.0)), lambda sums, v: F.array_append(sums, F.element_at(sums, -1) + v))


def windowed(radius: int) -> Line:
    """The mean of each window, as a difference of two prefix sums: the cost doesn't depend on the radius."""

    def step(line: Column) -> Column:
        last = F.size(line) - 1

        def means(sums: Column) -> Column:
            def mean(i: Column) -> Column:
                inside = F.get(sums, F.least(i + radius, last) + 1) - F.get(sums, F.greatest(i - radius, F.lit(0)))
                before = F.greatest(F.lit(0), radius - i) * F.get(line, F.lit(0))
                after = F.greatest(F.lit(0), i + radius - last) * F.get(line, last)
                return (inside + before + after) / (2 * radius + 1)

            return F.transform(F.sequence(F.lit(0), last), mean)

        return let(prefix_sums(line), means)

    return step


def box_mean(raster: Column, height: int, width: int, radius: int) -> Column:
    return by_both(raster, height, width, windowed(radius))


def local_std(raster: Column, height: int, width: int, radius: int = 2) -> Column:
    mean = box_mean(raster, height, width, radius)
    squares = box_mean(F.transform(raster, lambda v: v * v), height, width, radius)
    return F.zip_with(mean, squares, lambda m, q: F.sqrt(F.greatest(F.lit(0.0), q - m * m)))


def extreme(radius: int, pick: Callable[[Column], Column]) -> Line:
    window = lambda line, i: F.slice(line, F.greatest(F.lit(0), i - radius) + 1, F.least(i, F.lit(radius)) + radius + 1)
    return lambda line: F.transform(line, lambda _, i: pick(window(line, i)))


def maximum(raster: Column, height: int, width: int, radius: int) -> Column:
    return by_both(raster, height, width, extreme(radius, F.array_max))


def minimum(raster: Column, height: int, width: int, radius: int) -> Column:
    return by_both(raster, height, width, extreme(radius, F.array_min))


def guided(guide: Column, source: Column, height: int, width: int, radius: int = 4, eps: float = 1e-4) -> Column:
    """The guided filter: in each window ``source`` is fitted by a line in ``guide``, and the lines of all windows over a pixel are averaged."""
    mean = lambda x: box_mean(x, height, width, radius)
    times = lambda x, y: F.zip_with(x, y, lambda a, b: a * b)

    def fitted(m: Column) -> Column:
        """Slope and offset of each window."""
        cells = F.arrays_zip(m["i"].alias("i"), m["p"].alias("p"), m["ii"].alias("ii"), m["ip"].alias("ip"))

        def line(c: Column) -> Column:
            slope = (c["ip"] - c["i"] * c["p"]) / (F.greatest(F.lit(0.0), c["ii"] - c["i"] * c["i"]) + eps)
            return F.struct(slope.alias("a"), (c["p"] - slope * c["i"]).alias("b"))

        return F.transform(cells, line)

    moments = F.struct(mean(guide).alias("i"), mean(source).alias("p"), mean(times(guide, guide)).alias("ii"), mean(times(guide, source)).alias("ip"))
    lines = let(let(moments, fitted), lambda f: F.struct(mean(F.transform(f, lambda x: x["a"])).alias("a"), mean(F.transform(f, lambda x: x["b"])).alias("b")))
    return let(lines, lambda f: F.zip_with(times(f["a"], guide), f["b"], lambda x, b: x + b))


# ---- resampling


def triangle(x: float) -> float:
    return max(0.0, 1.0 - abs(x))


def lanczos(x: float, lobes: int = 3) -> float:
    sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
    return sinc(x) * sinc(x / lobes) if abs(x) < lobes else 0.0


#: Kernels by name with their half width.
KERNELS = {"bilinear": (triangle, 1.0), "lanczos": (lanczos, 3.0)}


def resampling_table(size: int, to: int, kernel: str) -> list[tuple[int, list[float]]]:
    """For each new pixel the first old one that counts and the weights from there; shrinking widens the kernel."""
    weight, reach = KERNELS[kernel]
    scale = size / to
    stretch = max(1.0, scale)
    table = []
    for k in range(to):
        centre = (k + 0.5) * scale
        first, end = max(0, int(centre - reach * stretch + 0.5)), min(size, int(centre + reach * stretch + 0.5))
        raw = [weight((i - centre + 0.5) / stretch) for i in range(first, end)]
        table.append((first, [w / sum(raw) for w in raw]))
    return table


def resampled(raster: Column, height: int, width: int, to_height: int, to_width: int, kernel: str = "bilinear") -> Column:
    """The raster in another size, by rows and then by columns."""

    def step(table: list[tuple[int, list[float]]]) -> Line:
        pixel = lambda line, first, taps: sum((w * F.get(line, F.lit(first + k)) for k, w in enumerate(taps)), F.lit(0.0))
        return lambda line: F.array(*(pixel(line, first, taps) for first, taps in table))

    rows = let(raster, lambda x: by_rows(x, height, width, step(resampling_table(width, to_width, kernel))))
    columns = step(resampling_table(height, to_height, kernel))
    down = let(let(rows, lambda x: turned(x, height, to_width)), lambda x: by_rows(x, to_width, height, columns))
    return let(down, lambda x: turned(x, to_width, to_height))


# ---- distances

POINT = "array<struct<at:int,high:double,tag:int,start:double>>"


def envelope(line: Column) -> Column:
    """Along a line of (high, tag), null where there is none: the lowest of the parabolas high + distance ** 2 at each place, with its tag.

    The lower envelope is built from left to right.  A new parabola is the lowest from one place on, so it takes the end of the envelope:
    all parts that begin no earlier than it crosses them.  Where two are equal the later one counts.
    """

    def crossing(new: Column, old: Column) -> Column:
        rise = (new["high"] + new["at"] * new["at"]) - (old["high"] + old["at"] * old["at"])
        return rise / (2.0 * (new["at"] - old["at"]))

    def added(parts: Column, new: Column) -> Column:
        left = F.filter(parts, lambda old: crossing(new, old) > old["start"])

        def with_new(kept: Column) -> Column:
            start = F.when(F.size(kept) == 0, F.lit(float("-inf"))).otherwise(crossing(new, F.get(kept, F.size(kept) - 1)))
            part = F.struct(new["at"].alias("at"), new["high"].alias("high"), new["tag"].alias("tag"), start.alias("start"))
            return F.array_append(kept, part)

        return let(left, with_new)

    def read(parts: Column) -> Column:
        def lowest(_: Column, i: Column) -> Column:
            begun = F.filter(parts, lambda p: p["start"] <= i)
            part = F.get(begun, F.size(begun) - 1)
            away = (i - part["at"]).cast("double")
            return F.when(F.size(parts) > 0, F.struct((part["high"] + away * away).alias("high"), part["tag"].alias("tag")))

        return F.transform(line, lowest)

    named = F.transform(line, lambda p, i: F.when(p.isNotNull(), F.struct(i.alias("at"), p["high"].alias("high"), p["tag"].alias("tag"))))
    parts = F.aggregate(F.filter(named, lambda p: p.isNotNull()), F.array().cast(POINT), added)
    return let(parts, read)


def nearest_member(mask: Column, height: int, width: int) -> Column:
    """For each pixel (high, tag): squared distance to the nearest pixel of the mask and that pixel's place; null without any.

    Of pixels equally near the last one by row and then by column counts.
    """
    on = F.transform(mask, lambda v, i: F.when(v >= 1, F.struct(F.lit(0.0).alias("high"), i.alias("tag"))))
    rows = let(on, lambda x: by_rows(x, height, width, envelope))
    down = let(let(rows, lambda x: turned(x, height, width)), lambda x: by_rows(x, width, height, envelope))
    return let(down, lambda x: turned(x, width, height))


def distances(nearest: Column, none: float = 1e6) -> Column:
    """Distances in pixels from what ``nearest_member`` gave; ``none`` where the mask is empty."""
    return F.transform(nearest, lambda p: F.coalesce(F.sqrt(p["high"]), F.lit(none)))


def nearest_values(nearest: Column, raster: Column, none: float = 0.0) -> Column:
    """The raster's values at the nearest member."""
    return F.transform(nearest, lambda p: F.coalesce(F.get(raster, p["tag"]), F.lit(none)))
