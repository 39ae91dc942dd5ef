"""Score arithmetic as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def column(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def ramp(x: Column, soft: float, hard: float, most: float) -> Column:
    """0 up to ``soft``, ``most`` from ``hard`` on, a line between."""
    return F.when(x <= soft, 0.0).when(x >= hard, float(most)).otherwise(most * (x - soft) / max(1e-6, hard - soft))


def given(x: Column, default: Number, mode: str = "falsy") -> Column:
    """``x`` or its default.  In mode ``falsy`` a measured zero counts as missing too; in mode ``strict`` only null does."""
    if mode not in ("falsy", "strict"):
        raise ValueError(f"no mode {mode}")
    return F.coalesce(F.nullifzero(x) if mode == "falsy" else x, column(default))


def weighted(parts: Iterable[tuple[Column, float]]) -> Column:
    """The weighted mean; the divisor is the sum of all weights."""
    parts = list(parts)
    total = sum(w for _, w in parts)
    out = F.lit(0.0)
    for x, w in parts:
        out = out + x * (w / total)
    return out


def line(x: Column, x0: float, y0: float, x1: float, y1: float) -> Column:
    """Interpolation between two points, flat outside."""
    return F.when(x <= x0, float(y0)).when(x >= x1, float(y1)).otherwise(y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))


def ratio(x: Column, n: Column, least: float = 1.0) -> Column:
    """x over n, where n counts as ``least`` at least."""
    return x / F.greatest(n, F.lit(least))


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def chroma(r: Column, g: Column, b: Column) -> Column:
    return F.greatest(r, g, b) - F.least(r, g, b)


def saturation(r: Column, g: Column, b: Column) -> Column:
    """Chroma by the largest channel; 0 for black."""
    most = F.greatest(r, g, b)
    return F.when(most > 1e-3, chroma(r, g, b) / F.greatest(most, F.lit(1e-3))).otherwise(0.0)


def smoothstep(x: Column, low: float = 0.20, high: float = 0.78) -> Column:
    t = clamp((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3.0 - 2.0 * t)


def over_white(c: Column, alpha: Column) -> Column:
    """A channel (0 to 255) at ``alpha`` (0 to 1) over white."""
    return F.when(alpha <= 0, 255.0).otherwise(F.bround(c * alpha + 255.0 * (1.0 - alpha)))


def unmixed(c: Column, background: Column, alpha: Column, low: float = 0.05, high: float = 0.95) -> Column:
    """A channel without the share of the background, where alpha lies between ``low`` and ``high``."""
    return F.when((alpha > low) & (alpha < high), clamp((c - (1.0 - alpha) * background) / alpha, 0.0, 255.0)).otherwise(c)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab (D65) of sRGB channels from 0 to 255."""
    linear = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    # sRGB to XYZ, and the white point.
    matrix = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
    white = (0.95047, 1.0, 1.08883)
    f = []
    for row, w in zip(matrix, white, strict=True):
        t = sum((m * c for m, c in zip(row, linear, strict=True)), F.lit(0.0)) / w
        f.append(F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0))
    return 116.0 * f[1] - 16.0, 500.0 * (f[0] - f[1]), 200.0 * (f[1] - f[2])


def delta_e(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def fit_side(width: Column, height: Column, most: int) -> Column:
    """(width, height) scaled down, whole, so that the longer side is ``most`` at most."""
    scale = F.least(F.lit(1.0), most / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), (width * scale).cast("int")).alias("width"), F.greatest(F.lit(1), (height * scale).cast("int")).alias("height"))


def letterboxed(width: Column, height: Column, box_width: int, box_height: int) -> Column:
    """Size, whole, of a picture fitted into a box, and where it begins when it stands in the middle."""
    scale = F.least(box_width / width, box_height / height)
    w, h = (F.greatest(F.lit(1), (x * scale).cast("int")) for x in (width, height))
    return F.struct(w.alias("width"), h.alias("height"), F.floor((box_width - w) / 2).cast("int").alias("left"), F.floor((box_height - h) / 2).cast("int").alias("top"))


def duration(seconds: Column) -> Column:
    """m:ss, or h:mm:ss from an hour on; null, NaN and negative count as 0."""
    s = F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), 0.0).otherwise(seconds).cast("long")
    h, m = (s / 3600).cast("long"), (s % 3600 / 60).cast("long")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))
