"""What a picture's pixels say together: light, colour, sharpness, noise and background, and where its mass is placed on a canvas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenqc.functions import filters, neighbourhood, scores
from lumenqc.functions.neighbourhood import let
from lumenqc.plans.priors import by_pixel, deviation, mask, share, total, where

MEASURES = """exposure_score mean_luma std_luma highlight_clip shadow_clip contrast cast_rg cast_gb cast_rb wb_tendency sharpness noise_level
background_brightness background_uniformity object_size_hint edge_complexity saturation_mean""".split()


def one_sided_gradient(raster: Column, side: int) -> Column:
    """Magnitude of central differences, which at the border are those to the only neighbour."""

    def slope(y: Column, x: Column, dy: int, dx: int) -> Column:
        apart = neighbourhood.edge(raster, side, y + dy, x + dx) - neighbourhood.edge(raster, side, y - dy, x - dx)
        at_border = (x if dx else y).isin(0, side - 1)
        return apart / F.when(at_border, 1.0).otherwise(2.0)

    def at(y: Column, x: Column) -> Column:
        gx, gy = slope(y, x, 0, 1), slope(y, x, 1, 0)
        return F.sqrt(gx * gx + gy * gy)

    return neighbourhood.pixels(side, at)


def tendency(rg: Column, gb: Column, rb: Column) -> Column:
    return (
        F.when((F.abs(rg) < 6) & (F.abs(gb) < 6), "neutral").when((rg > 8) & (rb > 8), "warm").when((rb < -8) & (gb < -4), "cool")
        .when(gb > 8, "green").when(rg < -8, "magenta").otherwise("neutral")
    )


def analysed(pictures: DataFrame, side: int) -> DataFrame:
    """``pictures`` (r, g, b, alpha) with the measures of what the mask shows; of an empty mask all pixels count, and so for the background."""
    c = F.col
    made = pictures.withColumn("luma", by_pixel(["r", "g", "b"], lambda p: 0.299 * p["r"] + 0.587 * p["g"] + 0.114 * p["b"]))
    made = made.withColumns({"shown": F.transform("alpha", lambda a: mask(a >= 40)), "behind": F.transform("alpha", lambda a: mask(a < 20))})
    low, high = (lambda p: F.least(p["r"], p["g"], p["b"])), (lambda p: F.greatest(p["r"], p["g"], p["b"]))
    rest = F.zip_with("luma", filters.box_mean(c("luma"), side, side, 1), lambda v, m: F.abs(v - m))
    colour = by_pixel(["r", "g", "b"], lambda p: F.when(high(p) > 1e-3, (high(p) - low(p)) / F.greatest(high(p), F.lit(1e-3))).otherwise(0.0))
    made = made.withColumns({"slope": one_sided_gradient(c("luma"), side), "rest": rest, "saturation": colour, "any_shown": total(c("shown")) > 0, "any_behind": total(c("behind")) > 0})
    part = lambda name, on="shown": F.when(c(f"any_{on}"), where(c(name), c(on))).otherwise(c(name))
    made = made.withColumns({f"of_{k}": part(k) for k in ("luma", "r", "g", "b", "slope", "rest", "saturation")} | {"of_behind": part("luma", "behind")})
    mean = lambda name: share(c(f"of_{name}"))
    clip = lambda name, test: F.when(c("any_shown"), share(F.transform(f"of_{name}", lambda v: mask(test(v))))).otherwise(0.0)
    made = made.withColumns({"mean_luma": mean("luma"), "background_brightness": mean("behind"), "cast_rg": mean("r") - mean("g"), "cast_gb": mean("g") - mean("b"), "cast_rb": mean("r") - mean("b")})
    made = made.withColumn("std_luma", deviation(c("of_luma"), c("mean_luma")))
    made = made.withColumns({
        "exposure_score": scores.clamp(c("mean_luma") / 255.0, 0.0, 1.0), "contrast": scores.clamp(c("std_luma") / 64.0, 0.0, 2.0),
        "highlight_clip": clip("luma", lambda v: v >= 250), "shadow_clip": clip("luma", lambda v: v <= 8), "wb_tendency": tendency(c("cast_rg"), c("cast_gb"), c("cast_rb")),
        "sharpness": scores.clamp(mean("slope") / 40.0, 0.0, 3.0), "noise_level": mean("rest") / 255.0, "saturation_mean": mean("saturation"),
        "background_uniformity": scores.clamp(1.0 - deviation(c("of_behind"), c("background_brightness")) / 40.0, 0.0, 1.0),
        "object_size_hint": share(c("shown")), "edge_complexity": share(F.transform("of_slope", lambda v: mask(v > 25.0))),
    })
    return made.select(*pictures.columns, *MEASURES)


def centroid(alpha: Column, height: int, width: int) -> Column:
    """The alpha-weighted middle (cy, cx); of a raster without mass its own."""
    def at(mass: Column) -> Column:
        weigh = lambda place: total(F.transform(alpha, lambda a, i: a * place(i))) / mass
        own = F.struct(F.lit(height / 2.0).alias("cy"), F.lit(width / 2.0).alias("cx"))
        return F.when(mass > 1, F.struct(weigh(lambda i: F.floor(i / width)).alias("cy"), weigh(lambda i: i % width).alias("cx"))).otherwise(own)

    return let(total(alpha), at)


def placed(middle: Column, height: int, width: int, canvas: int) -> Column:
    """Where a layer is put on a square canvas so that its middle comes to the canvas's, as far as it stays inside."""
    put = lambda c, size: F.greatest(F.lit(0), F.least(F.lit(max(0, canvas - size)), F.bround(canvas / 2.0 - c, 0).cast("int")))
    return F.struct(put(middle["cx"], width).alias("left"), put(middle["cy"], height).alias("top"))
