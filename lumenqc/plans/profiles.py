"""Scene flags and the eleven-way product profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenqc.functions import scores, tags
from lumenqc.operators import analytics, scale

#: The order in which a product's tags name its profile.
PRIORITY = ["mesh", "hose", "white_object", "dark_object", "translucent", "metallic", "reflective", "thin_complex_edges", "cylindrical_filter", "packaging", "normal"]


def scene(pixels: DataFrame, key: str, luma: Column, chroma: Column) -> DataFrame:
    """Flags of a picture from its pixel rows: aggregates that combine before the shuffle, and exact percentiles from counts by luma."""
    lit = pixels.select(key, luma.alias("luma"), chroma.alias("chroma"))
    stats = lit.groupBy(key).agg(
        F.count("luma").alias("n"), F.avg("luma").alias("mean_luma"), F.stddev_pop("luma").alias("std_luma"),
        F.avg((F.col("luma") >= 230).cast("double")).alias("highlights"), F.avg((F.col("chroma") < 18).cast("double")).alias("low_chroma"),
    )
    (ranks, p95), (p5_ranks, p5) = scale.interpolated("p95", 0.95), scale.interpolated("p5", 0.05)
    stats = analytics.with_quantiles(stats, lit, key, "luma", ranks | p5_ranks).withColumns({"p95": p95(F.col("n")), "p5": p5(F.col("n"))})
    stats = stats.select(key, "mean_luma", "std_luma", "p95", "p5", "highlights", "low_chroma")
    mean, std, low, high = (F.col(c) for c in ("mean_luma", "std_luma", "low_chroma", "highlights"))
    flags = {
        "bright_low_contrast": (mean >= 155) & (std <= 52), "mostly_highlights": (F.col("p95") >= 242) & (mean >= 140), "glossy": (high >= 0.12) & (std >= 35), "pale_product": (low >= 0.55) & (mean >= 150),
        "narrow_range": (F.col("p95") - F.col("p5") < 55) & (mean >= 140), "grey_packaging": (low >= 0.85) & mean.between(90, 175), "low_contrast_object": (std <= 48) & (mean >= 110) & (low >= 0.70),
    }
    difficult = F.lit(False)
    for f in flags.values():
        difficult = difficult | f
    return stats.withColumns(flags | {"difficult": difficult})


def profile_tags(luma: Column, saturation: Column, shadow_clip: Column, highlight_clip: Column, complexity: Column, uniformity: Column, elongation: Column, holes: Column, pale: Column, glossy: Column, grey: Column, difficult: Column) -> Column:
    """The tags of a product, in order; ``normal`` if none fits."""
    found = tags.raised(
        ((luma <= 85) | (shadow_clip > 0.08), "dark_object"), ((luma >= 175) | pale, "white_object"), ((saturation < 0.12) & luma.between(90, 190), "metallic"), (glossy | (highlight_clip > 0.06), "reflective"),
        (grey | ((saturation < 0.08) & (uniformity < 0.55)), "translucent"), ((complexity >= 0.18) | (holes >= 0.12), "mesh"), ((complexity >= 0.16) & (elongation < 2.2), "thin_complex_edges"), (elongation >= 2.4, "hose"),
        (elongation.between(1.15, 2.0) & (complexity >= 0.12), "cylindrical_filter"), (difficult & (saturation > 0.18), "packaging"),
    )
    return F.when(F.size(found) == 0, F.array(F.lit("normal"))).otherwise(found)


def primary(found: Column) -> Column:
    return tags.first_of(PRIORITY, found)


def handling(found: Column) -> dict[str, Column]:
    """What the tags ask of later steps."""
    first = primary(found)
    fill = F.when(tags.has(found, "hose"), 0.90).when(tags.has(found, "mesh", "cylindrical_filter"), 0.82).when(tags.has(found, "dark_object"), 0.86).otherwise(0.85)
    return {
        "gentle_edges": first.isin("white_object", "metallic", "reflective", "translucent"), "preserve_holes": tags.has(found, "mesh", "thin_complex_edges"),
        "conservative_color": first.isin("white_object", "dark_object", "metallic", "packaging"), "product_fill": fill,
    }


def color_signature(pixels: DataFrame, key: str, bar: float = 80.0) -> DataFrame:
    """Mean CIE Lab of each key's pixels (r, g, b, alpha) from alpha ``bar`` on."""
    seen = F.col("alpha") >= bar
    values = dict(zip(("lightness", "a", "b_"), scores.lab(F.col("r"), F.col("g"), F.col("b")), strict=True))
    found = pixels.select(key, seen.alias("seen"), *(v.alias(k) for k, v in values.items())).groupBy(key)
    return found.agg(F.count_if("seen").alias("n"), *(F.avg(F.when(F.col("seen"), F.col(k))).alias(k.rstrip("_")) for k in values))
