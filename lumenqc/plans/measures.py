"""What the gates judge, measured on pictures: the mask's confidence, the cutout, and the finished picture against the raw one.

Pictures are square rasters in array columns, an array a channel, values from 0 to 255 (``r``, ``g``, ``b``, ``alpha``).  Each function takes a
table and adds columns; nothing is shuffled and no Python runs.

Special cases: a mask without pixels has confidence by its penalties alone; a measure of too few pixels is null, and rules over it are
silent; a null raster gives null measures.  Fixed values: bars of alpha and brightness, penalties and their tags; they must be these for the
same verdicts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenqc.functions import filters, neighbourhood, tags
from lumenqc.functions.scores import clamp
from lumenqc.plans import gates
from lumenqc.plans.priors import MOST_SHARE, SOFT, SOLID, WHITE, by_pixel, deviation, mask, quantile, share, total, where


@dataclass(frozen=True)
class Need:
    """The fewest pixels of which something is measured."""

    foreground: int = 80
    solid: int = 40
    #: Solid pixels that a band around them needs, and pixels of the band itself.
    band: int = 80
    #: The band's width.
    band_radius: int = 2
    prior: int = 120
    fallback: int = 80
    tones: int = 80
    selective: int = 300
    edges: int = 60


def counted(values: str, test) -> Column:
    return F.size(F.filter(values, test))


def mask_confidence(cuts: DataFrame, side: int) -> DataFrame:
    """``confidence`` (0 to 1) of the mask ``alpha`` and ``warnings``: its size, border, pieces, holes, fog and weakness cost points."""
    c = F.col
    over = lambda bar: F.transform("alpha", lambda a: mask(a >= bar))
    made = cuts.withColumns({"soft": over(SOFT), "solid": over(128)})
    last = side - 1

    def touches(on: Column) -> Column:
        """Pixels on the border; a corner lies on two sides."""
        sides = lambda k: mask(k == 0) + mask(k == last)
        return total(neighbourhood.pixels(side, lambda y, x: (sides(y) + sides(x)) * neighbourhood.edge(on, side, y, x)))

    made = made.withColumns({
        "n_soft": total(c("soft")), "n_solid": total(c("solid")), "border_hit": touches(c("soft")) / (4.0 * side),
        "n_components": F.size(neighbourhood.sizes(neighbourhood.components(c("solid"), side))), "n_fog": counted("alpha", lambda a: (a >= SOFT) & (a < 140)),
        "alpha_soft": total(where(c("alpha"), c("soft"))),
    })
    some = F.greatest(c("n_soft"), F.lit(1.0))
    made = made.withColumns({"soft_frac": c("n_soft") / (side * side), "solid_frac": c("n_solid") / (side * side), "fog_ratio": c("n_fog") / some, "mean_alpha_soft": c("alpha_soft") / some})
    holes = 1.0 - c("n_solid") / some
    rules = [
        (c("soft_frac") < 0.01, 0.55, "tiny_foreground"), (c("soft_frac") > 0.55, 0.35, "full_frame_mask"), (c("border_hit") > 0.15, 0.18, "border_clipping"),
        (c("n_components") >= 8, 0.22, "fragmented"), (c("n_components").between(4, 7), 0.10, "multi_component"), ((c("n_solid") > 0) & (holes > 0.45), 0.08, "many_holes"),
        (c("fog_ratio") > 0.55, 0.15, "foggy_alpha"), (c("mean_alpha_soft") < 95, 0.12, "weak_alpha"),
    ]
    score = F.lit(1.0)
    for when, cost, _ in rules:
        score = score - F.when(when, cost).otherwise(0.0)
    told = {"confidence": F.when(c("alpha").isNotNull(), clamp(score, 0.0, 1.0)), "warnings": tags.raised(*((when, tag) for when, _, tag in rules))}
    return made.withColumns(told).drop("soft", "solid", "n_soft", "n_solid", "n_fog", "alpha_soft")


def cutout_measures(cuts: DataFrame, side: int, need: Need) -> DataFrame:
    """The cutout gate's measurements of ``r``, ``g``, ``b`` under ``alpha``, within the product's box."""
    c = F.col
    over = lambda bar: F.transform("alpha", lambda a: mask(a >= bar))
    made = cuts.withColumns({"fg": over(SOFT), "solid": over(160)})
    made = made.withColumns({"n_fg": total(c("fg")), "n_solid": total(c("solid")), "box": neighbourhood.box(c("fg"), side), "spread": filters.maximum(c("solid"), side, side, need.band_radius)})

    def reach(low: str, high: str) -> Column:
        """The box's extent with a margin of three hundredths, of one pixel at least, inside the frame."""
        size = c(high) - c(low) + 1
        pad = F.greatest(F.lit(1), F.floor(size * 0.03))
        return F.when(c("n_fg") > 0, F.least(F.lit(side), c(high) + 1 + pad) - F.greatest(F.lit(0), c(low) - pad))

    pixel = by_pixel(["r", "g", "b", "alpha", "spread"], lambda p: p)
    inner = lambda p: p["alpha"] >= 160
    made = made.withColumns({"area": reach("box.top", "box.bottom") * reach("box.left", "box.right"), "seen": F.filter(pixel, inner), "band": F.filter(pixel, lambda p: (p["spread"] >= 1) & (p["alpha"] >= SOFT) & (p["alpha"] < 160))})
    light = F.transform("seen", lambda p: 255.0 - F.least(p["r"], p["g"], p["b"]))
    made = made.withColumn("tones", F.flatten(F.transform("seen", lambda p: F.array(p["r"], p["g"], p["b"]))))
    enough = c("n_solid") >= need.solid
    banded = (c("n_solid") >= need.band) & (c("n_fg") > c("n_solid")) & (F.size("band") >= need.band)
    held = F.greatest(c("n_fg"), F.lit(1.0))
    return made.withColumns({
        "fg_frac": c("n_fg") / (side * side), "solid_frac": c("n_solid") / (side * side), "solid_of_fg": c("n_solid") / held,
        "fog_of_fg": F.when(c("n_fg") > 0, counted("alpha", lambda a: (a >= SOFT) & (a < 150)) / held).otherwise(1.0), "roi_fg_fill": c("n_fg") / c("area"), "roi_solid_fill": c("n_solid") / c("area"),
        "visibility": F.when(enough, share(light)), "solid_std": F.when(enough, deviation(c("tones"), share(c("tones")))),
        "near_white_in_solid": F.when(enough, counted("seen", lambda p: F.least(p["r"], p["g"], p["b"]) >= 245) / F.greatest(c("n_solid"), F.lit(1.0))),
        "edge_band_frac": F.when(banded, F.size("band") / held), "edge_band_mean_alpha": F.when(banded, share(F.transform("band", lambda p: p["alpha"]))),
    }).drop("fg", "solid", "box", "spread", "area", "seen", "band", "tones")


def cutout_said(difficult: Column, need: Need) -> dict[str, Column]:
    """What the cutout gate says of ``cutout_measures``' columns; of a product too small, that alone."""
    said, small = gates.cutout(F.col, difficult), F.col("n_fg") < need.foreground
    pale = F.when(F.col("n_solid") < need.solid, F.array(F.lit(gates.FOG_EDGES))).otherwise(tags.none())
    said["bads"] = F.concat(said["bads"], pale)
    return {k: F.when(small, F.array(F.lit("foreground_too_small")) if k == "bads" else tags.none()).otherwise(v) for k, v in said.items()}


def integrity_measures(made: DataFrame, side: int, need: Need) -> DataFrame:
    """The finished picture ``out_r``, ``out_g``, ``out_b`` against the raw one, in the product's pixels: what of its edges, texture and tones is left.

    ``made`` has the columns of ``priors.anchored_prior``.  The product is the raw prior; if that fills too much of the frame, the one anchored
    in the mask; if what was chosen is too small, the mask.
    """
    c = F.col
    made = made.withColumns({"unsure": share(c("prior")) > MOST_SHARE, "soft": F.transform("alpha", lambda a: mask(a >= SOFT))})
    made = made.withColumn("product", F.when(c("unsure"), c("mask_prior")).otherwise(c("prior"))).withColumn("few", total(c("product")) < need.prior)
    made = made.withColumn("product", F.when(c("few"), c("soft")).otherwise(c("product")))
    made = made.withColumn("out_luma", by_pixel(["out_r", "out_g", "out_b"], lambda p: 0.299 * p["out_r"] + 0.587 * p["out_g"] + 0.114 * p["out_b"]))
    made = made.withColumns({
        "out_edge": neighbourhood.gradient(c("out_luma"), side), "out_texture": filters.local_std(c("out_luma"), side, side, 2),
        "out_white": by_pixel(["out_r", "out_g", "out_b"], lambda p: F.least(p["out_r"], p["out_g"], p["out_b"]) >= WHITE),
    })
    values = ["product", "alpha", "luma", "edge", "texture", "out_luma", "out_edge", "out_texture", "out_white"]
    made = made.withColumn("on", F.filter(by_pixel(values, lambda p: p), lambda p: p["product"] >= 1))
    kept = lambda p: p["alpha"] >= SOLID
    gone = lambda p: p["alpha"] < 48
    middle, dark = (lambda p: p["luma"].between(95, 220)), (lambda p: p["luma"] < 95)
    made = made.withColumns({"kept": F.filter("on", kept), "n_product": F.size("on"), "bar": F.greatest(F.lit(6.0), quantile(F.transform("on", lambda p: p["edge"]), 0.70, 10.0))})
    made = made.withColumns({"mid_prior_pixels": counted("on", middle), "dark_prior_pixels": counted("on", dark), "strong": counted("on", lambda p: p["edge"] >= c("bar")), "lit": counted("on", lambda p: p["luma"] < 245)})
    all_, some = F.greatest(c("n_product"), F.lit(1)), F.greatest(c("lit"), F.lit(1))
    wiped = lambda tone, n: F.when(c(n) >= need.tones, counted("on", lambda p: tone(p) & gone(p)) / c(n)).otherwise(0.0)

    def ratio(after: str, before: str) -> Column:
        mean = lambda name: share(F.transform("kept", lambda p: p[name]))
        return F.when(F.size("kept") > 0, mean(after) / F.greatest(F.lit(1e-3), mean(before))).otherwise(0.0)

    made = made.withColumn("prior_kept_frac", F.size("kept") / all_)
    return made.withColumns({
        "prior_mode": F.when(c("few"), "alpha_fallback").when(c("unsure"), "mask_anchored").otherwise("independent"), "prior_wipe_frac": counted("on", gone) / all_,
        "mid_prior_wipe": wiped(middle, "mid_prior_pixels"), "dark_prior_wipe": wiped(dark, "dark_prior_pixels"),
        "texture_ratio": ratio("out_texture", "texture"), "edge_energy_ratio": ratio("out_edge", "edge"),
        "strong_edge_keep": F.when(c("strong") >= need.edges, counted("on", lambda p: (p["edge"] >= c("bar")) & kept(p)) / c("strong")).otherwise(c("prior_kept_frac")),
        "whiteout_frac": counted("on", lambda p: (p["luma"] < 245) & (p["alpha"] >= SOFT) & p["out_white"] & (p["out_texture"] < 3.5)) / some,
        "blown_frac": counted("on", lambda p: (p["luma"] < 200) & kept(p) & (p["out_luma"] >= 245) & (p["out_texture"] < 5.0)) / some,
        "too_small": c("few") & (c("n_product") < need.fallback),
    }).drop("on", "kept", "few", "unsure", "soft", "strong", "bar", "lit")


def integrity_said(need: Need) -> dict[str, Column]:
    """Scores and tags of ``integrity_measures``' columns and ``foreground_survival_score``; of a product too small, lowest scores and that alone."""
    said = gates.integrity(F.col, F.col("mid_prior_pixels") >= need.selective)
    small = {"bads": F.array(F.lit("empty_or_tiny_foreground")), "warns": tags.none(), "posits": tags.none(), "raw_final_integrity": F.lit(None).cast("double")}
    return {k: F.when(F.col("too_small"), small.get(k, F.lit(8.0))).otherwise(v) for k, v in said.items()}
