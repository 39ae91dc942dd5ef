"""Loss of product regions between the raw and the finished picture, from occupancy grids and a second model's verdict."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenqc.functions import neighbourhood, raster, tags
from lumenqc.functions.scores import clamp

LARGE = "large_contiguous_foreground_loss"


def lost_cells(raw: Column, final: Column, edges: Column) -> Column:
    """1 for each cell of a grid whose product is gone.  Fixed values: the shares that count as product and as gone."""
    both = F.zip_with(F.zip_with(raw, final, lambda r, f: F.struct(r.alias("r"), f.alias("f"))), edges, lambda p, e: F.struct(p["r"].alias("r"), p["f"].alias("f"), e.alias("e")))
    return F.transform(both, lambda c: F.when(((c["r"] >= 0.34) & (c["f"] <= 0.10)) | ((c["r"] >= 0.28) & (c["f"] <= 0.08) & (c["e"] >= 0.03)), 1.0).otherwise(0.0))


def quantile(values: Column, share: float) -> Column:
    """Interpolated quantile of an array's values; null for an empty one."""
    at = (F.size(values) - 1) * share
    low = F.floor(at).cast("int")
    return neighbourhood.let(F.array_sort(values), lambda v: F.get(v, low) + (F.get(v, F.least(low + 1, F.size(values) - 1)) - F.get(v, low)) * (at - low))


def regional(raw: Column, final: Column, lost: Column, side: int) -> dict[str, Column]:
    """Lost and raw cells, the share of the largest lost region (8 neighbours), and how much each raw cell falls short."""
    cells = F.size(F.filter(raw, lambda r: r >= 0.28))
    largest = F.coalesce(F.get(neighbourhood.sizes(neighbourhood.components(lost, side, neighbourhood.SQUARE)), F.lit(0)), F.lit(0))
    short = F.transform(F.filter(F.zip_with(raw, final, lambda r, f: F.struct(r.alias("r"), f.alias("f"))), lambda c: c["r"] >= 0.28), lambda c: clamp(c["r"] - c["f"], 0.0, 1.0))
    score = 100.0 * (0.45 * raster.total(short) / F.greatest(cells, F.lit(1)) + 0.55 * F.coalesce(quantile(short, 0.75), F.lit(0.0)))
    n_lost = raster.total(lost)
    return {
        "n_lost_cells": n_lost, "n_raw_cells": cells.cast("double"), "lost_cell_frac": n_lost / F.greatest(cells, F.lit(1)), "largest_missing_region_ratio": largest / F.greatest(cells, F.lit(1)),
        "regional_structure_loss_score": F.least(F.lit(100.0), score),
    }


def survival_score(survival: Column, largest: Column) -> Column:
    return clamp(100.0 * survival * (1.0 - 0.55 * largest))


def verified(c, seen: Column, missing: Column, agreeing: Column, confirmed_cells: Column, n_lost: Column) -> dict[str, Column]:
    """A suspected loss after a second model's look.

    ``c(name)`` gives a column of the item; ``seen``, ``missing``, ``agreeing`` count the second model's product pixels: all, those that
    the finished picture lacks, and those that it has; ``confirmed_cells`` are the lost cells that it calls product.
    Losses that are no candidates, are already held or rest on sure evidence aren't looked at and stay as they are.
    """
    confidence = F.upper(F.coalesce(c("spatial_evidence_confidence"), F.lit("LOW")))
    asked = (c("spatial_loss_candidate") >= 0.5) & ~(c(LARGE) >= 0.5) & (confidence != "HIGH")
    gone, same, cells = missing / F.greatest(seen, F.lit(1)), agreeing / F.greatest(seen, F.lit(1)), confirmed_cells / F.greatest(n_lost, F.lit(1))
    background = (same >= 0.82) & (gone < 0.08)
    product = (((gone >= 0.12) & (missing >= 400)) | ((cells >= 0.45) & (missing >= 200))) & ~background
    yes, no = asked & product, asked & ~product
    softened = no & ((confidence == "LOW") | background)
    keep = lambda name, *turns: (lambda x: [x := F.when(w, v).otherwise(x) for w, v in turns][-1])(c(name))
    return {
        LARGE: keep(LARGE, (no, F.lit(0.0)), (yes, F.lit(1.0))), "spatial_verified": F.when(yes, 1.0).when(no, 0.0), "spatial_loss_candidate": keep("spatial_loss_candidate", (no, F.lit(0.0))),
        "largest_missing_region_ratio": keep("largest_missing_region_ratio", (softened, F.least(F.coalesce(c("largest_missing_region_ratio"), F.lit(0.0)), F.lit(0.08)))),
        "foreground_survival_score": keep("foreground_survival_score", (softened, F.greatest(F.coalesce(c("foreground_survival_score"), F.lit(0.0)), F.lit(86.0)))),
        "bads": tags.added(tags.listed(c("bads")), LARGE, yes), "warns": tags.added(tags.listed(c("warns")), "spatial_product_loss_warn", no),
        "triggered": F.concat(tags.listed(c("triggered")), tags.raised((yes, "spatial_verifier_confirmed_product_loss"), (no, "spatial_verifier_rejected_bg_or_shadow"))),
    }
