"""Extraction: engines by name, gate of one candidate, choice between two, and two masks as one.

Fixed values: the thresholds and penalties of ``quality``, ``gate`` and ``choose``; they must be these for the same verdicts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenqc.functions import raster

#: Engines by name: from a picture's luma, an array, to its alpha.
ENGINES: dict[str, Callable[[Column], Column]] = {}


def engine(name: str) -> Callable:
    """Registers an engine; another of the same name takes its place."""

    def keep(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
        ENGINES[name] = f
        return f

    return keep


@engine("luma")
def luma_threshold(luma: Column, bar: float = 200.0) -> Column:
    """What is darker than a white background is the product."""
    return F.transform(luma, lambda v: F.when(v < bar, 255.0).otherwise(0.0))


@engine("soft")
def luma_slope(luma: Column, low: float = 120.0, high: float = 220.0) -> Column:
    """Alpha falls with luma from ``low`` to ``high``."""
    return F.transform(luma, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), 255.0 * (high - v) / (high - low))))


def extract(luma: Column, name: Column) -> Column:
    """The alpha that each row's own engine makes; an engine that isn't registered makes none."""
    out = F.lit(None).cast("array<double>")
    for key, made in ENGINES.items():
        out = F.when(name == key, made(luma)).otherwise(out)
    return out


def ensemble(a: Column, b: Column, a_sure: Column, b_sure: Column, agree: float = 0.72) -> dict[str, Column]:
    """Two masks as one: where they agree the larger alpha, of pixels solid in both the mean; else the surer mask, trusted less."""
    same = raster.iou(a, b, 128.0)
    merged = F.zip_with(a, b, lambda x, y: F.when((x >= 128) & (y >= 128), F.floor(0.5 * x + 0.5 * y).cast("double")).otherwise(F.greatest(x, y)))
    first, one = b.isNull() | (a_sure >= b_sure), b.isNull()
    return {
        "iou": F.when(~one, same), "mask": F.when(one, a).when(same >= agree, merged).when(first, a).otherwise(b),
        "confidence": F.when(one, a_sure).when(same >= agree, 0.5 * F.greatest(a_sure, b_sure) + 0.5 * F.least(a_sure, b_sure)).otherwise(0.9 * F.greatest(a_sure, b_sure)),
        "how": F.when(one, "alone").when(same >= agree, "ensemble_max").otherwise("selected_by_confidence"),
    }


def quality(solid: Column, uncertain: Column, interior: Column, border: Column, ghost: Column, pieces: Column) -> Column:
    """1 less a penalty for each sign of a poor alpha mask."""
    off = [(solid < 0.004, 0.70), (solid < 0.02, 0.25), (solid > 0.88, 0.30), (uncertain > 0.14, 0.18), (interior < 0.82, 0.16), (border > 0.22, 0.12), (ghost > 2.5, 0.22), ((pieces >= 18) & (solid < 0.04), 0.12)]
    return F.greatest(F.lit(0.0), 1.0 - sum((F.when(c, x).otherwise(0.0) for c, x in off), F.lit(0.0)))


def gate(solid: Column, uncertain: Column, interior: Column, border: Column, ghost: Column, score: Column) -> Column:
    invalid = (solid < 0.012) | (solid > 0.93) | ((ghost > 3.5) & (interior < 0.55)) | ((interior < 0.45) & (uncertain > 0.18))
    unsure = (uncertain > 0.11) | (interior < 0.84) | (border > 0.28) | (solid < 0.028) | (solid > 0.78) | (ghost > 1.8) | (score < 0.62)
    return F.when(invalid, "INVALID").when(unsure, "UNCERTAIN").otherwise("GOOD")


def needs_rescue(state: Column, mode: str = "adaptive") -> Column:
    """A failed extraction counts as an invalid one; in mode ``fast`` an uncertain one is let be."""
    return state.isin("INVALID", "FAILED", *["UNCERTAIN"] * (mode != "fast"))


def choose(state: Column, p: Column, r: Column, p_unsure: Column, r_unsure: Column, p_inside: Column, r_inside: Column) -> tuple[Column, Column]:
    """Which of primary and rescue wins, and why, from their solid shares p and r (null: no candidate)."""
    near = F.abs(r - p) / F.greatest(p, r, F.lit(1e-4)) < 0.18
    cleaner = (r_unsure + 0.025 < p_unsure) & (r_inside + 0.02 >= p_inside)
    rules = [
        (p.isNull() & r.isNull(), "none", "no_candidate"),
        (p.isNull(), "rescue", "primary_missing"),
        (r.isNull(), "primary", "rescue_missing"),
        ((state != "INVALID") & (r < 0.72 * p) & (p >= 0.02), "primary", "rescue_lost_product"),
        (((state == "INVALID") | (p < 0.02)) & (r > F.greatest(F.lit(0.03), 1.2 * p)), "rescue", "rescue_recovered_product"),
        (near & cleaner, "rescue", "rescue_cleaner_edges"),
        (near, "primary", "primary_comparable_keep"),
        ((r > 1.15 * p) & (r_inside >= F.least(F.lit(0.75), p_inside)), "rescue", "rescue_more_complete"),
    ]
    side, why = F.lit("primary"), F.lit("primary_default")
    for when, s, w in reversed(rules):
        side, why = F.when(when, s).otherwise(side), F.when(when, w).otherwise(why)
    return side, why
