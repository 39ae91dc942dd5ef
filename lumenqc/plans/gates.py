"""Gates: from measurements to bad tags, warnings and good signs, as tables of rules.

A gate is a list of groups; of a group the first rule that holds speaks.  A rule is (condition, kind, tag) with kind
``bad``, ``warn``, ``good`` or ``-`` (nothing, but the rest of the group is skipped).  All conditions are columns.

Fixed values: the thresholds and tags of all rules below; they must be these for the same verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenqc.functions import tags
from lumenqc.functions.scores import clamp

Rule = tuple[Column, str, str]
FRAGMENTED, FOG_EDGES, FADED, CATASTROPHE = "foreground_fragmented", "foggy_alpha_edges", "product_faded", "catastrophic_structure_loss"


def spoken(groups: list[list[Rule]]) -> dict[str, Column]:
    """bads, warns and posits, in the order of the groups."""
    kinds: dict[str, list[Column]] = {"bad": [], "warn": [], "good": []}
    for group in groups:
        said = F.lit(None).cast("string")
        for when, kind, tag in reversed(group):
            said = F.when(when, f"{kind}:{tag}").otherwise(said)
        for kind, columns in kinds.items():
            columns.append(F.when(said.startswith(f"{kind}:"), F.substring_index(said, ":", -1)))
    return {name: F.array_compact(F.array(*kinds[kind])) for name, kind in (("bads", "bad"), ("warns", "warn"), ("posits", "good"))}


def kit(pieces: Column, tiny: Column, main: Column, spare: int) -> Column:
    return pieces.between(2, 12) & (tiny <= F.greatest(F.lit(spare), pieces * 2)) & (main >= 0.08)


def mask(c, difficult: Column) -> dict[str, Column]:
    """``c(name)`` gives a measurement."""
    soft, solid, fill, fog, alpha = c("soft_coverage"), c("solid_of_soft"), c("roi_fill"), c("fog_ratio"), c("mean_alpha_soft")
    main, pieces, tiny, every, holes, hole_pixels = c("main_component_frac"), c("n_significant_components"), c("n_tiny_components"), c("n_solid_components"), c("hole_frac"), c("hole_pixels")
    least_fill, least_alpha = F.when(difficult, 0.28).otherwise(0.22), F.when(difficult, 115.0).otherwise(100.0)
    spray, extreme, several = (pieces >= 5) & (main < 0.40) & (tiny >= 12), (every >= 25) & (pieces <= 3) & (tiny >= 15), kit(pieces, tiny, main, 8)
    fine = several & ~spray & ~extreme
    groups = [
        [(soft < 0.008, "bad", "weak_mask_small_area")],
        [(c("strong_coverage") < 0.004, "bad", "weak_mask_low_opacity")],
        [(soft > 0.55, "bad", "mask_near_full_frame"), (soft > 0.45, "warn", "mask_near_full_frame")],
        [((soft > 0.42) & (fill > 0.72), "warn", "mask_near_full_frame")],
        [((fill < 0.08) & (soft < 0.015), "bad", FRAGMENTED), ((fill < 0.12) | (fill < least_fill), "warn", FRAGMENTED)],
        [((fog >= 0.65) & (solid < 0.35), "bad", "foggy_soft_mask"), ((fog >= 0.50) & (solid < 0.42), "warn", "foggy_soft_mask")],
        [(solid < 0.18, "bad", "weak_mask_low_opacity"), (solid < 0.30, "warn", "weak_mask_low_opacity")],
        [(alpha < least_alpha - 25, "bad", "weak_mask_mean_alpha"), (alpha < least_alpha, "warn", "weak_mask_mean_alpha")],
        [((c("bbox_aspect") > 16) & (soft < 0.06), "bad", "bbox_implausibly_thin")],
        [(fine, "good", "multi_object_ok")],
        [
            (fine & (pieces >= 6) & (main < 0.25), "warn", FRAGMENTED), (fine, "-", ""), (spray | extreme | ((pieces >= 5) & (main < 0.22) & (tiny >= 14)), "bad", FRAGMENTED),
            (((pieces >= 3) & (main < 0.30) & (tiny >= 8)) | ((pieces >= 4) & (main < 0.28)), "warn", FRAGMENTED),
        ],
        [(((main >= 0.85) & (pieces <= 2)) | several, "good", "strong_main_component")],
        [(holes.between(0.05, 0.55) & (hole_pixels >= 200) & (solid >= 0.45), "good", "legitimate_holes"), ((holes >= 0.22) & (hole_pixels >= 25_000) & (solid < 0.40), "bad", FRAGMENTED), ((holes >= 0.45) & (hole_pixels >= 12_000) & (solid < 0.45), "warn", FRAGMENTED)],
        [((solid >= 0.70) & (alpha >= 160), "good", "opaque_core")],
        [(soft.between(0.04, 0.45) & (solid >= 0.65), "good", "plausible_coverage")],
    ]
    made, empty = spoken(groups), soft <= 0
    return {k: F.when(empty, F.array(F.lit("empty_mask")) if k == "bads" else tags.none()).otherwise(v) for k, v in made.items()}


def cutout(c, difficult: Column) -> dict[str, Column]:
    fog, solid, seen, spread, white, band, band_alpha = c("fog_of_fg"), c("solid_of_fg"), c("visibility"), c("solid_std"), c("near_white_in_solid"), c("edge_band_frac"), c("edge_band_mean_alpha")
    return spoken([
        [((fog >= 0.70) & (solid < 0.30), "bad", FOG_EDGES), ((fog >= 0.55) & (solid < 0.38), "warn", FOG_EDGES)],
        [((seen < 8) | ((seen < 14) & (white >= 0.75)) | ((white >= 0.90) & (spread < 10) & (seen < 22)), "bad", FADED), (difficult & (white >= 0.85) & (seen < 18), "warn", FADED), (difficult & (seen < 18) & (spread < 12), "warn", "low_object_contrast")],
        [((seen >= 40) & (solid >= 0.55) & (fog < 0.35), "good", "strong_visibility")],
        [((seen >= 80) & (white < 0.15), "good", "dark_high_contrast")],
        [((band >= 0.35) & (band_alpha < 85), "bad", FOG_EDGES), ((band >= 0.28) & (band_alpha < 90) & (fog >= 0.45), "warn", FOG_EDGES), ((band < 0.15) & (band_alpha >= 100), "good", "coherent_edges")],
        [((c("roi_solid_fill") >= 0.45) & (solid >= 0.60), "good", "solid_roi")],
    ])


def studio(c, difficult: Column) -> dict[str, Column]:
    seen, mean, spread, fill, grey, dark = c("product_visibility"), c("product_mean"), c("product_std"), c("studio_roi_fill"), c("light_grey_frac"), c("dark_frac")
    pieces, main, tiny, haze = c("n_dark_components"), c("main_dark_frac"), c("n_dark_tiny"), c("edge_inner_light_frac")
    spray, several = (pieces >= 5) & (main < 0.35) & (tiny >= 10), kit(pieces, tiny, main, 6)
    fine, split = several & ~spray, pieces >= 2
    return spoken([
        [((seen < 10) | ((mean >= 248) & (spread <= 6)) | ((mean >= 244) & (spread <= 8) & (seen < 14)), "bad", "final_washed_out"), (difficult & (seen < 16) & (spread <= 12) & (fill < 0.25), "warn", "final_bright_product_vanished")],
        [((grey >= 0.85) & (spread < 12) & (seen < 22), "bad", FADED), ((grey >= 0.80) & (seen < 18) & (spread < 14), "warn", FADED)],
        [((dark >= 0.04) & (seen >= 50), "good", "dark_on_white")],
        [((seen >= 40) & (grey < 0.25) & (fill >= 0.30), "good", "readable_product")],
        [(fine, "good", "multi_object_ok")],
        [
            (fine & (pieces <= 3) & (main >= 0.55), "good", "coherent_dark_core"), (fine, "-", ""), (spray | ((pieces >= 8) & (main < 0.30)) | (split & (main < 0.35) & (tiny >= 12)), "bad", FRAGMENTED),
            (split & (main < 0.62) & (tiny >= 6), "warn", FRAGMENTED), ((pieces <= 2) & (main >= 0.70), "good", "coherent_dark_core"),
        ],
        [(c("bg_dirty_frac") >= 0.06, "warn", "dirty_background")],
        [(c("bg_shadow_frac") >= 0.045, "warn", "large_background_shadow")],
        [((dark < 0.05) & (haze >= 0.55) & (grey >= 0.45), "bad", FOG_EDGES), ((dark < 0.05) & (haze >= 0.48) & difficult & (grey >= 0.40), "warn", FOG_EDGES)],
    ])


def structure(c) -> dict[str, Column]:
    loss, edge, texture, middle, dark, light = c("structure_loss"), c("edge_drop"), c("texture_loss"), c("midtone_loss"), c("dark_loss"), c("light_body_loss")
    collapsed, checked = c("collapsed_regions"), c("checked_regions")
    selective = (middle >= 0.40) & (dark <= 0.22)
    pale = (light >= 0.55) & (dark <= 0.20) & (loss >= 0.20) & (middle >= 0.28) & (c("light_body_pixels") >= 1500)
    shape = (checked >= 2) & (collapsed >= F.greatest(F.lit(2), F.floor((checked + 1) / 2)))
    hard = (loss >= 0.38) | ((edge >= 0.45) & (texture >= 0.28)) | (selective & (loss >= 0.24)) | pale | (shape & (loss >= 0.24))
    return spoken([
        [(hard, "bad", CATASTROPHE), ((loss >= 0.24) | (edge >= 0.28), "warn", CATASTROPHE), (texture >= 0.42, "bad", CATASTROPHE), (texture >= 0.28, "warn", CATASTROPHE)],
        [((loss <= 0.12) & (edge <= 0.15), "good", "structure_preserved")],
        [((c("edge_retention") >= 0.80) & (loss <= 0.18), "good", "edges_retained")],
    ])


def evidence_confidence(c, mode: Column, unreliable: Column) -> Column:
    """How far the spatial evidence can be trusted."""
    n, soft, overlap, formed = c("evidence_pixels"), F.greatest(F.lit(1.0), c("soft_pixels")), c("overlap"), c("structured_evidence_frac")
    high = ~unreliable & (mode == "independent_prior") & (c("prior_frac") <= 0.42) & (overlap >= 0.35)
    middle = ((formed >= 0.55) & (c("prior_shadow_excluded") < 0.08) & (overlap >= 0.40) & (n <= soft * 2.8)) | ((formed >= 0.40) & (overlap >= 0.50) & (n <= soft * 2.2))
    return F.when(n < 120, "LOW").when(high, "HIGH").when(middle, "MEDIUM").otherwise("LOW")


def large_loss(missing: Column, lost_cells: Column, lost_share: Column, wipe: Column, survival: Column, confidence: Column, evidence: Column) -> Column:
    """Whether a large connected part of the product is gone; survival from 0 to 1."""
    return (
        ((missing >= 0.18) & (lost_cells >= 4) & (wipe >= 0.12) & (survival <= 0.88)) | ((missing >= 0.28) & (lost_cells >= 6) & (survival <= 0.92))
        | ((lost_share >= 0.30) & (missing >= 0.15) & (wipe >= 0.18)) | ((confidence == "HIGH") & (survival <= 0.74) & (wipe >= 0.20) & (evidence >= 400))
    )


def integrity(c, toned: Column | None = None) -> dict[str, Column]:
    """The four scores before the spatial corrections, and the whole, from shares of pixels; ``toned``: whether the middle tones are enough to judge."""
    wipe, texture, edge, keep = c("prior_wipe_frac"), c("texture_ratio"), c("edge_energy_ratio"), c("strong_edge_keep")
    selective = (c("mid_prior_wipe") >= 0.38) & (c("dark_prior_wipe") <= 0.25) & (F.lit(True) if toned is None else toned)
    shape = clamp(100.0 * c("prior_kept_frac") - 55.0 * F.greatest(F.lit(0.0), wipe - 0.18) - F.when(selective, 35.0).otherwise(0.0))
    detail = 50.0 * F.least(F.lit(1.15), texture) + 50.0 * F.least(F.lit(1.15), edge)
    detail = clamp(F.when(texture < 0.32, F.least(detail, F.lit(28.0))).when(texture < 0.55, F.least(detail, F.lit(55.0))).otherwise(detail))
    edges = clamp(F.when(keep < 0.40, F.least(100.0 * keep, F.lit(30.0))).otherwise(100.0 * keep))
    white = F.greatest(c("whiteout_frac"), c("blown_frac"))
    over = 100.0 - 120.0 * F.greatest(c("whiteout_frac"), 1.2 * c("blown_frac"))
    over = clamp(F.when(white >= 0.28, F.least(over, F.lit(22.0))).otherwise(over))
    whole = 0.30 * shape + 0.20 * detail + 0.15 * edges + 0.15 * over + 0.20 * F.least(F.lit(100.0), c("foreground_survival_score"))
    found = spoken([
        [(wipe >= 0.38, "-", ""), (wipe >= 0.18, "warn", "structure_integrity_warn")], [(texture < 0.32, "bad", "detail_destroyed"), (texture < 0.55, "warn", "detail_retention_warn")],
        [(keep < 0.40, "bad", "edge_structure_lost"), (keep < 0.62, "warn", "edge_consistency_warn")], [(white >= 0.28, "bad", "product_whiteout"), (white >= 0.12, "warn", "product_whiteout_warn")],
        [((shape >= 85) & (detail >= 75) & (edges >= 80) & (over >= 80) & (c("foreground_survival_score") >= 80), "good", "raw_final_integrity_ok")],
    ])
    return {"structure_preservation_score": shape, "detail_retention_score": detail, "raw_final_edge_consistency_score": edges, "foreground_overexposure_score": over, "raw_final_integrity": whole} | found
