"""Input schema of the decision engine: five blocks of measurements and tags."""

from __future__ import annotations

from pyspark.sql import types as T

# The measurements of each block.
MEASURES = {
    "mask": "soft_coverage solid_of_soft fog_ratio mean_alpha_soft roi_fill bbox_frac bbox_aspect main_component_frac n_significant_components n_solid_components n_tiny_components hole_frac",
    "cutout": "fog_of_fg visibility solid_std near_white_in_solid edge_band_mean_alpha",
    "studio": "product_frac studio_roi_fill product_mean product_std product_visibility light_grey_frac bg_dirty_frac bg_shadow_frac edge_inner_light_frac",
    "structure": "structure_loss edge_drop midtone_loss collapsed_regions",
    "raw_final": "structure_preservation_score detail_retention_score raw_final_edge_consistency_score foreground_overexposure_score raw_final_integrity prior_unreliable prior_kept_frac prior_wipe_frac strong_edge_keep whiteout_frac destruction_signal_count foreground_survival_score evidence_wipe_frac largest_missing_region_ratio large_contiguous_foreground_loss spatial_verified",
}
TEXTS = {"raw_final": ["spatial_evidence_confidence"]}
LISTS = {b: ["bads", "warns", "posits"] + ["triggered"] * (b == "raw_final") for b in MEASURES}


def block(name: str) -> T.StructType:
    fields = [T.StructField(x, T.DoubleType()) for x in MEASURES[name].split()]
    fields += [T.StructField(x, T.StringType()) for x in TEXTS.get(name, [])]
    return T.StructType(fields + [T.StructField(x, T.ArrayType(T.StringType())) for x in LISTS[name]])


ITEM = T.StructType([T.StructField("filename", T.StringType()), T.StructField("after_rescue", T.BooleanType()), *(T.StructField(n, block(n)) for n in MEASURES)])
