from pyspark.sql import functions as F

from lumenqc.plans import gates

#: Measurements under which no rule of the mask gate complains: each well inside its bounds.
MASK = dict(soft_coverage=0.25, strong_coverage=0.19, solid_of_soft=0.76, roi_fill=0.62, fog_ratio=0.24, mean_alpha_soft=171.0, main_component_frac=0.87, n_significant_components=1.0, n_tiny_components=0.0, n_solid_components=1.0, hole_frac=0.0, hole_pixels=0.0, bbox_aspect=2.1)


def said(spark, gate, rows, *more):
    names = sorted(rows[0])
    table = spark.createDataFrame([tuple(float(r[n]) for n in names) for r in rows], ", ".join(f"{n} double" for n in names))
    made = gate(F.col, *more)
    return [(r.bads, r.warns, r.posits) for r in table.select(*(made[k].alias(k) for k in ("bads", "warns", "posits"))).collect()]


def test_mask_gate(spark):
    rows = [MASK, MASK | dict(soft_coverage=0.0), MASK | dict(soft_coverage=0.6, roi_fill=0.8), MASK | dict(n_significant_components=5.0, main_component_frac=0.25), MASK | dict(n_significant_components=5.0, main_component_frac=0.05, n_tiny_components=20.0), MASK | dict(hole_frac=0.2, hole_pixels=900.0), MASK | dict(roi_fill=0.05, soft_coverage=0.01)]
    found = said(spark, gates.mask, rows, F.lit(False))
    assert found[0] == ([], [], ["strong_main_component", "opaque_core", "plausible_coverage"])
    assert found[1] == (["empty_mask"], [], [])
    assert found[2][:2] == (["mask_near_full_frame"], ["mask_near_full_frame"])
    assert "multi_object_ok" in found[3][2]
    assert not found[3][1]
    assert found[4][0] == ["foreground_fragmented"]
    assert "legitimate_holes" in found[5][2]
    assert found[6][0] == ["foreground_fragmented"]


def test_cutout_and_studio_gates(spark):
    good = dict(fog_of_fg=0.1, solid_of_fg=0.8, visibility=90.0, solid_std=30.0, near_white_in_solid=0.05, edge_band_frac=0.05, edge_band_mean_alpha=150.0, roi_solid_fill=0.5)
    found = said(spark, gates.cutout, [good, good | dict(visibility=5.0), good | dict(fog_of_fg=0.8, solid_of_fg=0.2)], F.lit(False))
    assert found[0] == ([], [], ["strong_visibility", "dark_high_contrast", "coherent_edges", "solid_roi"])
    assert found[1][0] == ["product_faded"]
    assert found[2][0] == ["foggy_alpha_edges"]
    shown = dict(product_visibility=80.0, product_mean=60.0, product_std=40.0, studio_roi_fill=0.5, light_grey_frac=0.05, dark_frac=0.1, n_dark_components=1.0, main_dark_frac=0.9, n_dark_tiny=0.0, edge_inner_light_frac=0.0, bg_dirty_frac=0.0, bg_shadow_frac=0.0)
    found = said(spark, gates.studio, [shown, shown | dict(product_mean=250.0, product_std=4.0), shown | dict(bg_dirty_frac=0.1, bg_shadow_frac=0.05)], F.lit(False))
    assert found[0] == ([], [], ["dark_on_white", "readable_product", "coherent_dark_core"])
    assert found[1][0] == ["final_washed_out"]
    assert found[2][1] == ["dirty_background", "large_background_shadow"]


def test_structure_gate_and_integrity(spark):
    kept = dict(structure_loss=0.05, edge_drop=0.05, texture_loss=0.05, midtone_loss=0.0, dark_loss=0.0, light_body_loss=0.0, light_body_pixels=0.0, collapsed_regions=0.0, checked_regions=0.0, edge_retention=0.95)
    found = said(spark, gates.structure, [kept, kept | dict(structure_loss=0.4), kept | dict(structure_loss=0.25), kept | dict(texture_loss=0.5), kept | dict(structure_loss=0.25, checked_regions=3.0, collapsed_regions=2.0)])
    assert found[0] == ([], [], ["structure_preserved", "edges_retained"])
    assert [bool(f[0]) for f in found] == [False, True, False, True, True]
    assert found[2][1] == ["catastrophic_structure_loss"]
    whole = dict(prior_wipe_frac=0.0, prior_kept_frac=1.0, mid_prior_wipe=0.0, dark_prior_wipe=0.0, texture_ratio=1.0, edge_energy_ratio=1.0, strong_edge_keep=0.95, whiteout_frac=0.0, blown_frac=0.0, foreground_survival_score=100.0)
    names = sorted(whole)
    rows = [whole, whole | dict(texture_ratio=0.2, strong_edge_keep=0.3, whiteout_frac=0.4)]
    table = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} double" for n in names))
    good, lost = table.select(*(v.alias(k) for k, v in gates.integrity(F.col).items())).collect()
    assert abs(good.raw_final_integrity - 99.25) < 1e-9
    assert good.posits == ["raw_final_integrity_ok"]
    assert lost.bads == ["detail_destroyed", "edge_structure_lost", "product_whiteout"]
    assert (lost.detail_retention_score, lost.raw_final_edge_consistency_score, lost.foreground_overexposure_score) == (28.0, 30.0, 22.0)


def test_confidence_and_large_loss(spark):
    c = lambda name: F.lit({"evidence_pixels": 500.0, "soft_pixels": 600.0, "overlap": 0.6, "structured_evidence_frac": 0.6, "prior_frac": 0.3, "prior_shadow_excluded": 0.0}[name])
    row = spark.range(1).select(gates.evidence_confidence(c, F.lit("independent_prior"), F.lit(False)).alias("a"), gates.evidence_confidence(c, F.lit("other"), F.lit(True)).alias("b"))
    assert tuple(row.first()) == ("HIGH", "MEDIUM")
    x = lambda *v: gates.large_loss(*(F.lit(y) for y in v))
    row = spark.range(1).select(x(0.2, 5, 0.1, 0.15, 0.8, "LOW", 500), x(0.1, 2, 0.1, 0.05, 0.95, "HIGH", 500), x(0.1, 2, 0.1, 0.25, 0.7, "HIGH", 500))
    assert tuple(row.first()) == (True, False, True)
