"""The decision engine once more, as SQL for DuckDB: an independent form to hold the Spark one against.

``engine_sql(items)`` reads a table of schema ``plans.schemas.ITEM`` and goes the engine's way in common table expressions.
"""

from __future__ import annotations

from lumenqc.plans.config import DecisionConfig
from lumenqc.plans.decision import CATASTROPHE, DESTROYED, FRAGMENTED, LARGE, REASONS, REJECT

BLOCKS = ("mask", "cutout", "studio", "structure", "raw_final")


def g(path: str, default: float | str = 0.0) -> str:
    """A measurement, where zero counts as missing."""
    return f"coalesce(nullif({path}, 0), {default})"


def ramp(x: str, soft: float, hard: float, most: float) -> str:
    return f"(CASE WHEN ({x}) <= {soft} THEN 0.0 WHEN ({x}) >= {hard} THEN {float(most)} ELSE {most} * (({x}) - {soft}) / {hard - soft} END)"


def iff(when: str, a: str | float, b: str | float = "0.0") -> str:
    return f"(CASE WHEN {when} THEN {a} ELSE {b} END)"


def clamp(x: str) -> str:
    return f"greatest(0.0, least(100.0, {x}))"


def has(tags: str, *names: str) -> str:
    return "(" + " OR ".join(f"list_contains({tags}, '{n}')" for n in names) + ")"


def raised(*rules: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in rules) + "], lambda x: x IS NOT NULL)"


def added(tags: str, tag: str, when: str) -> str:
    return iff(f"({when}) AND NOT {has(tags, tag)}", f"list_append({tags}, '{tag}')", tags)


def removed(tags: str, tag: str, when: str) -> str:
    return iff(when, f"list_filter({tags}, lambda x: x <> '{tag}')", tags)


def distinct(tags: str) -> str:
    return f"list_filter({tags}, lambda x, i: list_position({tags}, x) = i)"


def lists(kind: str) -> str:
    return distinct("(" + " || ".join(f"coalesce({b}.{kind}, [])" for b in BLOCKS) + ")")


def weighted(weights: dict[str, float]) -> str:
    total = sum(weights.values())
    return " + ".join(["0.0", *(f"s_{k} * {w / total!r}" for k, w in weights.items())])


SURE = "upper(CASE WHEN raw_final.spatial_evidence_confidence IS NULL OR raw_final.spatial_evidence_confidence = '' THEN 'LOW' ELSE raw_final.spatial_evidence_confidence END)"
CONFIRMED = f"({SURE} = 'HIGH' OR {g('raw_final.spatial_verified')} >= 0.5)"
DARK = has("posits", "dark_on_white", "dark_high_contrast")
KEEP = g("raw_final.strong_edge_keep", "(edge_rf / 100.0)")
SIGNS = (
    "struct_p < 50", f"edge_rf < 55 OR {KEEP} < 0.55", f"detail < 55 OR {has('bads', 'detail_destroyed')}", f"over < 55 OR {g('raw_final.whiteout_frac')} >= 0.20 OR {has('bads', 'product_whiteout')}",
    f"loss >= 0.35 OR {g('structure.midtone_loss')} >= 0.40 OR {g('structure.edge_drop')} >= 0.40",
    f"{g('raw_final.prior_wipe_frac')} >= 0.38 AND {g('raw_final.prior_kept_frac', 1.0)} < 0.45 AND {g('raw_final.prior_unreliable')} < 0.5 AND (edge_rf < 70 OR {KEEP} < 0.65 OR loss >= 0.28)",
    "large >= 0.5 AND upper(coalesce(raw_final.spatial_evidence_confidence, '')) IN ('HIGH', 'MEDIUM')",
)
CORROBORATED = f"({g('raw_final.destruction_signal_count')} >= 2 OR " + " + ".join(f"({s})::INT" for s in SIGNS) + " >= 2)"


def scores() -> tuple[dict[str, str], str]:
    """Subscores, and all tags that they raise in order; they read m, c, s, t: short names of measurements, made before."""
    bad, warn, good = (lambda *n: has("bads", *n)), (lambda *n: has("warns", *n)), (lambda *n: has("posits", *n))
    frag, several = bad(FRAGMENTED), f"(is_kit OR {good('multi_object_ok')})"
    lost, worst = f"({bad(LARGE)} AND sure = 'HIGH' AND large >= 0.5)", f"({bad(CATASTROPHE)} AND loss >= 0.48)"
    half, seen = "(sure = 'MEDIUM' AND survival < 72 AND missing >= 0.20)", f"(NOT {lost} AND sure = 'HIGH')"
    named, foggy, washed = bad(CATASTROPHE), bad("foggy_alpha_edges"), bad("final_washed_out", "product_faded")
    mask = f"""84.0 - {iff("soft > 0.55", 28.0)} - {iff("soft > 0.45 AND soft <= 0.55", 10.0)} - {ramp("fog", 0.50, 0.75, 24)} - {ramp("1.0 - solid_of_soft", 0.50, 0.88, 26)} - {ramp("greatest(0.0, 110.0 - alpha)", 0.0, 55.0, 18)}
    - {ramp("greatest(0.0, 0.15 - roi)", 0.0, 0.12, 12)} + {iff(good("strong_main_component", "multi_object_ok"), 6.0)} + {iff(good("opaque_core"), 5.0)} + {iff(good("plausible_coverage"), 3.0)} + {iff(good("legitimate_holes"), 4.0)}
    - {iff(f"{frag} AND {several}", 4.0)} - {iff(f"{frag} AND NOT {several}", 18.0)} - {iff(f"NOT {frag} AND {warn(FRAGMENTED)}", 5.0)}"""
    edge = f"86.0 - {ramp('edge_fog', 0.55, 0.80, 28)} - {ramp('haze', 0.50, 0.75, 22)} - {iff(foggy, 16.0)} - {iff(f'NOT {foggy} AND ' + warn('foggy_alpha_edges'), 6.0)}"
    whole = f"90.0 - {ramp('loss', 0.22, 0.42, 42)} - {ramp('edge_drop', 0.26, 0.50, 28)} - {ramp('midtone', 0.40, 0.65, 18)} - {iff('pieces >= 3', 'least(18.0, pieces * 5.0)')}"
    whole = iff(lost, f"least({whole}, 35.0)", whole)
    whole = f"{whole} - {iff(f'{seen} AND survival < 90', ramp('greatest(0.0, 85.0 - survival)', 0.0, 45.0, 22))} - {iff(f'{seen} AND missing >= 0.14', 'least(22.0, missing * 80.0)')} - {iff(half, 8.0)}"
    whole = f"""{iff(worst, f"least({whole}, 28.0)", whole)} - {iff(f"{named} AND NOT {worst}", 22.0)} - {iff(f"NOT {named} AND {warn(CATASTROPHE)}", 8.0)}
    + {iff(good("structure_preserved"), 8.0)} + {iff(good("edges_retained"), 5.0)} + {iff(good("legitimate_holes"), 3.0)} + {iff(f"main7 >= 0.70 OR {good('multi_object_ok')}", 3.0)}"""
    ground = f"92.0 - {iff('dirt >= 0', ramp('dirt', 0.012, 0.06, 40), ramp('grey', 0.80, 0.95, 30))}"
    ground = f"{iff(washed, f'least({ground}, 22.0)', ground)} - {iff(f'NOT {washed} AND ' + warn('product_faded'), 10.0)}"
    shadow = f"94.0 - {iff('shade >= 0.008', ramp('shade', 0.008, 0.045, 35))}"
    place = f"90.0 - {iff('fill < 0.08', ramp('0.08 - fill', 0.0, 0.12, 15))} - {iff('fill > 0.94', 6.0)} - {iff('box < 0.015', 12.0)} - {iff('box >= 0.015 AND box < 0.03', 4.0)} - {iff('aspect > 16', 10.0)}"
    color = f"""88.0 - {ramp("white", 0.75, 0.96, 38)} - {iff("vis < 10", 32.0)} - {iff("vis >= 10 AND vis < 16", 10.0)} - {iff("spread20 < 5 AND vis < 22", 14.0)} + {iff(DARK, 6.0)} + {iff(good("strong_visibility"), 4.0)}"""
    light = "starts_with(profile, 'LIGHT')"
    ghost, burnt, ring = "vis < 12", f"(mean >= 248 AND NOT {light})", "(band < 55 AND edge_fog > 0.45)"
    lit = clamp(f"100.0 - abs(mean - CASE WHEN starts_with(profile, 'DARK') THEN 70.0 WHEN {light} THEN 175.0 ELSE 120.0 END) * 0.22")
    lit = iff(ghost, f"least({lit}, 42.0)", lit)
    lit = iff(burnt, f"least({lit}, 40.0)", lit)
    halo = f"{clamp('93.0 - ' + ramp('edge_fog', 0.50, 0.75, 32))} - {iff(ring, 8.0)}"
    values = {
        "segmentation_confidence": iff("soft < 0.008", 5.0, clamp(mask)), "edge_integrity": clamp(edge), "object_completeness": clamp(whole), "background_purity": clamp(ground), "shadow": clamp(shadow), "composition": clamp(place),
        "color_preservation": clamp(color), "sharpness": clamp(f"{clamp('55.0 + least(40.0, spread15 * 1.2)')} - {iff('spread15 < 8', 12.0)}"), "exposure": clamp(lit), "halo": clamp(iff(foggy, f"least({halo}, 48.0)", halo)),
        "structure_preservation": "struct_p", "detail_retention": "detail", "raw_final_edge_consistency": "edge_rf", "foreground_overexposure": "over",
    }
    mask_tags = raised(
        ("soft > 0.55", "mask_near_full_frame"), ("soft > 0.45 AND soft <= 0.55", "mask_large_coverage"), ("fog >= 0.55", "foggy_mask"), (good("legitimate_holes"), "holes_preserved_ok"),
        (f"{frag} AND {several}", "multi_object_soft_note"), (f"{frag} AND NOT {several}", "mask_fragmented_bad"), (f"NOT {frag} AND {warn(FRAGMENTED)}", "mask_fragmented_soft"),
    )
    rest = raised(
        ("edge_fog >= 0.60", "soft_alpha_edges"), ("haze >= 0.55", "edge_haze"), (foggy, "foggy_alpha_edges_bad"), (f"NOT {foggy} AND {warn('foggy_alpha_edges')}", "foggy_alpha_edges_soft"),
        ("loss >= 0.22 AND loss < 0.42", "structure_loss_soft"), ("loss >= 0.42", "structure_loss_hard"), ("edge_drop >= 0.26", "edge_drop"), ("pieces >= 3", "shape_collapse"), (lost, "spatial_loss_completeness_deferred_to_block"),
        (f"{seen} AND missing >= 0.14", "largest_missing_region"), (half, "spatial_completeness_soft"), (worst, CATASTROPHE), (f"{named} AND NOT {worst}", "structure_bad_softened"), (f"NOT {named} AND {warn(CATASTROPHE)}", "structure_warn"),
        ("dirt >= 0 AND dirt >= 0.012", "mask_aware_bg_dirty"), ("dirt < 0 AND grey >= 0.85", "ghost_light_regions"), (washed, "washed_out_or_faded"), (f"NOT {washed} AND {warn('product_faded')}", "mild_fade"),
        ("shade >= 0.045", "large_bg_shadow"), ("shade >= 0.008 AND shade < 0.045", "mild_bg_shadow"), ("fill < 0.08", "product_sparse_in_roi"), ("fill > 0.94", "product_fills_roi_tight"), ("box < 0.015", "tiny_on_canvas"),
        ("aspect > 16", "extreme_aspect"), ("white >= 0.80", "solid_near_white"), ("vis < 10", "low_visibility"), ("spread20 < 5 AND vis < 22", "flat_washed_product"),
        ("spread15 < 8", "low_texture_std"), (ghost, "underexposed_or_ghost"), (burnt, "overexposed_product"), (ring, "halo_ring"),
    )
    return values, f"{iff('soft < 0.008', '''['mask_empty_or_tiny']''', mask_tags)} || {rest}"


def bounds(c: DecisionConfig) -> list[tuple[str, str, str, str | None]]:
    """(condition, core, final, tag), in order."""
    up, bad = (lambda x, n: f"least(100.0, {x} + {n})"), (lambda *n: has("bads", *n))
    rest = c.second_pass_min - 1.0
    return [
        (has("posits", "raw_final_integrity_ok"), up("core", 1.5), up("final", 2.0), None), (f"{DARK} AND integrity >= 70", "core", up("final", 1.5), None),
        (f"{has('posits', 'multi_object_ok')} AND integrity >= 65", "core", up("final", 1.0), "multi_object_boost"),
        (f"{bad('mask_near_full_frame')} AND soft > 0.55", "least(core, 60.0)", "least(final, 62.0)", "cap_full_frame_mask_severe"),
        (f"{bad('foggy_soft_mask')} AND {bad('foggy_alpha_edges')}", "core", "least(final, 58.0)", "cap_severe_fog"), (f"{bad(CATASTROPHE)} AND loss >= 0.42", "least(core, 48.0)", "least(final, 50.0)", "cap_structure_bad_severe"),
        (f"integrity < {c.integrity_floor}", "least(core, integrity + 8)", f"least(final, greatest(integrity + 5, {rest}))", "integrity_floor_cap"), (f"struct_p < {c.structure_floor}", "least(core, struct_p + 6)", "final", "structure_floor_cap"),
        (f"over < {c.overexposure_floor}", "least(core, over + 8)", f"least(final, greatest(over + 10, {rest}))", "overexposure_floor_cap"),
        (f"{bad(FRAGMENTED)} AND NOT {has('posits', 'multi_object_ok')} AND NOT is_kit", "core", "least(final, greatest(56.0, final - 8))", "frag_noise_penalty"),
    ]


def engine_sql(items: str, c: DecisionConfig | None = None) -> str:
    """Common table expressions; the last, ``reports``, has a row an item."""
    c = c or DecisionConfig()
    n, main = g("mask.n_significant_components", 1.0), g("mask.main_component_frac", 1.0)
    kit = f"({n} BETWEEN 2 AND 12 AND NOT ({g('mask.n_solid_components', n)} >= 20 AND {n} <= 2) AND {main} >= {c.kit_main})"
    severe = f"(({g('mask.n_tiny_components')} >= 12 AND {main} < 0.35) OR ({n} >= 8 AND {main} < 0.22))"
    holes = f"({has('posits', 'legitimate_holes')} OR {g('mask.hole_frac')} >= 0.08)"
    profile = f"""CASE WHEN floor({n}) >= 2 AND ({has("posits", "multi_object_ok")} OR NOT {has("bads", FRAGMENTED)}) THEN 'MULTI_OBJECT' WHEN {holes} AND {DARK} THEN 'DARK_OBJECT_WITH_HOLES' WHEN {holes} THEN 'OPEN_FRAME' WHEN {DARK} THEN 'DARK_OBJECT'
    WHEN {g("studio.product_mean", 128.0)} >= 175 OR {g("studio.light_grey_frac")} >= 0.45 THEN 'LIGHT_OBJECT_ON_WHITE' WHEN {has("warns", "foggy_soft_mask", "foggy_alpha_edges")} THEN 'TRANSLUCENT_OR_REFLECTIVE' ELSE 'NORMAL' END"""
    rf = lambda name, d=0.0: g(f"raw_final.{name}", d)
    steps = [
        ("e0", f"""SELECT *, {lists("bads")} AS bads, {lists("warns")} AS all_warns, {lists("posits")} AS posits, {kit} AS is_kit, {rf("structure_preservation_score", 75.0)} AS struct_p, {rf("detail_retention_score", 75.0)} AS detail,
        {rf("raw_final_edge_consistency_score", 75.0)} AS edge_rf, {rf("foreground_overexposure_score", 80.0)} AS over, {rf(LARGE)} AS large, {rf("foreground_survival_score", 100.0)} AS survival, {rf("largest_missing_region_ratio")} AS missing,
        {g("structure.structure_loss")} AS loss, {SURE} AS sure FROM {items}"""),
        ("e1", f"""SELECT * EXCLUDE (all_warns), list_filter(all_warns, lambda x: NOT list_contains(bads, x)) AS warns, {rf("raw_final_integrity", "((struct_p + detail + edge_rf + over) / 4.0)")} AS integrity,
        (is_kit OR {has("posits", "multi_object_ok")}) AND {has("bads", FRAGMENTED)} AS hit FROM e0"""),
        ("e2", f"""SELECT * REPLACE ({removed("bads", FRAGMENTED, "hit")} AS bads, {added("warns", FRAGMENTED, "hit")} AS warns, {added("posits", "multi_object_ok", "hit")} AS posits),
        {raised(("hit", "multi_object_reclassified"))} || coalesce(raw_final.triggered, []) AS triggered FROM e1"""),
        ("e3", f"""SELECT * REPLACE ({has("bads", FRAGMENTED)} AND (NOT {severe} OR {has("posits", "multi_object_ok")} OR is_kit) AS hit), {profile} AS profile FROM e2"""),
        ("e4", f"""SELECT * REPLACE (triggered || {raised(("hit", "fragmentation_softened"))} AS triggered, {removed("bads", FRAGMENTED, "hit")} AS bads, {added("warns", FRAGMENTED, "hit")} AS warns) FROM e3"""),
        ("e5", f"SELECT *, {has('bads', DESTROYED)} AS named, {CORROBORATED} AS known FROM e4"),
        ("e6", f"""SELECT * REPLACE (triggered || {raised(("named AND known", "destruction_confirmed"), ("named AND NOT known", "destruction_false_positive_demoted"))} AS triggered, {removed("bads", DESTROYED, "named AND NOT known")} AS bads,
        {added("warns", "structure_integrity_warn", "named AND NOT known")} AS warns), named AND NOT known AND least(edge_rf, detail, over) >= 80 AND survival >= 82 AND missing < 0.12 AND NOT {has("bads", LARGE)} AS repair FROM e5"""),
        ("e7", "SELECT * REPLACE (CASE WHEN repair THEN greatest(struct_p, 72.0) ELSE struct_p END AS struct_p) FROM e6"),
        ("e8", f"""SELECT * REPLACE (CASE WHEN repair THEN whole ELSE integrity END AS integrity, triggered || {raised(("repair", "structure_score_repaired_fp"))} AS triggered), CASE WHEN repair THEN whole ELSE {rf("raw_final_integrity", 100.0)} END AS collapse,
        large >= 0.5 AS flagged, {CONFIRMED} AS sure_loss FROM (SELECT *, 0.30 * struct_p + 0.20 * detail + 0.15 * edge_rf + 0.15 * over + 0.20 * least(100.0, survival) AS whole FROM e7)"""),
        ("e9", f"""SELECT * REPLACE (triggered || {raised(("flagged AND sure_loss", "spatial_loss_retained"), ("flagged AND NOT sure_loss", "spatial_loss_demoted_low_confidence"))} AS triggered,
        {iff("flagged AND sure_loss", added("bads", LARGE, "true"), removed("bads", LARGE, "flagged AND NOT sure_loss"))} AS bads, {added("warns", "spatial_product_loss_warn", "flagged AND NOT sure_loss")} AS warns,
        CASE WHEN flagged AND NOT sure_loss THEN 0.0 ELSE large END AS large) FROM e8"""),
        ("e10", f"""SELECT *, CASE {" ".join(f"WHEN {has('bads', t)} THEN '{t}'" for t in c.instant_tags)} WHEN {has("bads", CATASTROPHE)} AND loss >= {c.instant_structure_loss} THEN '{CATASTROPHE}' WHEN {has("bads", "foreground_too_small")} THEN 'empty_or_tiny_foreground'
        WHEN raw_final IS NOT NULL AND collapse <= {c.instant_integrity} AND {has("coalesce(raw_final.bads, [])", "product_whiteout", "detail_destroyed", "empty_or_tiny_foreground")} THEN 'raw_final_integrity_collapse' END AS fatal,
        {g("mask.soft_coverage")} AS soft, {g("mask.fog_ratio")} AS fog, {g("mask.solid_of_soft", 0.5)} AS solid_of_soft, {g("mask.mean_alpha_soft", 128.0)} AS alpha, {g("mask.roi_fill", 0.5)} AS roi, {g("cutout.fog_of_fg")} AS edge_fog,
        {g("studio.edge_inner_light_frac")} AS haze, {g("structure.edge_drop")} AS edge_drop, {g("structure.midtone_loss")} AS midtone, {g("structure.collapsed_regions")} AS pieces, {g("mask.main_component_frac", 0.7)} AS main7,
        {g("studio.bg_dirty_frac", -1.0)} AS dirt, {g("studio.light_grey_frac")} AS grey, {g("studio.bg_shadow_frac", -1.0)} AS shade, {g("mask.roi_fill", g("studio.studio_roi_fill", 0.5))} AS fill, {g("mask.bbox_frac", g("studio.product_frac", 0.15))} AS box,
        {g("mask.bbox_aspect", 1.5)} AS aspect, {g("cutout.near_white_in_solid")} AS white, {g("cutout.visibility", g("studio.product_visibility", 40.0))} AS vis, {g("cutout.solid_std", g("studio.product_std", 20.0))} AS spread20,
        {g("cutout.solid_std", g("studio.product_std", 15.0))} AS spread15, {g("studio.product_mean", 128.0)} AS mean, {g("cutout.edge_band_mean_alpha", 100.0)} AS band FROM e9"""),
    ]
    values, said = scores()
    steps += [
        ("e11", f"SELECT * REPLACE (triggered || {said} AS triggered), {', '.join(f'{v} AS s_{k}' for k, v in values.items())} FROM e10"),
        ("e12", f"SELECT * REPLACE ({distinct('triggered')} AS triggered), {1.0 - c.halo_blend} * ({weighted(c.core_weights)}) + {c.halo_blend} * s_halo AS core, {weighted(c.aesthetic_weights)} AS aesthetic FROM e11"),
        ("b0", f"SELECT *, {c.core_blend} * core + {1.0 - c.core_blend} * aesthetic AS final FROM e12"),
    ]
    at = 0
    for at, (when, core, final, tag) in enumerate(bounds(c), 1):
        steps.append((f"b{at}", f"SELECT * REPLACE ({iff(when, core, 'core')} AS core, {iff(when, final, 'final')} AS final{f', triggered || {raised((when, tag))} AS triggered' if tag else ''}) FROM b{at - 1}"))
    lost = f"({has('bads', LARGE)} AND {CONFIRMED})"
    any_sign, wipe = has("bads", DESTROYED, "product_whiteout", "detail_destroyed", "edge_structure_lost", LARGE), rf("evidence_wipe_frac")
    below = f"(integrity < {c.integrity_floor} OR struct_p < {c.structure_floor} OR over < {c.overexposure_floor})"
    why = lambda k: f"'{REASONS[k]}'"
    ladder = f"""CASE WHEN blocked THEN ['review', {why("blocked")}, 'spatial_foreground_loss_review'] WHEN destroyed THEN ['review', {why("destroyed")}, 'integrity_forced_review'] WHEN integrity < 40 THEN ['review', {why("damaged")}, 'integrity_forced_review']
    WHEN integrity < {c.core_second_pass_min} THEN ['second_pass', {why("unsure")}, 'integrity_forced_second_pass'] WHEN core < {c.core_second_pass_min} AND final < {c.second_pass_min} THEN ['review', {why("core")}, NULL]
    WHEN core < {c.core_pass_min} OR final < bar THEN CASE WHEN final < {c.second_pass_min} THEN ['review', {why("score")}, NULL] WHEN core >= {c.core_second_pass_min} THEN ['second_pass', {why("core_near")}, NULL] ELSE ['second_pass', {why("score_near")}, NULL] END
    WHEN {below} THEN ['second_pass', {why("floor")}, 'integrity_pass_blocked'] ELSE ['pass', {why("fine")}, NULL] END"""
    fine = f"(core >= {c.core_pass_min + 4} AND integrity >= {c.integrity_floor + 8} AND struct_p >= {c.structure_floor + 8} AND over >= {c.overexposure_floor + 10} AND s_object_completeness >= 80)"
    clean = f"(NOT {has('bads', 'final_washed_out', 'product_faded')} AND NOT destroyed AND NOT ({has('bads', CATASTROPHE)} AND loss >= 0.42))"
    soft = f"({has('triggered', 'structure_score_repaired_contradiction', 'destruction_uncorroborated_demoted', 'structure_bad_softened')} AND integrity >= 68)"
    turn = lambda when, d, k, tag: f"SELECT * REPLACE ({iff(when, chr(39) + d + chr(39), 'decision')} AS decision, {iff(when, why(k), 'reason')} AS reason{f', triggered || {raised((when, tag))} AS triggered' if tag else ''}) FROM "
    steps += [
        ("d0", f"""SELECT *, {any_sign} AND ({CORROBORATED} OR {has("bads", "product_whiteout", "detail_destroyed")} OR {lost}) AS destroyed, CASE WHEN after_rescue THEN {c.pass_min_after_rescue} ELSE {c.pass_min} END AS bar,
        {lost} OR (sure = 'HIGH' AND ((missing >= 0.18 AND survival < 78 AND {wipe} >= 0.12) OR (survival < 74 AND {wipe} >= 0.20))) AS blocked FROM b{at}"""),
        ("d1", f"SELECT * REPLACE ({added('bads', LARGE, 'blocked')} AS bads, CASE WHEN step[3] IS NULL THEN triggered ELSE list_append(triggered, step[3]) END AS triggered), step[1] AS decision, step[2] AS reason FROM (SELECT *, {ladder} AS step FROM d0)"),
        ("d2", turn(f"decision = 'review' AND final >= {c.second_pass_min - 2} AND core >= 50 AND NOT destroyed", "second_pass", "near_bar", None) + "d1"),
        ("d3", turn(f"decision = 'second_pass' AND {fine} AND {clean}", "pass", "strong", "core_quality_pass_override") + "d2"),
        ("d4", turn(f"decision = 'pass' AND (destroyed OR blocked OR {lost})", "review", "lost", "destruction_blocks_pass") + "d3"),
        ("d5", f"SELECT *, decision = 'pass' AND {has('bads', CATASTROPHE)} AND s_object_completeness < 40 AS partly, {soft} AS softened FROM d4"),
        ("d6", f"SELECT * REPLACE (triggered || {raised(('partly AND softened', 'incomplete_product_softened'))} AS triggered) FROM d5"),
        ("d7", turn("partly AND NOT softened", "review", "incomplete", "incomplete_product_review") + "d6"),
        ("reports", f"""SELECT filename, CASE WHEN fatal IS NULL THEN decision ELSE 'review' END AS decision, {", ".join(f"round_even(CASE WHEN fatal IS NULL THEN {k} ELSE {REJECT[f'{k}_score']} END, 2) AS {k}_score" for k in ("final", "core", "aesthetic"))},
        profile AS processing_profile, CASE WHEN fatal IS NULL THEN reason ELSE '{REASONS["instant"]}' || fatal END AS reason, CASE WHEN fatal IS NULL THEN triggered ELSE ['instant_reject:' || fatal] END AS triggered_rules, bads, warns, posits,
        CASE WHEN fatal IS NOT NULL OR decision = 'review' THEN 'high_bad' WHEN decision = 'pass' THEN 'high_good' ELSE 'uncertain' END AS zone, round_even(integrity, 2) AS integrity FROM d7"""),
    ]
    return ",\n".join(f"{name} AS ({body})" for name, body in steps)
