"""Thresholds of the decision engine.  Fixed values: they must be these for the same decisions."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class DecisionConfig:
    pass_min: float = 76.0
    pass_min_after_rescue: float = 72.0
    second_pass_min: float = 58.0
    core_pass_min: float = 74.0
    core_second_pass_min: float = 56.0
    core_blend: float = 0.85
    halo_blend: float = 0.08
    integrity_floor: float = 62.0
    structure_floor: float = 58.0
    overexposure_floor: float = 55.0
    structure_loss: tuple[float, float] = (0.22, 0.42)
    edge_drop: tuple[float, float] = (0.26, 0.50)
    background_dirt: tuple[float, float] = (0.012, 0.06)
    shadow: tuple[float, float] = (0.008, 0.045)
    kit_components: tuple[int, int] = (2, 12)
    kit_main: float = 0.06
    roi_fill: tuple[float, float] = (0.08, 0.94)
    instant_structure_loss: float = 0.48
    instant_integrity: float = 28.0
    instant_tags: tuple[str, ...] = ("empty_mask", "final_too_white_small_product", "final_washed_out", "product_faded", "product_whiteout", "empty_or_tiny_foreground")
    core_weights: dict[str, float] = field(
        default_factory=lambda: {
            "object_completeness": 0.14, "structure_preservation": 0.18, "detail_retention": 0.14, "edge_integrity": 0.10, "raw_final_edge_consistency": 0.12,
            "foreground_overexposure": 0.14, "segmentation_confidence": 0.08, "background_purity": 0.06, "color_preservation": 0.04,
        }
    )
    aesthetic_weights: dict[str, float] = field(default_factory=lambda: {"composition": 0.25, "exposure": 0.25, "sharpness": 0.25, "shadow": 0.25})
    #: ``falsy``: a measured zero counts as not measured; ``strict``: only null does.
    missing: str = "falsy"
