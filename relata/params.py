"""Parameters of the operators, as frozen records with their defaults."""

from __future__ import annotations

from dataclasses import dataclass


# Categories too general to name one object.
GENERIC_CATEGORIES = ("baseboard", "ceiling", "floor", "object", "wall")


@dataclass(frozen=True)
class AuditRules:
    """When an instance is valid for measuring, natural to name, and away from the border."""

    minimum_side_px: float = 20.0
    minimum_area_px2: float = 1000.0
    maximum_coverage: float = 0.5
    border_margin_px: float = 5.0
    generic_categories: tuple[str, ...] = GENERIC_CATEGORIES
    caption_required: bool = False
    box_field: str = "box_2d_rend"
    uniqueness_scope: str = "all"  # all, geometric or oracle
    interior_mode: str = "box"  # box or center
    margin_kind: str = "pixels"  # pixels or fraction


@dataclass(frozen=True)
class RankRules:
    minimum_oracle: int = 8
    minimum_natural: int = 6
    minimum_natural_interior: int = 3
    sharpness_quantile: float = 0.75
    per_bin: int | None = 1
    per_capture: int | None = 5


@dataclass(frozen=True)
class PairRules:
    """Thresholds of the hard pair filter; None leaves a threshold out."""

    minimum_distance_m: float = 0.25
    minimum_visible_fraction: float = 1.0
    maximum_box_iou: float = 0.5
    maximum_intersection_over_smaller: float = 0.8
    minimum_box_area_fraction: float | None = 0.00375
    minimum_box_side_px: float | None = 30.0
    minimum_border_margin_px: float | None = 20.0


@dataclass(frozen=True)
class SceneRules:
    pairs_per_scene: int = 12
    distance_strata: int = 3
    minimum_unique_objects: int = 6
    maximum_uses_per_object: int = 5
    minimum_distance_ratio: float = 2.5


STRATUM_NAMES = ("short", "medium", "long")
EPSILON = 1e-12


def rule_contradictions(pair: PairRules, scene: SceneRules, both_objects_interior: bool | None, minimum_eligible_pairs: int, pairs_per_stratum: int) -> list[str]:
    """In what a frozen rule set contradicts itself; empty if it does not."""
    found = []
    if both_objects_interior is not True:
        found.append("both_objects_interior")
    if minimum_eligible_pairs != scene.pairs_per_scene:
        found.append("minimum_eligible_pairs")
    if pairs_per_stratum * scene.distance_strata != scene.pairs_per_scene:
        found.append("pairs_per_stratum")
    numbers = [v for v in (*vars(pair).values(), *vars(scene).values()) if v is not None]
    if not all(float("-inf") < v < float("inf") for v in numbers):
        found.append("not_finite")
    return found
