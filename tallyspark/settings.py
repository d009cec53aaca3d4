"""Analysis thresholds. Fixed values of the published analysis, overridable per call."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    area_constant: float = 0.005454
    sapling_min_dia: float = 1.0
    tree_min_dia: float = 5.0
    gap_quantile: float = 2 / 3
    gap_sensitivity_quantile: float = 0.75
    minimum_map_n: int = 20
    maximum_correlation: float = 0.70
    minimum_groups_for_random_effect: int = 30
    minimum_events_per_parameter: float = 10.0
    minimum_overlap: float = 0.90
    grouped_folds: int = 5
    frame_tolerance: float = 1e-4
    interval_bounds: tuple[float, float] = (4.5, 8.5)
    season_lookback: int = 3
    ridge_penalty: float = 1.0
    capacities: tuple[float, ...] = (0.1, 0.25, 0.5)


DEFAULTS = Settings()
