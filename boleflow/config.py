"""Parameters that change results, with their defaults, and JSON overrides."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    tile_size: float = 15.0
    img_width: int = 512
    overlap_pred: int = 8
    n_channels: int = 3
    num_classes: int = 1
    prediction_threshold: float = 0.5
    min_length: float = 2.0
    max_distance: float = 8.0
    max_tree_height: float = 32.0
    tolerance_angle: float = 7.0
    measuring_point_spacing_m: float = 0.5
    diameter_method: str = "contour"
    diameter_vector_half_length_m: float = 1.0
    edt_clip_max_m: float | None = None
    tile_inner_px: int = 4096
    tile_overlap_m: float = 12.0
    read_strategy: str = "graph"
    duplicate_buffer_m: float = 0.3

    def to_dict(self) -> dict:
        return dict(sorted(asdict(self).items()))


def with_overrides(config: Config, text: str | None) -> Config:
    """Applies a JSON object; unknown keys are skipped, text that is no object raises."""
    if not text:
        return config
    values = json.loads(text)
    if not isinstance(values, dict):
        raise ValueError("overrides must be a JSON object")
    known = {f.name for f in fields(Config)}
    return replace(config, **{k: v for k, v in values.items() if k in known})


def merge_overrides(base: str | None, extra: dict) -> str:
    """One JSON text of both; what the base has stays."""
    held = json.loads(base) if base else {}
    return json.dumps({**extra, **held}, sort_keys=True)
