"""Job options: thresholds, geometry fractions and output location."""

from __future__ import annotations

import os
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Geometry:
    """Fractions of frame width and height (fixed values)."""

    detector_scale: float = 0.5
    crop_factor: float = 0.9
    left_bottom_x: float = 0.31
    left_top_x: float = 0.285
    right_top_x: float = 0.32
    right_bottom_y: float = 0.78
    horizon_y: float = 0.49
    finish_left_y: float = 1.09
    finish_right_y: float = 0.78


@dataclass(frozen=True)
class Options:
    """Everything a job may tune; the defaults are the usual settings."""

    geometry: Geometry = field(default_factory=Geometry)
    bib_conf: float = 0.70
    read_conf: float = 0.4
    read_len: tuple[int, int] = (2, 5)
    lock_conf: float = 0.99
    hold_frames: int = 30
    gap_frames: int | None = 300
    forget_frames: int | None = 1200
    idle_after: int = 10
    idle_drop: int = 31
    crop_padding: int = 15
    leaderboard_path: str = "leaderboard"

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> "Options":
        env = dict(os.environ) if env is None else env
        path = env.get("LEADERBOARD_CSV_PATH")
        return cls(leaderboard_path=path) if path else cls()
