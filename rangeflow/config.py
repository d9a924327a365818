"""Thresholds of the range-sensor rules: one frozen record whose values become literals."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Thresholds:
    """Distances in metres, heights above rail, time in seconds."""

    roi_d: tuple[float, float] = (3.0, 300.0)
    roi_l: float = 12.0
    roi_h: tuple[float, float] = (-8.0, 10.0)
    min_valid_points: int = 2000
    low_half_width: float = 1.0
    high_half_width: float = 1.4
    width_step_h: float = 0.8
    width_shrink: float = 0.003
    closed_below: float = 0.7
    floor_h: float = 0.30
    floor_slope: float = 0.002
    ceiling_h: float = 3.40
    voxel: float = 0.08
    voxel_slope: float = 0.002
    reset_back_s: float = 0.001
    reset_gap_s: float = 1.5
    gate_back: float = 8.0
    gate_ahead: float = 2.5
    gate_side: float = 1.2
    confirm_near: tuple[int, int] = (2, 3)
    confirm_far: tuple[int, int] = (3, 4)
    far_from: float = 100.0
    max_misses: int = 3

    @classmethod
    def from_mapping(cls, given: dict) -> Thresholds:
        """Defaults with some values replaced; an unknown name is an error."""
        names = {f.name for f in fields(cls)}
        if unknown := set(given) - names:
            raise KeyError(f"unknown thresholds: {sorted(unknown)}")
        return replace(cls(), **given)


def parse_override(text: str) -> tuple[str, object]:
    """``name=value`` of a command line; a value that reads as JSON is that, others are texts."""
    name, sep, value = text.partition("=")
    if not sep or not name.strip():
        raise ValueError(f"not name=value: {text}")
    try:
        given = json.loads(value)
    except json.JSONDecodeError:
        given = value
    return name.strip(), tuple(given) if isinstance(given, list) else given
