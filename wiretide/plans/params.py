"""Detector settings: defaults plus nested overrides."""

from __future__ import annotations

from collections.abc import Mapping
from copy import deepcopy
from typing import Any

# The default settings.
DEFAULTS: dict[str, Any] = {
    "port_scan": {"enabled": True, "port_threshold": 15, "time_window": 10.0, "cooldown": 30.0},
    "arp_spoof": {"enabled": True, "cooldown": 60.0},
    "dos": {"enabled": True, "syn_threshold": 100, "time_window": 5.0, "cooldown": 30.0},
    "traffic_anomaly": {
        "enabled": True,
        "window_seconds": 10.0,
        "baseline_windows": 6,
        "multiplier": 3.0,
        "min_baseline_samples": 3,
    },
    "whitelist": [],
}


def settings(overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The defaults with ``overrides`` laid over them leaf by leaf; unknown keys are ignored."""
    if overrides is None:
        return deepcopy(DEFAULTS)
    if not isinstance(overrides, Mapping):
        raise ValueError("settings must be a mapping")
    return _overlay(DEFAULTS, overrides)


def _overlay(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    merged = {}
    for name, value in base.items():
        given = over.get(name, value)
        nested = isinstance(value, Mapping) and isinstance(given, Mapping)
        merged[name] = _overlay(value, given) if nested else deepcopy(given)
    return merged
