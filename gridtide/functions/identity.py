"""Stable ids of metadata records; metadata is driver-sized, so they are made there."""

from __future__ import annotations

import hashlib
import json
from typing import Any


def stable_id(fields: dict[str, Any]) -> str:
    """32 hex digits (128-bit BLAKE2b) of sorted, compact JSON."""
    text = json.dumps(fields, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def variant_id(repository: str, dataset: str, additional_parameters: dict[str, str] | None = None) -> str:
    return stable_id({"repository": repository, "dataset": dataset, "additional_parameters": additional_parameters or {}})


def partition_id(variant: str, variable: str, grid: str, time_unit: str, factor: int, start: str, end: str) -> str:
    return stable_id({"variant": variant, "variable": variable, "grid": grid, "time_unit": time_unit, "factor": factor, "time_start": start, "time_end": end})


def grid_id(grid_type: str, latitudes: list[float], longitudes: list[float], crs: dict[str, Any] | None = None, digits: int = 9) -> str:
    """Id of a grid's geometry: names and other labels don't count, projection attributes do."""
    return stable_id({"type": grid_type, "lat": [round(x, digits) for x in latitudes], "lon": [round(x, digits) for x in longitudes], "crs": crs or {}})


def source_key(record: dict[str, Any]) -> tuple[str, str, str, str]:
    """What tells one source of a blend from another: repository, dataset, variable and its parameters as sorted, compact JSON."""
    parameters = record.get("additional_parameters") or record.get("additional_params") or {}
    return record["repository"], record["dataset"], record["variable"], json.dumps(parameters, sort_keys=True, separators=(",", ":"))
