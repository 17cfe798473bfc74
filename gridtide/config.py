"""Settings: what exists, what may be asked, and how much of it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

from .functions.geo import BucketGrid


@dataclass(frozen=True)
class Limits:
    """Most that one query may read or return."""

    cells: int = 25_000
    blocks: int = 100
    values: int = 500_000
    groups: int = 5
    days: int = 31
    output_bytes: int = 50 << 20


@dataclass(frozen=True)
class CombinedDataset:
    """How sources are blended into one dataset."""

    repository: str = "gridtide"
    dataset: str = "combined"
    target_repository: str = ""
    target_dataset: str = ""
    minimum_daily_coverage: float = 0.75
    variables: tuple[str, ...] = ()
    default_weight: float = 1.0
    weights: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Settings:
    """``repositories``: repository -> dataset -> {variables: {source name: standard name}, additional_parameters: {name: [values]}, resolution, units}."""

    repositories: dict[str, dict[str, dict[str, Any]]] = field(default_factory=dict)
    temporal_reducers: dict[str, str] = field(default_factory=dict)
    coarseness_factors: tuple[int, ...] = (1, 2)
    buckets: BucketGrid = field(default_factory=BucketGrid)
    limits: Limits = field(default_factory=Limits)
    combined: CombinedDataset = field(default_factory=CombinedDataset)
    result_ttl_seconds: int = 600

    def names(self, repository: str | None = None, dataset: str | None = None) -> dict[str, list]:
        """Sorted repositories, datasets and variables, and parameters in first-seen order, within a choice."""
        chosen = {r: own for r, own in self.repositories.items() if repository in (None, r)}
        sets = {(r, d): x for r, own in chosen.items() for d, x in own.items() if dataset in (None, d)}
        parameters: dict[str, list[str]] = {}
        for x in sets.values():
            for name, values in x.get("additional_parameters", {}).items():
                parameters.setdefault(name, []).extend(v for v in values if v not in parameters.get(name, []))
        return {
            "repositories": sorted(chosen), "datasets": sorted({d for _, d in sets}),
            "variables": sorted({v for x in sets.values() for v in x.get("variables", {}).values()}), "parameters": [parameters],
        }

    def reducer(self, variable: str) -> str:
        return self.temporal_reducers.get(variable, "mean")


def load_settings(path: str | Path) -> Settings:
    """Settings from a YAML file with the fields of ``Settings``."""
    import yaml

    data = yaml.safe_load(Path(path).read_text()) or {}
    made = Settings(**{k: data[k] for k in ("repositories", "temporal_reducers", "result_ttl_seconds") if k in data})
    if "coarseness_factors" in data:
        made = replace(made, coarseness_factors=tuple(data["coarseness_factors"]))
    for name, kind in (("buckets", BucketGrid), ("limits", Limits), ("combined", CombinedDataset)):
        if name in data:
            made = replace(made, **{name: kind(**data[name])})
    return made
