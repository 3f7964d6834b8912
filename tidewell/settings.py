"""Typed, frozen settings. Values that results depend on are fixed values of the ranking model."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, is_dataclass, replace

#: Weight profiles, in the order in which weighted parts are added (fixed values).
WEIGHTS: dict[str, dict[str, float]] = {
    "default": {"bm25": 0.30, "category": 0.24, "attr": 0.20, "city": 0.10, "rating": 0.05, "pop": 0.03, "price_check": 0.03, "rating_check": 0.03, "time_check": 0.02, "open_now_check": 0.03},
    "with_distance": {"bm25": 0.26, "category": 0.20, "attr": 0.18, "city": 0.09, "distance": 0.13, "rating": 0.03, "pop": 0.02, "price_check": 0.03, "rating_check": 0.03, "time_check": 0.03, "open_now_check": 0.03},
    "with_dense": {"dense": 0.28, "bm25": 0.05, "name": 0.05, "category": 0.20, "attr": 0.18, "city": 0.08, "distance": 0.12, "rating": 0.02, "pop": 0.02, "price_check": 0.03, "rating_check": 0.03, "time_check": 0.03, "open_now_check": 0.03},
}


@dataclass(frozen=True)
class Search:
    default_limit: int = 10
    most: int = 20
    internal: int = 50
    candidates: int = 30
    pool: int = 25


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


@dataclass(frozen=True)
class Vectors:
    attribute_threshold: float = 0.85
    noise_floor: float = 0.835
    least_weight: float = 0.15


@dataclass(frozen=True)
class Constraints:
    satisfied: float = 0.5
    time_keywords: tuple[str, ...] = ("mo khuya", "24/7", "mo muon", "hai bon bay")
    price_keywords: tuple[str, ...] = ("gia re", "mien phi")
    price_levels: tuple[tuple[str, int], ...] = (("gia re", 2), ("mien phi", 1))
    late_full: int = 1380
    late_partial: int = 1320
    time_partial: float = 0.5
    near_km: float = 1.0
    far_km: float = 3.0
    near_partial: float = 0.7
    same_city: float = 0.2
    city_fallback: float = 0.5


@dataclass(frozen=True)
class Verify:
    match_score: float = 0.70
    distance_m: float = 500.0
    place_types: tuple[str, ...] = ("PointAddress", "PointOfInterest", "Street")
    retries: tuple[float, ...] = (1.0, 2.0, 4.0)


@dataclass(frozen=True)
class Rewrite:
    max_gram: int = 4
    min_coverage: float = 0.5
    min_token: int = 3
    junk_min_token: int = 4
    junk: str = "fjzw"
    typo_fix: bool = True


@dataclass(frozen=True)
class Settings:
    search: Search = field(default_factory=Search)
    bm25: Bm25 = field(default_factory=Bm25)
    vectors: Vectors = field(default_factory=Vectors)
    constraints: Constraints = field(default_factory=Constraints)
    verify: Verify = field(default_factory=Verify)
    rewrite: Rewrite = field(default_factory=Rewrite)
    batch_limit: int = 500
    poll_seconds: int = 10

    @staticmethod
    def load(env: dict[str, str] | None = None, dotenv: str | None = None, path: str | None = None) -> Settings:
        """Defaults, changed by a YAML or JSON file of sections, then by variables such as TIDEWELL_SEARCH_POOL=30.

        A real variable wins over the same one in ``dotenv``; unknown sections, names or values of the wrong type are errors.
        """
        found: dict[str, str] = {}
        if dotenv and os.path.exists(dotenv):
            with open(dotenv, encoding="utf-8") as f:
                found = dict(x.strip().split("=", 1) for x in f if "=" in x and not x.lstrip().startswith("#"))
        found |= dict(os.environ if env is None else env)
        wanted: dict[str, dict] = {}
        if path:
            from .sources.corpus import read_mapping

            wanted = {str(k): v for k, v in (read_mapping(path) or {}).items()}
        out = Settings()
        flat = {"TYPO_FIX": ("rewrite", "typo_fix")}
        sections = {f.name: getattr(out, f.name) for f in fields(out) if is_dataclass(getattr(out, f.name))}
        for section, value in sections.items():
            flat |= {f"{section}_{f.name}".upper(): (section, f.name) for f in fields(value)}
        for name, text in found.items():
            if name.startswith("TIDEWELL_") and name[9:] in flat:
                section, key = flat[name[9:]]
                wanted.setdefault(section, {})[key] = text
        for section, values in wanted.items():
            if section in sections:
                out = replace(out, **{section: _changed(sections[section], values)})
            else:
                out = _changed(out, {section: values})
        return out


def _changed(old, values: dict):
    """A copy of a dataclass with these values, of the type that each has now."""

    def typed(now, value):
        if isinstance(now, bool):
            return value if isinstance(value, bool) else str(value).strip().lower() not in ("0", "false", "no", "off", "")
        return tuple(tuple(v) if isinstance(v, list) else v for v in value) if isinstance(now, tuple) else type(now)(value)

    unknown = set(values) - {f.name for f in fields(old)}
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(old, **{k: typed(getattr(old, k), v) for k, v in values.items()})
