"""Settings objects. They are checked when built, on the driver, and reach the executors as literals."""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Rule:
    """What a setting may be: a whole number or any finite one, from a lowest value on, or one of some names."""

    whole: bool = False
    lowest: float = 0
    names: tuple[str, ...] = ()

    def problem(self, name: str, value: object) -> str | None:
        if self.names:
            return None if value in self.names else f"{name} must be one of {', '.join(self.names)}"
        kinds = int if self.whole else (int, float)
        if type(value) is bool or not isinstance(value, kinds) or not math.isfinite(value) or value < self.lowest:
            return f"{name} must be a {'whole' if self.whole else 'finite'} number of at least {self.lowest}"
        return None


_COUNT = Rule(whole=True, lowest=1)
RULES = dict.fromkeys(("lags", "season", "horizon", "min_observations", "min_residual_rows", "tree_count", "tree_depth"), _COUNT) | {
    "seed": Rule(whole=True),
    "correction_clip": Rule(),
    "correction_weight": Rule(),
    "tree_step": Rule(),
    "residual_method": Rule(names=("in_sample",)),
    "evaluation_split": Rule(names=("last_reported_year", "last_complete_year")),
    "gap_handling": Rule(names=("calendar_lags",)),
}


@dataclass(frozen=True)
class ModelSettings:
    """Numbers that steer the forecasting plan."""

    name: str = "seasonal-trend + residual"
    version: str = "1"
    seed: int = 12345
    lags: int = 12
    season: int = 12
    horizon: int = 12
    min_observations: int = 17
    min_residual_rows: int = 5
    correction_clip: float = 1.0
    correction_weight: float = 0.1
    residual_method: str = "in_sample"
    evaluation_split: str = "last_reported_year"
    gap_handling: str = "calendar_lags"
    tree_count: int = 20
    tree_depth: int = 4
    tree_step: float = 0.3

    def __post_init__(self) -> None:
        problems = [text for name, rule in RULES.items() if (text := rule.problem(name, getattr(self, name)))]
        if problems:
            raise ValueError("; ".join(problems))

    @property
    def signature(self) -> str:
        """Digest of all settings, each written with its length as row texts are."""
        cells = [cell for f in fields(self) for cell in (f.name, repr(getattr(self, f.name)))]
        return hashlib.sha256("".join(f"{len(c)}:{c}" for c in cells).encode()).hexdigest()


@dataclass(frozen=True)
class StudyScope:
    """Universe of one study: its years, its absent years and its candidate keys."""

    first_year: int = 1995
    last_year: int = 2001
    unavailable_years: tuple[int, ...] = (1997, 1999)
    annual_limit: int = 5
    absent_candidates: tuple[str, ...] = ("NONE",)

    def __post_init__(self) -> None:
        if self.first_year > self.last_year:
            raise ValueError("first_year must not exceed last_year")
        if any(not self.first_year <= y <= self.last_year for y in self.unavailable_years):
            raise ValueError("unavailable years must lie inside the study")

    @property
    def years(self) -> range:
        return range(self.first_year, self.last_year + 1)

    @property
    def available_years(self) -> tuple[int, ...]:
        return tuple(y for y in self.years if y not in self.unavailable_years)


MODEL = ModelSettings()
SCOPE = StudyScope()
