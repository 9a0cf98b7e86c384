"""Run parameters. Everything a run depends on, clock and run id included, is passed in here."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from datetime import date, timedelta
from pathlib import Path

# The columns a stop-event file must carry.
STOP_EVENT_TYPES = {
    "station_name": "string",
    "xml_station_name": "string",
    "eva": "string",
    "train_number": "string",
    "line_number": "string",
    "final_destination_station": "string",
    "delay_in_min": "int",
    "time": "timestamp_ntz",
    "is_canceled": "boolean",
    "train_type": "string",
    "train_line_ride_id": "string",
    "train_line_station_num": "int",
    "arrival_planned_time": "timestamp_ntz",
    "arrival_change_time": "timestamp_ntz",
    "departure_planned_time": "timestamp_ntz",
    "departure_change_time": "timestamp_ntz",
    "id": "string",
}
STOP_EVENT_COLUMNS = tuple(STOP_EVENT_TYPES)

# Names of scope slices, policies and splits.
BASELINE_SLICE = "baseline_month"
ADDED_SLICE = "added_disrupted_week"
UNKNOWN_SLICE = "unknown_scope_slice"

RANDOM = "random"
SCORE_FIRST = "ml_first"
GREEDY = "constrained_greedy"
EXACT = "exact_soft_station_penalty"

# Solver statuses.
SOLVED, STOPPED, DIRECT = "OPTIMAL", "TIME_LIMIT_WITH_INCUMBENT", "deterministic"

SPLIT_OF_MODE = {"development": "validation", "final": "test"}


def read_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def _pick(cls, data: dict):
    known = {f.name for f in fields(cls)}
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in known}
    return cls(**values)


@dataclass(frozen=True)
class ScopeConfig:
    scope_version: str
    extraction_query_version: str
    selected_month: str
    selected_hub: str
    source_file_name: str
    source_version: str
    source_url: str = ""
    required_columns: tuple[str, ...] = STOP_EVENT_COLUMNS
    complete_journey_rule: str = "keep every row of a journey that calls at the hub in the month file"

    @classmethod
    def from_json(cls, path: str | Path) -> ScopeConfig:
        return _pick(cls, read_json(path))


@dataclass(frozen=True)
class ScopeSlice:
    """One part of the scoped extract: a whole month file, or a week of another one."""

    scope_slice: str
    source_file: str
    source_version: str
    week_start: date | None = None

    @property
    def week_end(self) -> date | None:
        return self.week_start and self.week_start + timedelta(days=6)

    def label(self, month: str) -> str:
        return f"{self.week_start}:{self.week_end}" if self.week_start else month


@dataclass(frozen=True)
class SearchConfig:
    optimization_policy_name: str = EXACT
    optimization_policy_version: str = "2026-06-29-v1"
    canonical_tuning_capacity_per_hour: int = 3
    scenario_capacities: tuple[int, ...] = (1, 3, 5, 10)
    preferred_station_load_per_station_hour_candidates: tuple[int, ...] = (1, 2)
    diagnostic_station_excess_penalty_lambda: float = 0.0
    eligible_frozen_station_excess_penalty_lambdas: tuple[float, ...] = (0.05, 0.1, 0.2)
    random_seed: int = 17
    solver_step_limit: int | None = None
    development_allowed_solver_statuses: tuple[str, ...] = ("OPTIMAL", "TIME_LIMIT_WITH_INCUMBENT")
    final_allowed_solver_statuses: tuple[str, ...] = ("OPTIMAL", "TIME_LIMIT_WITH_INCUMBENT")

    @classmethod
    def from_json(cls, path: str | Path) -> SearchConfig:
        return _pick(cls, read_json(path))

    @property
    def penalties(self) -> tuple[float, ...]:
        return (
            self.diagnostic_station_excess_penalty_lambda,
            *self.eligible_frozen_station_excess_penalty_lambdas,
        )

    @property
    def policy_names(self) -> tuple[str, ...]:
        return (RANDOM, SCORE_FIRST, GREEDY, self.optimization_policy_name)


@dataclass(frozen=True)
class Policy:
    """A frozen selection policy."""

    selected_threshold: float
    scoring_model_name: str
    scoring_model_version: str
    preferred_station_load: int
    station_penalty: float
    capacity_per_hour: int = 3
    minimum_candidate_probability: float | None = None
    search: SearchConfig = field(default_factory=SearchConfig)
    run_id: str = "run-0"
    optimized_at: str = "1970-01-01T00:00:00+00:00"
    frozen_at: str = "1970-01-01T00:00:00+00:00"

    @property
    def threshold(self) -> float:
        chosen = self.minimum_candidate_probability
        return self.selected_threshold if chosen is None else chosen

    @property
    def capacity_scenario(self) -> str:
        return f"hourly_capacity_{self.capacity_per_hour}"

    def check_frozen(self) -> Policy:
        if self.threshold != self.selected_threshold:
            raise ValueError("the candidate threshold of a frozen policy must be the selected threshold")
        if self.station_penalty <= 0:
            raise ValueError("a frozen policy needs a positive station penalty")
        if self.station_penalty not in self.search.eligible_frozen_station_excess_penalty_lambdas:
            raise ValueError("the station penalty of a frozen policy must be one of the searched values")
        if self.preferred_station_load < 1:
            raise ValueError("the preferred station load must be at least one")
        return self

    def as_dict(self) -> dict:
        plain = asdict(self)
        plain.update(
            capacity_scenario=self.capacity_scenario,
            minimum_candidate_probability=self.threshold,
            optimization_policy_name=self.search.optimization_policy_name,
            optimization_policy_version=self.search.optimization_policy_version,
        )
        return plain
