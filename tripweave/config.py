"""Settings of a run, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Data:
    cleaned_path: str = "data/trips.parquet"
    format: str = "parquet"


@dataclass(frozen=True)
class Filters:
    year: int | None = 2024
    include_cancelled: bool = False
    carriers: str | tuple[str, ...] = "ALL"


@dataclass(frozen=True)
class Scope:
    mode: str = "top_airports"  # full, top_airports or sample
    top_airports_k: int = 50
    sample_frac: float = 0.10


@dataclass(frozen=True)
class Edges:
    include_tail_sequence: bool = True
    include_same_route_knn: bool = True
    route_knn_k: int = 3
    include_airport_transfer_knn: bool = False
    airport_transfer_knn_k: int = 2
    transfer_same_carrier_only: bool = True
    transfer_window_minutes: tuple[int, int] = (30, 240)


@dataclass(frozen=True)
class Cascade:
    p_transfer: float = 0.25
    p_tail: float = 0.60
    delay_threshold_minutes: int = 15
    runs: int = 200
    use_empirical_beta: bool = True


@dataclass(frozen=True)
class Walks:
    dimensions: int = 128
    walk_length: int = 80
    num_walks: int = 10
    window_size: int = 10
    p: float = 1.0
    q: float = 1.0


@dataclass(frozen=True)
class TimeSplit:
    train_months: tuple[int, ...] = tuple(range(1, 10))
    test_months: tuple[int, ...] = (10, 11, 12)
    negative_ratio: int = 5


@dataclass(frozen=True)
class Costs:
    per_delay_minute: float = 75.0
    per_cancellation: float = 10_000.0


@dataclass(frozen=True)
class Config:
    seed: int = 42
    data: Data = field(default_factory=Data)
    filters: Filters = field(default_factory=Filters)
    scope: Scope = field(default_factory=Scope)
    edges: Edges = field(default_factory=Edges)
    cascade: Cascade = field(default_factory=Cascade)
    walks: Walks = field(default_factory=Walks)
    time_split: TimeSplit = field(default_factory=TimeSplit)
    costs: Costs = field(default_factory=Costs)
    leiden_resolution: float = 0.01
    leiden_runs: int = 10
    overwrite: bool = False

    @classmethod
    def of(cls, values: dict) -> Config:
        """From nested dictionaries; what isn't given keeps its default, and an unknown name is an error."""
        return _of(cls, values)


def _of(kind, values: dict):
    known = {f.name: f for f in fields(kind)}
    if unknown := set(values) - set(known):
        raise ValueError(f"unknown settings of {kind.__name__}: {sorted(unknown)}")
    default = kind()
    made = {}
    for name, value in values.items():
        now = getattr(default, name)
        made[name] = _of(type(now), value) if is_dataclass(now) else tuple(value) if isinstance(value, list) else value
    return kind(**made)
