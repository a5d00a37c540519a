"""Run-time constants shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date


@dataclass(frozen=True)
class Params:
    late_arrival_lookback_days: int = 2
    trailing_window_days: int = 7
    min_arrival_exposure: float = 0.10
    arrival_cutoff_date: date | None = None
    delivery_cost_per_order: float = 42.0
    # A running balance is cut into pieces of at most this many sequence numbers,
    # so no single batch can ever be one task's whole input.
    ledger_slice_width: int = 1 << 20
    eval_origin_count: int = 12
    eval_origin_step_days: int = 5
    max_horizon_days: int = 7
    train_history_days: int = 28
    # What ``mart_demand_forecast`` serves: "boosted" (trees) or "tweedie" (a regression), with the baseline
    # where they have no features, or "baseline".
    demand_model: str = "boosted"
