"""Synthetic daily series with known anomalies."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np

START = date(2026, 1, 5)


def make_series(seed: int, n_days: int, base: float, weekend_drop: float = 0.0, trend: float = 0.0, noise: float = 0.0, spikes: dict[int, float] | None = None) -> tuple[list[date], list[float]]:
    """Days from a Monday, and their costs: a level with trend, weekends lower by a share, noise as a share, days multiplied.

    The noise is the standard normal stream of numpy's default generator, so a seed gives the same series everywhere.
    """
    at = np.arange(n_days)
    shape = (base + trend * at) * np.where(at % 7 >= 5, 1.0 - weekend_drop, 1.0)
    shape = shape + noise * shape * np.random.default_rng(seed).standard_normal(n_days)
    for k, factor in (spikes or {}).items():
        shape[k] *= factor
    return [START + timedelta(days=int(k)) for k in at], np.maximum(shape, 0.0).tolist()
