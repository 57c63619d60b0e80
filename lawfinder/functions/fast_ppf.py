"""Quantiles by closed forms, bounds included; the values of the distribution function at bounds are remembered."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

import numpy as np

from lawfinder.functions import registry

FAST = frozenset(n for n in ("norm", "expon", "uniform", "lognorm", "weibull_min", "rayleigh", "laplace", "logistic", "gumbel_r", "gumbel_l", "pareto", "cauchy", "gibrat", "halfnorm"))


def has_fast_ppf(distribution: str) -> bool:
    return distribution in FAST


@functools.lru_cache(maxsize=256)
def _ends(distribution: str, parameters: tuple[float, ...], low: float | None, high: float | None) -> tuple[float, float]:
    law = registry.get_law(distribution)
    at = lambda x, d: d if x is None or math.isinf(x) else float(law.cdf(np.array([x]), *parameters)[0])
    return at(low, 0.0), at(high, 1.0)


def clear_ppf_cache() -> None:
    _ends.cache_clear()


def fast_ppf(distribution: str, parameters: Sequence[float], q, lower_bound: float | None = None, upper_bound: float | None = None) -> np.ndarray:
    """Quantiles, in closed form where there is one; between bounds without mass, those at the lower bound."""
    p = tuple(float(v) for v in parameters)
    q = np.asarray(q, float)
    if lower_bound is not None or upper_bound is not None:
        a, b = _ends(distribution, p, lower_bound, upper_bound)
        q = a + q * max(b - a, 0.0)
    out = registry.get_law(distribution).ppf(q, *p)
    if lower_bound is not None or upper_bound is not None:
        out = np.clip(out, -math.inf if lower_bound is None else lower_bound, math.inf if upper_bound is None else upper_bound)
    return out


def fast_ppf_batch(laws: Sequence[tuple[str, Sequence[float]]], q: np.ndarray) -> np.ndarray:
    """One column of quantiles for each law; ``q`` has a column for each, or one that all share."""
    q = np.atleast_2d(np.asarray(q, float).T).T
    return np.column_stack([fast_ppf(n, p, q[:, min(i, q.shape[1] - 1)]) for i, (n, p) in enumerate(laws)])
