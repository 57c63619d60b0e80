"""Settings of a fit, and a builder for them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any


@dataclass(frozen=True)
class FitterConfig:
    bins: int | tuple[float, ...] = 50
    use_rice_rule: bool = True
    support_at_zero: bool = False
    max_distributions: int | None = None
    enable_sampling: bool = True
    sample_fraction: float | None = None
    max_sample_size: int = 1_000_000
    sample_threshold: int = 10_000_000
    adaptive_sampling: bool = True
    skew_threshold_mild: float = 0.5
    skew_threshold_high: float = 2.0
    num_partitions: int | None = None
    bounded: bool = False
    lower_bound: float | dict[str, float] | None = None
    upper_bound: float | dict[str, float] | None = None
    lazy_metrics: bool = False
    prefilter: bool | str = False
    censoring_column: str | None = None
    estimation_method: str = "mle"
    fitting_sample_size: int = 10_000
    random_seed: int = 42

    def __post_init__(self):
        if isinstance(self.bins, int) and self.bins <= 0:
            raise ValueError("bins must be positive")
        if not isinstance(self.bins, int) and (len(self.bins) < 2 or any(a >= b for a, b in zip(self.bins, self.bins[1:], strict=False))):
            raise ValueError("bin edges must increase")
        if self.sample_fraction is not None and not 0 < self.sample_fraction <= 1:
            raise ValueError("sample_fraction must lie in (0, 1]")
        if self.estimation_method not in ("mle", "mse", "auto"):
            raise ValueError("estimation_method must be mle, mse or auto")
        if self.prefilter not in (False, True, "aggressive"):
            raise ValueError("prefilter must be False, True or 'aggressive'")
        if self.max_distributions is not None and self.max_distributions <= 0:
            raise ValueError("max_distributions must be positive")
        low, high = self.lower_bound, self.upper_bound
        if isinstance(low, (int, float)) and isinstance(high, (int, float)) and low >= high:
            raise ValueError("lower_bound must be below upper_bound")

    def with_(self, **changes: Any) -> FitterConfig:
        return replace(self, **changes)


class FitterConfigBuilder:
    """Collects settings call by call; ``build`` checks them."""

    def __init__(self):
        self._set: dict[str, Any] = {}

    def _with(self, **kw) -> FitterConfigBuilder:
        self._set |= {k: v for k, v in kw.items() if v is not None}
        return self

    def with_bins(self, bins: int | Sequence[float] = 50, use_rice_rule: bool | None = None) -> FitterConfigBuilder:
        return self._with(bins=bins if isinstance(bins, int) else tuple(bins), use_rice_rule=use_rice_rule)

    def with_bounds(self, lower=None, upper=None) -> FitterConfigBuilder:
        return self._with(bounded=True, lower_bound=lower, upper_bound=upper)

    def with_sampling(self, enabled: bool = True, fraction=None, max_size=None, threshold=None) -> FitterConfigBuilder:
        return self._with(enable_sampling=enabled, sample_fraction=fraction, max_sample_size=max_size, sample_threshold=threshold)

    def with_adaptive_sampling(self, enabled: bool = True, mild=None, high=None) -> FitterConfigBuilder:
        return self._with(adaptive_sampling=enabled, skew_threshold_mild=mild, skew_threshold_high=high)

    def with_lazy_metrics(self, lazy: bool = True) -> FitterConfigBuilder:
        return self._with(lazy_metrics=lazy)

    def with_prefilter(self, mode: bool | str = True) -> FitterConfigBuilder:
        return self._with(prefilter=mode)

    def with_support_at_zero(self, on: bool = True) -> FitterConfigBuilder:
        return self._with(support_at_zero=on)

    def with_max_distributions(self, n: int) -> FitterConfigBuilder:
        return self._with(max_distributions=n)

    def with_partitions(self, n: int) -> FitterConfigBuilder:
        return self._with(num_partitions=n)

    def with_censoring(self, column: str) -> FitterConfigBuilder:
        return self._with(censoring_column=column)

    def with_estimation_method(self, method: str) -> FitterConfigBuilder:
        return self._with(estimation_method=method)

    def build(self) -> FitterConfig:
        return FitterConfig(**self._set)
