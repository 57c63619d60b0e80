"""The discrete families: log-probabilities, distribution functions by summing, starts and bounds."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from lawfinder.functions.special import betaln, gammaln

INF = math.inf
log, log1p, exp = np.log, np.log1p, np.exp


@dataclass(frozen=True)
class DiscreteLaw:
    name: str
    names: tuple[str, ...]
    low: Callable[..., float]  # smallest value of the support
    high: Callable[..., float]
    std_logpmf: Callable
    start: Callable[[float, float, float, float], tuple[float, ...]]  # of mean, variance, min, max
    bounds: tuple[tuple[float, float], ...]
    whole: tuple[str, ...] = ()  # parameters that are whole numbers

    def settled(self, p) -> tuple[float, ...]:
        """Parameters with the whole ones rounded."""
        return tuple(float(round(v)) if n in self.whole else float(v) for n, v in zip(self.names, p, strict=True))

    def logpmf(self, k, *p):
        k = np.asarray(k, float)
        with np.errstate(all="ignore"):
            out = np.asarray(self.std_logpmf(k, *p), float)
        return np.where((k >= self.low(*p)) & (k <= self.high(*p)) & (k == np.floor(k)) & ~np.isnan(out), out, -INF)

    def pmf(self, k, *p):
        return exp(self.logpmf(k, *p))

    def cdf(self, k, *p):
        """Sums of probabilities up to the largest value asked for, or down from it where the support is not bounded below."""
        k = np.floor(np.asarray(k, float))
        top = float(np.max(k, initial=0))
        low = self.low(*p)
        if not math.isfinite(low):
            low = min(float(np.min(k, initial=0)), 0.0) - 2000
        low = min(low, top)
        at = np.arange(low, min(top, low + 5e6) + 1)
        sums = np.cumsum(self.pmf(at, *p))
        return np.clip(np.where(k < low, 0.0, sums[np.clip(k - low, 0, len(sums) - 1).astype(int)]), 0, 1)

    def ppf(self, q, *p):
        q = np.asarray(q, float)
        low = self.low(*p)
        low = low if math.isfinite(low) else -2000.0
        size = 256
        while True:
            at = np.arange(low, low + size)
            sums = np.cumsum(self.pmf(at, *p))
            if sums[-1] >= np.max(q, initial=0) - 1e-12 or size > 4e6:
                return at[np.minimum(np.searchsorted(sums, q - 1e-12), len(at) - 1)]
            size *= 4

    def rvs(self, size: int, *p, seed: int | None = None):
        return self.ppf(np.random.default_rng(seed).random(size), *p)


def choose(n, k):
    return gammaln(n + 1) - gammaln(k + 1) - gammaln(np.maximum(n - k + 1, 1e-9))


def zeta(a: float) -> float:
    n = 40
    return float(np.sum(np.arange(1, n) ** -a) + n ** (1 - a) / (a - 1) + 0.5 * n**-a + a / 12 * n ** (-a - 1))


def _skellam(k, a, b):
    """By the series of the Bessel function."""
    j = np.arange(0, 40 + int(3 * math.sqrt(a * b)) + 5)[:, None]
    n = np.abs(k)[None, :]
    terms = (2 * j + n) * (0.5 * log(a * b)) - gammaln(j + 1.0 + 0 * n) - gammaln(j + n + 1.0)
    top = terms.max(axis=0)
    return -(a + b) + k / 2 * log(a / b) + top + log(exp(terms - top).sum(axis=0))


def unit(x: float) -> float:
    return min(max(x, 1e-3), 1 - 1e-3)


UNIT, POSITIVE = (1e-6, 1 - 1e-6), (1e-6, 1e6)
zero, one, never = (lambda *p: 0.0), (lambda *p: 1.0), (lambda *p: INF)

DISCRETE: dict[str, DiscreteLaw] = {
    x.name: x
    for x in (
        DiscreteLaw("poisson", ("mu",), zero, never, lambda k, m: k * log(m) - m - gammaln(k + 1), lambda m, v, lo, hi: (max(m, 1e-3),), (POSITIVE,)),
        DiscreteLaw("geom", ("p",), one, never, lambda k, p: (k - 1) * log1p(-p) + log(p), lambda m, v, lo, hi: (unit(1 / max(m, 1)),), (UNIT,)),
        DiscreteLaw("binom", ("n", "p"), zero, lambda n, p: n, lambda k, n, p: choose(n, k) + k * log(p) + (n - k) * log1p(-p), lambda m, v, lo, hi: (max(hi, 1), unit(m / max(hi, 1))), ((1, 1e6), UNIT), ("n",)),
        DiscreteLaw("nbinom", ("n", "p"), zero, never, lambda k, n, p: gammaln(k + n) - gammaln(k + 1) - gammaln(n) + n * log(p) + k * log1p(-p), lambda m, v, lo, hi: (max(m * m / max(v - m, 0.05 * m + 1e-6), 1e-2), unit(m / max(v, 1.05 * m + 1e-9))), (POSITIVE, UNIT)),
        DiscreteLaw("zipf", ("a",), one, never, lambda k, a: -a * log(k) - log(zeta(a)), lambda m, v, lo, hi: (2.0,), ((1.001, 50),)),
        DiscreteLaw("zipfian", ("a", "n"), one, lambda a, n: n, lambda k, a, n: -a * log(k) - log(np.sum(np.arange(1.0, min(n, 1e6) + 1) ** -a)), lambda m, v, lo, hi: (1.0, max(hi, 1)), ((1e-3, 50), (1, 1e6)), ("n",)),
        DiscreteLaw("hypergeom", ("M", "n", "N"), lambda M, n, N: max(0, N + n - M), lambda M, n, N: min(n, N), lambda k, M, n, N: choose(n, k) + choose(M - n, N - k) - choose(M, N), lambda m, v, lo, hi: (4 * max(hi, 1), 2 * max(hi, 1), max(2 * m, hi, 1)), ((1, 1e6),) * 3, ("M", "n", "N")),
        DiscreteLaw("betabinom", ("n", "a", "b"), zero, lambda n, a, b: n, lambda k, n, a, b: choose(n, k) + betaln(k + a, n - k + b) - betaln(a, b), lambda m, v, lo, hi: (max(hi, 1), 1.0, max(hi - m, 1e-2) / max(m, 1e-2)), ((1, 1e6), (1e-3, 1e4), (1e-3, 1e4)), ("n",)),
        DiscreteLaw("betanbinom", ("n", "a", "b"), zero, never, lambda k, n, a, b: -log(n + k) - betaln(n, k + 1) + betaln(a + n, b + k) - betaln(a, b), lambda m, v, lo, hi: (max(m, 1), 3.0, 2.0), ((1, 1e5), (1e-3, 1e4), (1e-3, 1e4)), ("n",)),
        DiscreteLaw("boltzmann", ("lambda_", "N"), zero, lambda l, n: n - 1, lambda k, l, n: log(-np.expm1(-l)) - log(-np.expm1(-l * n)) - l * k, lambda m, v, lo, hi: (math.log1p(1 / max(m, 1e-3)), hi + 1), ((1e-6, 50), (1, 1e6)), ("N",)),
        DiscreteLaw("dlaplace", ("a",), lambda *p: -INF, never, lambda k, a: log(np.tanh(a / 2)) - a * np.abs(k), lambda m, v, lo, hi: (1.0 / max(math.sqrt(v / 2 + 1e-9), 1e-2),), ((1e-6, 50),)),
        DiscreteLaw("logser", ("p",), one, never, lambda k, p: k * log(p) - log(k) - log(-log1p(-p)), lambda m, v, lo, hi: (unit(1 - 1 / max(m, 1.05) ** 1.5),), (UNIT,)),
        DiscreteLaw("planck", ("lambda_",), zero, never, lambda k, l: log(-np.expm1(-l)) - l * k, lambda m, v, lo, hi: (math.log1p(1 / max(m, 1e-3)),), ((1e-6, 50),)),
        DiscreteLaw("skellam", ("mu1", "mu2"), lambda *p: -INF, never, lambda k, a, b: _skellam(np.atleast_1d(k), a, b), lambda m, v, lo, hi: (max((v + m) / 2, 0.05), max((v - m) / 2, 0.05)), ((1e-6, 1e4),) * 2),
        DiscreteLaw("yulesimon", ("alpha",), one, never, lambda k, a: log(a) + betaln(k, a + 1), lambda m, v, lo, hi: (max(m / max(m - 1, 0.1), 0.5),), ((1e-3, 1e4),)),
        DiscreteLaw("nhypergeom", ("M", "n", "r"), zero, lambda M, n, r: n, lambda k, M, n, r: -betaln(k + 1, r) + betaln(k + r, 1) - betaln(n - k + 1, M - r - n + 1) + betaln(M - r - k + 1, 1) + betaln(n + 1, M - n + 1) - betaln(M + 1, 1) , lambda m, v, lo, hi: (3 * max(hi, 1) + 3, max(hi, 1), max(1.0, round(m))), ((1, 1e6),) * 3, ("M", "n", "r")),
    )
}
EXCLUDED = frozenset("nchypergeom_fisher nchypergeom_wallenius randint bernoulli poisson_binom".split())
