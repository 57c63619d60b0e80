"""Estimation and scoring of one family on an array, in numpy: what runs inside the fitting tasks."""

from __future__ import annotations

import math

import numpy as np

from lawfinder.functions.discrete import DiscreteLaw
from lawfinder.functions.laws import Law
from lawfinder.functions.special import kolmogorov_exact, kolmogorov_sf, nelder_mead

EPS = 1e-10
#: Values on which the simplex starts; the whole sample refines what it finds.
COARSE = 1000
#: Stephens' critical values: levels in percent, values, and the factor by sample size.
ANDERSON = {
    "norm": ((15, 10, 5, 2.5, 1), (0.576, 0.656, 0.787, 0.918, 1.092), lambda n: 1 + 4 / n - 25 / n**2),
    "expon": ((15, 10, 5, 2.5, 1), (0.922, 1.078, 1.341, 1.606, 1.957), lambda n: 1 + 0.6 / n),
    "logistic": ((25, 10, 5, 2.5, 1, 0.5), (0.426, 0.563, 0.660, 0.769, 0.906, 1.010), lambda n: 1 + 0.25 / n),
    "gumbel_r": ((25, 10, 5, 2.5, 1), (0.474, 0.637, 0.757, 0.877, 1.038), lambda n: 1 + 0.2 / math.sqrt(n)),
    "gumbel_l": ((25, 10, 5, 2.5, 1), (0.474, 0.637, 0.757, 0.877, 1.038), lambda n: 1 + 0.2 / math.sqrt(n)),
}


def quantiles(x: np.ndarray, at, counts: np.ndarray | None = None) -> np.ndarray:
    """Linear quantiles; with ``counts`` of ordered values, each of which stands that often, none is repeated."""
    if counts is None:
        return np.quantile(x, at)
    upto = np.cumsum(counts)
    place = np.asarray(at, float) * (upto[-1] - 1)
    low = np.floor(place).astype(np.int64)
    a, b = (x[np.searchsorted(upto, np.minimum(k, upto[-1] - 1), "right")] for k in (low, low + 1))
    return a + (place - low) * (b - a)


def closed_form(name: str, x: np.ndarray, counts: np.ndarray | None = None):
    """Maximum-likelihood parameters where they have a formula (location free)."""
    low, high = float(x.min()), float(x.max())
    mean = lambda v: float(np.average(v, weights=counts))
    if name == "norm":
        m = mean(x)
        return m, math.sqrt(mean((x - m) ** 2))
    if name == "expon":
        return low, mean(x) - low
    if name == "uniform":
        return low, high - low
    if name == "laplace":
        m = float(quantiles(x, 0.5, counts))
        return m, mean(np.abs(x - m))
    if name == "halfnorm":
        return low, math.sqrt(mean((x - low) ** 2))
    return None


def starts(law: Law, x: np.ndarray) -> list[np.ndarray]:
    """Starting points: location and scale put the family's support, or its middle, on the data."""
    low, high, mid, spread = float(x.min()), float(x.max()), float(np.median(x)), float(x.std())
    iqr = float(np.subtract(*np.quantile(x, [0.75, 0.25]))) or spread
    margin = max((high - low) * 1e-3, 1e-9)
    out = []
    for s in law.starts:
        a, b = law.support(*s)
        q = law.ppf(np.array([0.25, 0.5, 0.75]), *s, 0.0, 1.0)
        width = max(float(q[2] - q[0]), 1e-9)
        if math.isfinite(a) and math.isfinite(b):
            scale = (high - low + 2 * margin) / (b - a)
            out.append([*s, low - margin - a * scale, scale])
        elif math.isfinite(a):
            scale = max(mid - low, iqr / 2, 1e-9) / max(float(q[1] - a), 1e-9)
            out.append([*s, low - margin - a * scale, scale])
            if low > 0 and a == 0:
                out.append([*s, 0.0, mid / max(float(q[1]), 1e-9)])
        elif math.isfinite(b):
            scale = max(high - mid, iqr / 2, 1e-9) / max(float(b - q[1]), 1e-9)
            out.append([*s, high + margin - b * scale, scale])
        else:
            scale = iqr / width
            out.append([*s, mid - float(q[1]) * scale, scale])
    return [np.array(o, float) for o in out]


def to_free(law: Law, p: np.ndarray) -> np.ndarray:
    return np.append(p[:-1], math.log(p[-1]))


def from_free(t: np.ndarray) -> np.ndarray:
    return np.append(t[:-1], math.exp(min(t[-1], 300)))


def search(law: Law, x: np.ndarray, objective, counts: np.ndarray | None = None) -> np.ndarray:
    """Simplex over shapes, location and log-scale: from each start on a part of the data, then on all of it.

    With ``counts`` the values are ordered and stand that often; the objective then takes them as a third argument.
    """
    n = len(x) if counts is None else int(counts.sum())
    if n <= COARSE and counts is not None:
        x, counts = np.repeat(x, counts), None
    part = x if n <= COARSE else quantiles(x, (np.arange(COARSE) + 0.5) / COARSE, counts)
    if len(part) < n:
        part[0], part[-1] = x.min(), x.max()
    spread = math.sqrt(np.average((x - np.average(x, weights=counts)) ** 2, weights=counts)) or 1.0

    def on(*data):
        def f(t):
            p = from_free(t)
            if not np.isfinite(p).all() or p[-1] <= 0 or not law.valid(*p[:-2]):
                return math.inf
            value = objective(data[0], p, *data[1:])
            return value if math.isfinite(value) else math.inf

        return f

    best, least = None, math.inf
    for s in starts(law, part):
        t = to_free(law, s)
        steps = np.append(np.where(np.abs(t[:-1]) > 1e-6, 0.15 * np.abs(t[:-1]), 0.1), 0.2)
        steps[-2] = 0.05 * spread if len(steps) > 1 else steps[-2]
        found, value = nelder_mead(on(part), t, steps, 1e-6, 250 * len(t))
        if value < least:
            best, least = found, value
    if best is None:
        raise ValueError("no start lies in the family's support")
    if len(part) < n:
        steps = np.append(np.where(np.abs(best[:-1]) > 1e-6, 0.01 * np.abs(best[:-1]), 0.01), 0.02)
        best, _ = nelder_mead(on(x) if counts is None else on(x, counts), best, steps, 1e-7, 40 * len(best))
    return from_free(best)


def fit_mle(law: Law, x: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, ...]:
    """Maximum-likelihood parameters of the values, or of ordered values that stand as often as ``counts`` says."""
    known = closed_form(law.name, x, counts)
    if known:
        return known
    return tuple(search(law, x, lambda d, p, w=None: -float(np.average(law.logpdf(d, *p), weights=w)), counts))


def fit_mse(law: Law, x: np.ndarray) -> tuple[float, ...]:
    """Largest product of spacings: robust where likelihoods are not bounded."""
    ordered = np.sort(x)

    def spacing(d, p):
        f = np.concatenate([[0.0], law.cdf(np.sort(d) if d is not ordered else d, *p), [1.0]])
        return -float(np.log(np.maximum(np.diff(f), EPS)).mean())

    return tuple(search(law, ordered, spacing))


def fit_censored(law: Law, x: np.ndarray, event: np.ndarray) -> tuple[float, ...]:
    """Densities of events and survival of right-censored values; at least one event is needed."""
    if not event.any():
        raise ValueError("no event was observed")

    def both(p):
        with np.errstate(all="ignore"):
            e = np.maximum(law.logpdf(x[event], *p), -700).sum()
            s = np.maximum(np.log(np.maximum(law.sf(x[~event], *p), 1e-304)), -700).sum()
        return -float(e + s) / len(x)

    best, least = None, math.inf
    for s in starts(law, x[event]):
        t = to_free(law, s)
        steps = np.append(np.where(np.abs(t[:-1]) > 1e-6, 0.15 * np.abs(t[:-1]), 0.1), 0.2)

        def f(t):
            p = from_free(t)
            return both(p) if np.isfinite(p).all() and p[-1] > 0 and law.valid(*p[:-2]) else math.inf

        found, value = nelder_mead(f, t, steps, 1e-7, 200 * len(t))
        if value < least:
            best, least = found, value
    return tuple(from_free(best))


class Truncated:
    """A law with given parameters, cut to [low, high]; None leaves a side open."""

    def __init__(self, law: Law, p, low: float | None = None, high: float | None = None):
        self.law, self.p = law, tuple(p)
        self.low, self.high = -math.inf if low is None else low, math.inf if high is None else high
        if self.low >= self.high:
            raise ValueError("the lower bound must be below the upper one")
        at = lambda v, d: d if math.isinf(v) else float(law.cdf(np.array([v]), *self.p)[0])
        self.fa, self.fb = at(self.low, 0.0), at(self.high, 1.0)
        self.mass = self.fb - self.fa

    def _inside(self, x):
        return (x >= self.low) & (x <= self.high)

    def logpdf(self, x):
        x = np.asarray(x, float)
        if self.mass <= 0:
            return np.full(x.shape, -math.inf)
        return np.where(self._inside(x), self.law.logpdf(x, *self.p) - math.log(self.mass), -math.inf)

    def pdf(self, x):
        return np.exp(self.logpdf(x))

    def cdf(self, x):
        x = np.asarray(x, float)
        if self.mass <= 0:
            return np.zeros(x.shape)
        f = (self.law.cdf(np.clip(x, self.low, self.high), *self.p) - self.fa) / self.mass
        return np.where(x < self.low, 0.0, np.where(x >= self.high, 1.0, np.clip(f, 0, 1)))

    def ppf(self, q):
        q = np.asarray(q, float)
        if self.mass <= 0:
            raise ValueError("the law has no mass between the bounds")
        return np.clip(self.law.ppf(self.fa + q * self.mass, *self.p), self.low, self.high)

    def rvs(self, size: int, seed: int | None = None):
        return self.ppf(np.random.default_rng(seed).random(size))

    def moments(self, n: int = 20_001) -> tuple[float, float]:
        """Mean and standard deviation, by averaging quantiles."""
        x = self.ppf((np.arange(n) + 0.5) / n)
        return float(x.mean()), float(x.std())


#: Values up to which K-S p-values are exact; beyond, the limit law at a corrected point is right to four digits.
EXACT_ROWS = 140


def corrected(n: int, d: float) -> float:
    """Where to read the limit law of K-S statistics for ``n`` values (Vrbik 2018)."""
    z = d * math.sqrt(n)
    return z + 1 / (6 * math.sqrt(n)) + (z - 1) / (4 * n)


def ks_statistic(ordered: np.ndarray, f: np.ndarray) -> tuple[float, float]:
    n = len(ordered)
    if not np.isfinite(f).all():
        return math.inf, 0.0
    i = np.arange(1, n + 1)
    d = float(max((i / n - f).max(), (f - (i - 1) / n).max()))
    return d, ks_pvalue(n, d)


def ks_pvalue(n: int, d: float) -> float:
    return kolmogorov_exact(n, d) if n <= EXACT_ROWS else kolmogorov_sf(corrected(n, d))


def ad_statistic(f: np.ndarray) -> float:
    n = len(f)
    if n < 2 or not np.isfinite(f).all():
        return math.inf
    f = np.clip(f, EPS, 1 - EPS)
    i = np.arange(1, n + 1)
    return float(-n - np.mean((2 * i - 1) * (np.log(f) + np.log1p(-f[::-1]))))


def ad_pvalue(name: str, statistic: float, n: int) -> float | None:
    """By interpolating the critical values; 0.25 below the first of them and 0.005 above the last."""
    if name not in ANDERSON or n < 5 or not math.isfinite(statistic):
        return None
    levels, values, factor = ANDERSON[name]
    values = [v / factor(n) for v in values]
    if statistic < values[0]:
        return 0.25
    if statistic > values[-1]:
        return 0.005
    return float(np.interp(statistic, values, [v / 100 for v in levels]))


def is_heavy_tailed(x: np.ndarray) -> bool:
    x = x[np.isfinite(x)]
    if len(x) < 10 or x.std() == 0:
        return False
    z = (x - x.mean()) / x.std()
    p99 = float(np.quantile(x, 0.99))
    return float((z**4).mean() - 3) > 6 or (p99 > 0 and float(x.max()) / p99 > 3)


def sse(cdf, density, edges) -> float:
    width = np.diff(edges)
    expected = np.nan_to_num(np.diff(cdf(edges)) / np.where(width > 0, width, 1)) if len(edges) > 1 else np.zeros(len(density))
    return float(((density - expected) ** 2).sum())


def score(law: Law, p, x: np.ndarray, density, edges, metrics: bool, low: float | None, high: float | None, event: np.ndarray | None = None) -> dict:
    """SSE, AIC, BIC and, with ``metrics``, K-S and A-D of fitted parameters."""
    held = Truncated(law, p, low, high) if low is not None or high is not None else None
    cdf = held.cdf if held else lambda v: law.cdf(v, *p)
    logpdf = held.logpdf if held else lambda v: law.logpdf(v, *p)
    out = {"sse": sse(cdf, density, edges)}
    if event is None:
        loglik = float(logpdf(x).sum())
    else:
        with np.errstate(all="ignore"):
            loglik = float(logpdf(x[event]).sum() + np.log(np.maximum(1 - cdf(x[~event]), 1e-304)).sum())
    k, n = len(p), len(x)
    finite = math.isfinite(loglik)
    out |= {"aic": 2 * k - 2 * loglik if finite else math.inf, "bic": k * math.log(n) - 2 * loglik if finite else math.inf}
    if metrics and event is None:
        ordered = np.sort(x)
        f = cdf(ordered)
        out["ks_statistic"], out["pvalue"] = ks_statistic(ordered, f)
        out["ad_statistic"] = ad_statistic(f)
        out["ad_pvalue"] = None if held else ad_pvalue(law.name, out["ad_statistic"], n)
    return out


# ---- discrete families, on distinct values and their counts


def fit_discrete(law: DiscreteLaw, values: np.ndarray, counts: np.ndarray) -> tuple[float, ...]:
    n = counts.sum()
    mean = float((values * counts).sum() / n)
    var = float((values**2 * counts).sum() / n - mean**2)
    low, high = float(values.min()), float(values.max())
    if law.name == "poisson" and low >= 0 and mean > 0:
        return (mean,)
    if law.name == "geom" and low >= 1:
        return (1 / mean,)
    if law.name == "planck" and low >= 0 and mean > 0:
        return (math.log1p(1 / mean),)
    lo, hi = np.array(law.bounds, float).T

    def f(t):
        p = law.settled(np.clip(np.exp(t), lo, hi))
        value = -float((counts * law.logpmf(values, *p)).sum()) / n
        return value if math.isfinite(value) else 1e300

    start = np.log(np.clip(law.start(mean, var, low, high), lo * 1.0001, hi))
    best, value = nelder_mead(f, start, np.full(len(start), 0.3), 1e-9, 400 * len(start))
    again, other = nelder_mead(f, best, np.full(len(start), 0.1), 1e-10, 200 * len(start))
    best, value = (again, other) if other < value else (best, value)
    if value >= 1e299:
        raise ValueError("the data lie outside the family's support")
    return law.settled(np.clip(np.exp(best), lo, hi))


def score_discrete(law: DiscreteLaw, p, values: np.ndarray, counts: np.ndarray, metrics: bool, low=None, high=None, every_row: bool = False) -> dict:
    """SSE against observed shares, AIC, BIC and K-S; bounds cut and renormalise the probabilities.

    every_row: take the K-S distance before each value at every row with that value instead of at the value.
    """
    n = counts.sum()
    pmf, cdf = law.pmf(values, *p), law.cdf(values, *p)
    if low is not None or high is not None:
        a = float(law.cdf(np.array([low - 1.0]), *p)[0]) if low is not None else 0.0
        b = float(law.cdf(np.array([float(high)]), *p)[0]) if high is not None else 1.0
        mass = b - a
        if mass <= 0:
            raise ValueError("the law has no mass between the bounds")
        pmf, cdf = pmf / mass, (cdf - a) / mass
    share = counts / n
    with np.errstate(divide="ignore"):
        loglik = float((counts * np.log(pmf)).sum())
    finite, k = math.isfinite(loglik), len(p)
    out = {"sse": float(((share - pmf) ** 2).sum()), "aic": 2 * k - 2 * loglik if finite else math.inf, "bic": k * math.log(n) - 2 * loglik if finite else math.inf}
    if metrics:
        seen = np.cumsum(share)
        d = float(np.abs(seen - cdf).max())
        if every_row:
            d = max(d, float((cdf - (seen - share)).max()))
        out |= {"ks_statistic": d, "pvalue": kolmogorov_sf(d * math.sqrt(n)), "ad_statistic": None, "ad_pvalue": None}
    return out
