"""The continuous families in standard form: log-density, distribution function, support and shape starts.

``Law.logpdf(x, *shapes, loc, scale)`` and its kin take parameters in the order shapes, loc, scale.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from lawfinder.functions.special import LOG2PI, SQRT2, bessel_i0e, bessel_k1e, betainc, betaln, erf, erfc, gammainc, gammaln, invert, log_ndtr, ndtr, ndtri

INF = math.inf
log, log1p, exp, expm1, sqrt, pi = np.log, np.log1p, np.exp, np.expm1, np.sqrt, np.pi


def trapezoid_grid(logpdf: Callable, low: float, high: float, x, n: int = 4001):
    """Distribution function by integrating the density on a tangent-spaced grid."""
    u = np.linspace(-0.5, 0.5, n)[1:-1] * 0.9999
    g = np.tan(pi * u) * 3 if not (math.isfinite(low) and math.isfinite(high)) else low + (high - low) * (u / 0.9999 + 0.5)
    if math.isfinite(low) and not math.isfinite(high):
        v = (u / 0.9999 + 0.5)
        g = low + 3 * v / (1 - v)
    with np.errstate(all="ignore"):
        p = np.nan_to_num(exp(logpdf(g)))
    c = np.concatenate([[0], np.cumsum((p[1:] + p[:-1]) / 2 * np.diff(g))])
    c = c / c[-1] if c[-1] > 0 else c
    return np.interp(x, g, c, left=0, right=1)


@dataclass(frozen=True)
class Law:
    name: str
    shapes: tuple[str, ...]
    support: Callable[..., tuple[float, float]]
    std_logpdf: Callable
    std_cdf: Callable
    starts: tuple[tuple[float, ...], ...]
    std_ppf: Callable | None = None
    valid: Callable[..., bool] = lambda *s: all(v > 0 for v in s)
    flags: frozenset = field(default_factory=frozenset)

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.shapes, "loc", "scale")

    def bounds(self, *p) -> tuple[float, float]:
        a, b = self.support(*p[:-2])
        return p[-2] + p[-1] * a, p[-2] + p[-1] * b

    def logpdf(self, x, *p):
        *s, loc, scale = p
        z = (np.asarray(x, float) - loc) / scale
        a, b = self.support(*s)
        with np.errstate(all="ignore"):
            out = np.asarray(self.std_logpdf(z, *s), float) - math.log(scale)
        return np.where((z >= a) & (z <= b) & ~np.isnan(out), out, -INF)

    def pdf(self, x, *p):
        return exp(self.logpdf(x, *p))

    def cdf(self, x, *p):
        *s, loc, scale = p
        z = (np.asarray(x, float) - loc) / scale
        a, b = self.support(*s)
        with np.errstate(all="ignore"):
            out = np.asarray(self.std_cdf(np.clip(z, a, b), *s), float)
        return np.clip(np.where(z <= a, 0.0, np.where(z >= b, 1.0, out)), 0, 1)

    def sf(self, x, *p):
        return 1 - self.cdf(x, *p)

    def ppf(self, q, *p):
        *s, loc, scale = p
        q = np.asarray(q, float)
        a, b = self.support(*s)
        with np.errstate(all="ignore"):
            z = self.std_ppf(q, *s) if self.std_ppf else invert(lambda t: self.std_cdf(t, *s), q, a, b)
        z = np.where((q < 0) | (q > 1), np.nan, np.where(q == 0, a, np.where(q == 1, b, z)))
        return loc + scale * z

    def rvs(self, size: int, *p, seed: int | None = None):
        return self.ppf(np.random.default_rng(seed).random(size), *p)


LAWS: dict[str, Law] = {}
R, P, U = (lambda *s: (-INF, INF)), (lambda *s: (0.0, INF)), (lambda *s: (0.0, 1.0))


def law(name, shapes, support, logpdf, cdf, starts=((),), ppf=None, valid=None):
    kw = {"valid": valid} if valid else {}
    LAWS[name] = Law(name, tuple(shapes.split()), support, logpdf, cdf, tuple(starts), ppf, **kw)


def lx(x):
    return log(np.maximum(x, 1e-300))


anyway = lambda *s: True

# ---- elementary distribution functions
law("anglit", "", lambda: (-pi / 4, pi / 4), lambda x: log(np.cos(2 * x)), lambda x: np.sin(x + pi / 4) ** 2, ppf=lambda q: np.arcsin(sqrt(q)) - pi / 4)
law("arcsine", "", U, lambda x: -log(pi) - 0.5 * lx(x) - 0.5 * lx(1 - x), lambda x: 2 / pi * np.arcsin(sqrt(x)), ppf=lambda q: np.sin(pi / 2 * q) ** 2)
law("bradford", "c", U, lambda x, c: log(c) - log(log1p(c)) - log1p(c * x), lambda x, c: log1p(c * x) / log1p(c), [(1.0,)], lambda q, c: expm1(q * log1p(c)) / c)
law("burr", "c d", P, lambda x, c, d: log(c * d) - (c + 1) * lx(x) - (d + 1) * log1p(exp(-c * lx(x))), lambda x, c, d: exp(-d * log1p(exp(-c * lx(x)))), [(2.0, 1.0), (5.0, 0.5)], lambda q, c, d: (q ** (-1 / d) - 1) ** (-1 / c))
law("burr12", "c d", P, lambda x, c, d: log(c * d) + (c - 1) * lx(x) - (d + 1) * log1p(exp(c * lx(x))), lambda x, c, d: -expm1(-d * log1p(exp(c * lx(x)))), [(2.0, 1.0), (1.2, 3.0)], lambda q, c, d: expm1(-log1p(-q) / d) ** (1 / c))
law("cauchy", "", R, lambda x: -log(pi) - log1p(x * x), lambda x: 0.5 + np.arctan(x) / pi, ppf=lambda q: np.tan(pi * (q - 0.5)))
law("cosine", "", lambda: (-pi, pi), lambda x: log1p(np.cos(x)) - log(2 * pi), lambda x: (pi + x + np.sin(x)) / (2 * pi))
law("dweibull", "c", R, lambda x, c: log(c / 2) + (c - 1) * lx(abs(x)) - abs(x) ** c, lambda x, c: np.where(x < 0, 0.5 * exp(-(abs(x) ** c)), 1 - 0.5 * exp(-(abs(x) ** c))), [(1.5,)], lambda q, c: np.where(q < 0.5, -1, 1) * (-log(2 * np.minimum(q, 1 - q))) ** (1 / c))
law("expon", "", P, lambda x: -x, lambda x: -expm1(-x), ppf=lambda q: -log1p(-q))
law("exponweib", "a c", P, lambda x, a, c: log(a * c) + (a - 1) * lx(-expm1(-(x**c))) - x**c + (c - 1) * lx(x), lambda x, a, c: (-expm1(-(x**c))) ** a, [(1.0, 1.5), (2.0, 1.0)], lambda q, a, c: (-log1p(-(q ** (1 / a)))) ** (1 / c))
law("fisk", "c", P, lambda x, c: log(c) + (c - 1) * lx(x) - 2 * log1p(exp(c * lx(x))), lambda x, c: 1 / (1 + exp(-c * lx(x))), [(2.0,)], lambda q, c: (q / (1 - q)) ** (1 / c))
law("foldcauchy", "c", P, lambda x, c: -log(pi) + log(1 / (1 + (x - c) ** 2) + 1 / (1 + (x + c) ** 2)), lambda x, c: (np.arctan(x - c) + np.arctan(x + c)) / pi, [(1.0,)])
law("genexpon", "a b c", P, lambda x, a, b, c: log(a - b * expm1(-c * x)) - (a + b) * x - b * expm1(-c * x) / c, lambda x, a, b, c: -expm1(-(a + b) * x - b * expm1(-c * x) / c), [(1.0, 1.0, 1.0)])


def _gev(x, c):
    t = np.where(abs(c) < 1e-9, exp(-x), exp(lx(1 - c * x) / (c if abs(c) >= 1e-9 else 1)))
    return t


law("genextreme", "c", lambda c: (-INF, 1 / c) if c > 1e-9 else (1 / c, INF) if c < -1e-9 else (-INF, INF), lambda x, c: -_gev(x, c) + (log(_gev(x, c)) - lx(1 - c * x) if abs(c) >= 1e-9 else -x), lambda x, c: exp(-_gev(x, c)), [(0.1,), (-0.1,)], lambda q, c: -log(-log(q)) if abs(c) < 1e-9 else -expm1(c * log(-log(q))) / c, anyway)
law("genhalflogistic", "c", lambda c: (0.0, 1 / c), lambda x, c: log(2) + (1 / c - 1) * lx(1 - c * x) - 2 * log1p(exp(lx(1 - c * x) / c)), lambda x, c: (1 - exp(lx(1 - c * x) / c)) / (1 + exp(lx(1 - c * x) / c)), [(0.3,)])
law("genlogistic", "c", R, lambda x, c: log(c) - x - (c + 1) * np.logaddexp(0, -x), lambda x, c: exp(-c * np.logaddexp(0, -x)), [(1.0,), (5.0,)], lambda q, c: -log(q ** (-1 / c) - 1))
law("genpareto", "c", lambda c: (0.0, -1 / c) if c < 0 else (0.0, INF), lambda x, c: -x if abs(c) < 1e-9 else -(1 / c + 1) * lx(1 + c * x), lambda x, c: -expm1(-x) if abs(c) < 1e-9 else -expm1(-lx(1 + c * x) / c), [(0.1,), (-0.5,)], lambda q, c: -log1p(-q) if abs(c) < 1e-9 else expm1(-c * log1p(-q)) / c, anyway)
law("gompertz", "c", P, lambda x, c: log(c) + x - c * expm1(x), lambda x, c: -expm1(-c * expm1(x)), [(1.0,), (0.1,)], lambda q, c: log1p(-log1p(-q) / c))
law("gumbel_l", "", R, lambda x: x - exp(x), lambda x: -expm1(-exp(x)), ppf=lambda q: log(-log1p(-q)))
law("gumbel_r", "", R, lambda x: -x - exp(-x), lambda x: exp(-exp(-x)), ppf=lambda q: -log(-log(q)))
law("halfcauchy", "", P, lambda x: log(2 / pi) - log1p(x * x), lambda x: 2 / pi * np.arctan(x), ppf=lambda q: np.tan(pi / 2 * q))
law("halflogistic", "", P, lambda x: log(2) - x - 2 * log1p(exp(-x)), lambda x: np.tanh(x / 2), ppf=lambda q: 2 * np.arctanh(q))
law("hypsecant", "", R, lambda x: -log(pi) + log(2) - np.logaddexp(x, -x), lambda x: 2 / pi * np.arctan(exp(x)), ppf=lambda q: log(np.tan(pi * q / 2)))
law("invweibull", "c", P, lambda x, c: log(c) - (c + 1) * lx(x) - exp(-c * lx(x)), lambda x, c: exp(-exp(-c * lx(x))), [(2.0,)], lambda q, c: (-log(q)) ** (-1 / c))


def _irwin(x, n, top):
    n = max(1, round(n))
    x = np.where(x > n / 2, n - x, x) if top == n - 1 else x
    return sum((-1) ** k * math.comb(n, k) * np.maximum(x - k, 0) ** top for k in range(n + 1)) / math.factorial(top)


law("irwinhall", "n", lambda n: (0.0, float(max(1, round(n)))), lambda x, n: lx(_irwin(x, n, max(1, round(n)) - 1) if round(n) > 1 else np.ones_like(x)), lambda x, n: np.where(x > max(1, round(n)) / 2, 1 - _irwin(max(1, round(n)) - x, n, max(1, round(n))), _irwin(x, n, max(1, round(n)))), [(2.0,), (4.0,)], valid=lambda n: 0.5 <= n <= 15)
law("kappa3", "a", P, lambda x, a: log(a) - (1 + 1 / a) * log(a + x**a), lambda x, a: x * (a + x**a) ** (-1 / a), [(1.0,), (2.0,)])
law("laplace", "", R, lambda x: -log(2) - abs(x), lambda x: np.where(x < 0, 0.5 * exp(-abs(x)), 1 - 0.5 * exp(-abs(x))), ppf=lambda q: np.where(q < 0.5, log(2 * q), -log(2 * (1 - q))))
law("laplace_asymmetric", "kappa", R, lambda x, k: -log(k + 1 / k) - np.where(x >= 0, x * k, -x / k), lambda x, k: np.where(x >= 0, 1 - exp(-abs(x) * k) / k / (k + 1 / k), exp(-abs(x) / k) * k / (k + 1 / k)), [(1.0,), (0.5,)])
law("logistic", "", R, lambda x: -x - 2 * np.logaddexp(0, -x), lambda x: 1 / (1 + exp(-x)), ppf=lambda q: log(q / (1 - q)))
law("loglaplace", "c", P, lambda x, c: log(c / 2) + np.where(x < 1, (c - 1) * lx(x), -(c + 1) * lx(x)), lambda x, c: np.where(x < 1, 0.5 * x**c, 1 - 0.5 * np.maximum(x, 1e-300) ** -c), [(2.0,)])
for _name in ("loguniform", "reciprocal"):
    law(_name, "a b", lambda a, b: (a, b), lambda x, a, b: -lx(x) - log(log(b / a)), lambda x, a, b: log(x / a) / log(b / a), [(0.01, 1.0)], lambda q, a, b: a * (b / a) ** q, lambda a, b: 0 < a < b)
law("lomax", "c", P, lambda x, c: log(c) - (c + 1) * log1p(x), lambda x, c: -expm1(-c * log1p(x)), [(2.0,)], lambda q, c: expm1(-log1p(-q) / c))
law("pareto", "b", lambda b: (1.0, INF), lambda x, b: log(b) - (b + 1) * lx(x), lambda x, b: 1 - np.maximum(x, 1e-300) ** -b, [(2.0,)], lambda q, b: (1 - q) ** (-1 / b))
law("powerlaw", "a", U, lambda x, a: log(a) + (a - 1) * lx(x), lambda x, a: x**a, [(1.5,), (0.5,)], lambda q, a: q ** (1 / a))
law("rayleigh", "", P, lambda x: lx(x) - x * x / 2, lambda x: -expm1(-x * x / 2), ppf=lambda q: sqrt(-2 * log1p(-q)))


def _breit(x, rho):
    return log(sqrt(2 * (1 + 1 / rho**2) / (1 + sqrt(1 + 1 / rho**2))) * 2 / pi) - log(((x - rho) * (x + rho) / rho) ** 2 + 1)


def _breit_cdf(x, rho):
    g = np.concatenate([np.linspace(0, 4 * rho + 40, 20001), np.geomspace(4 * rho + 40, 1e4 * (rho + 1), 4000)[1:]])
    p = exp(_breit(g, rho))
    c = np.concatenate([[0], np.cumsum((p[1:] + p[:-1]) / 2 * np.diff(g))])
    return np.interp(x, g, c / c[-1])


law("rel_breitwigner", "rho", P, _breit, _breit_cdf, [(2.0,), (10.0,)])
law("semicircular", "", lambda: (-1.0, 1.0), lambda x: log(2 / pi) + 0.5 * lx(1 - x * x), lambda x: 0.5 + (x * sqrt(1 - x * x) + np.arcsin(x)) / pi)
law("skewcauchy", "a", R, lambda x, a: -log(pi * (x**2 / (a * np.sign(x) + 1) ** 2 + 1)), lambda x, a: np.where(x <= 0, (1 - a) / 2 + (1 - a) / pi * np.arctan(x / (1 - a)), (1 - a) / 2 + (1 + a) / pi * np.arctan(x / (1 + a))), [(0.0,), (0.5,)], valid=lambda a: abs(a) < 1)
law("trapezoid", "c d", U, lambda x, c, d: lx(2 / (d - c + 1) * np.where(x < c, x / max(c, 1e-12), np.where(x <= d, 1, (1 - x) / max(1 - d, 1e-12)))), lambda x, c, d: np.where(x < c, x * x / max(c, 1e-12), np.where(x <= d, c + 2 * (x - c), (d - c + 1) - (1 - x) ** 2 / max(1 - d, 1e-12))) / (d - c + 1), [(0.3, 0.7)], valid=lambda c, d: 0 <= c <= d <= 1)
law("triang", "c", U, lambda x, c: lx(2 * np.where(x < c, x / max(c, 1e-12), (1 - x) / max(1 - c, 1e-12))), lambda x, c: np.where(x < c, x * x / max(c, 1e-12), 1 - (1 - x) ** 2 / max(1 - c, 1e-12)), [(0.5,)], valid=lambda c: 0 <= c <= 1)
law("truncexpon", "b", lambda b: (0.0, b), lambda x, b: -x - log(-expm1(-b)), lambda x, b: expm1(-x) / expm1(-b), [(2.0,)], lambda q, b: -log1p(q * expm1(-b)))
law("truncpareto", "b c", lambda b, c: (1.0, c), lambda x, b, c: log(b) - log1p(-(c**-b)) - (b + 1) * lx(x), lambda x, b, c: (1 - x**-b) / (1 - c**-b), [(1.0, 10.0)], valid=lambda b, c: b > 0 and c > 1)
law("truncweibull_min", "c a b", lambda c, a, b: (a, b), lambda x, c, a, b: log(c) + (c - 1) * lx(x) - x**c - log(exp(-(a**c)) - exp(-(b**c))), lambda x, c, a, b: (exp(-(a**c)) - exp(-(x**c))) / (exp(-(a**c)) - exp(-(b**c))), [(1.5, 0.01, 3.0)], valid=lambda c, a, b: c > 0 and 0 <= a < b)
law("uniform", "", U, lambda x: 0.0 * x, lambda x: x, ppf=lambda q: q)
law("weibull_max", "c", lambda c: (-INF, 0.0), lambda x, c: log(c) + (c - 1) * lx(-x) - (-x) ** c, lambda x, c: exp(-((-x) ** c)), [(1.5,)], lambda q, c: -((-log(q)) ** (1 / c)))
law("weibull_min", "c", P, lambda x, c: log(c) + (c - 1) * lx(x) - x**c, lambda x, c: -expm1(-(x**c)), [(1.5,)], lambda q, c: (-log1p(-q)) ** (1 / c))
law("wrapcauchy", "c", lambda c: (0.0, 2 * pi), lambda x, c: log((1 - c * c) / (2 * pi)) - log(1 + c * c - 2 * c * np.cos(x)), lambda x, c: np.where(x < pi, np.arctan((1 + c) / (1 - c) * np.tan(x / 2)) / pi, 1 - np.arctan((1 + c) / (1 - c) * np.tan((2 * pi - x) / 2)) / pi), [(0.3,)], valid=lambda c: 0 < c < 1)

# ---- with the error function
_nl = lambda x: -x * x / 2 - LOG2PI / 2
law("alpha", "a", P, lambda x, a: -2 * lx(x) - log(ndtr(a)) + _nl(a - 1 / x), lambda x, a: ndtr(a - 1 / np.maximum(x, 1e-300)) / ndtr(a), [(1.0,), (4.0,)])


def _ball(x, b, m):
    n = 1 / (m / b / (m - 1) * exp(-b * b / 2) + SQRT2 * sqrt(pi) * ndtr(b))
    return log(n) + np.where(x > -b, -x * x / 2, m * log(m / b) - b * b / 2 - m * lx(m / b - b - x))


def _ball_cdf(x, b, m):
    n = 1 / (m / b / (m - 1) * exp(-b * b / 2) + SQRT2 * sqrt(pi) * ndtr(b))
    left = (m / b) ** m * exp(-b * b / 2) * np.maximum(m / b - b - np.minimum(x, -b), 1e-300) ** (1 - m) / (m - 1)
    return n * np.where(x > -b, m / b * exp(-b * b / 2) / (m - 1) + SQRT2 * sqrt(pi) * (ndtr(x) - ndtr(-b)), left)


law("crystalball", "beta m", R, _ball, _ball_cdf, [(2.0, 3.0)], valid=lambda b, m: b > 0 and 1 < m < 500)
law("exponnorm", "K", R, lambda x, k: -log(k) + 1 / (2 * k * k) - x / k + log_ndtr(x - 1 / k), lambda x, k: ndtr(x) - exp(1 / (2 * k * k) - x / k + log_ndtr(x - 1 / k)), [(1.0,)])
law("fatiguelife", "c", P, lambda x, c: log(x + 1) - log(2 * c) - LOG2PI / 2 - 1.5 * lx(x) - (x - 1) ** 2 / (2 * x * c * c), lambda x, c: ndtr((sqrt(x) - 1 / sqrt(np.maximum(x, 1e-300))) / c), [(1.0,)])
law("foldnorm", "c", P, lambda x, c: np.logaddexp(_nl(x - c), _nl(x + c)), lambda x, c: ndtr(x - c) - ndtr(-x - c), [(1.0,)])
law("gibrat", "", P, lambda x: _nl(lx(x)) - lx(x), lambda x: ndtr(lx(x)), ppf=lambda q: exp(ndtri(q)))
law("halfnorm", "", P, lambda x: log(2) + _nl(x), lambda x: 2 * ndtr(x) - 1, ppf=lambda q: ndtri((1 + q) / 2))
law("invgauss", "mu", P, lambda x, m: -0.5 * LOG2PI - 1.5 * lx(x) - (x - m) ** 2 / (2 * x * m * m), lambda x, m: ndtr((x / m - 1) / sqrt(np.maximum(x, 1e-300))) + exp(2 / m + log_ndtr(-(x / m + 1) / sqrt(np.maximum(x, 1e-300)))), [(1.0,)])
law("johnsonsb", "a b", U, lambda x, a, b: log(b) - lx(x) - lx(1 - x) + _nl(a + b * (lx(x) - lx(1 - x))), lambda x, a, b: ndtr(a + b * (lx(x) - lx(1 - x))), [(0.0, 1.0)], lambda q, a, b: 1 / (1 + exp(-(ndtri(q) - a) / b)), lambda a, b: b > 0)
law("johnsonsu", "a b", R, lambda x, a, b: log(b) - 0.5 * log1p(x * x) + _nl(a + b * np.arcsinh(x)), lambda x, a, b: ndtr(a + b * np.arcsinh(x)), [(0.0, 1.5)], lambda q, a, b: np.sinh((ndtri(q) - a) / b), lambda a, b: b > 0)
law("levy", "", P, lambda x: -LOG2PI / 2 - 1.5 * lx(x) - 1 / (2 * x), lambda x: erfc(sqrt(0.5 / np.maximum(x, 1e-300))), ppf=lambda q: ndtri(q / 2) ** -2.0)
law("levy_l", "", lambda: (-INF, 0.0), lambda x: -LOG2PI / 2 - 1.5 * lx(-x) - 1 / (2 * -x), lambda x: erf(sqrt(0.5 / np.maximum(-x, 1e-300))), ppf=lambda q: -(ndtri((1 + q) / 2) ** -2.0))
law("lognorm", "s", P, lambda x, s: _nl(lx(x) / s) - log(s) - lx(x), lambda x, s: ndtr(lx(x) / s), [(0.5,), (1.0,)], lambda q, s: exp(s * ndtri(q)))
law("maxwell", "", P, lambda x: log(2) - LOG2PI / 2 + 2 * lx(x) - x * x / 2, lambda x: 2 * ndtr(x) - 1 - 2 * x * exp(_nl(x)))
law("moyal", "", R, lambda x: -(x + exp(-x)) / 2 - LOG2PI / 2, lambda x: erfc(exp(-x / 2) / SQRT2), ppf=lambda q: -2 * log(-ndtri(q / 2)))
law("norm", "", R, _nl, ndtr, ppf=ndtri)
law("powerlognorm", "c s", P, lambda x, c, s: log(c) - lx(x) - log(s) + _nl(lx(x) / s) + (c - 1) * log_ndtr(-lx(x) / s), lambda x, c, s: -expm1(c * log_ndtr(-lx(x) / s)), [(1.0, 0.7)])
law("powernorm", "c", R, lambda x, c: log(c) + _nl(x) + (c - 1) * log_ndtr(-x), lambda x, c: -expm1(c * log_ndtr(-x)), [(1.0,)])
law("truncnorm", "a b", lambda a, b: (a, b), lambda x, a, b: _nl(x) - log(ndtr(b) - ndtr(a)), lambda x, a, b: (ndtr(x) - ndtr(a)) / (ndtr(b) - ndtr(a)), [(-2.0, 2.0)], lambda q, a, b: ndtri(ndtr(a) + q * (ndtr(b) - ndtr(a))), lambda a, b: a < b)

# ---- with the incomplete gamma function


def _argus(chi):
    return gammainc(1.5, np.array([chi * chi / 2]))[0] / 2


law("argus", "chi", U, lambda x, c: 3 * log(c) - LOG2PI / 2 - log(_argus(c)) + lx(x) + 0.5 * lx(1 - x * x) - c * c * (1 - x * x) / 2, lambda x, c: 1 - gammainc(1.5, c * c * (1 - x * x) / 2) / 2 / _argus(c), [(1.0,)])
law("chi", "df", P, lambda x, d: (1 - d / 2) * log(2) - gammaln(d / 2) + (d - 1) * lx(x) - x * x / 2, lambda x, d: gammainc(d / 2, x * x / 2), [(2.0,)])
law("chi2", "df", P, lambda x, d: (d / 2 - 1) * lx(x) - x / 2 - gammaln(d / 2) - d / 2 * log(2), lambda x, d: gammainc(d / 2, x / 2), [(3.0,)])
law("dgamma", "a", R, lambda x, a: (a - 1) * lx(abs(x)) - abs(x) - log(2) - gammaln(a), lambda x, a: 0.5 + np.sign(x) * 0.5 * gammainc(a, abs(x)), [(1.5,)])
for _name in ("gamma", "erlang"):
    law(_name, "a", P, lambda x, a: (a - 1) * lx(x) - x - gammaln(a), lambda x, a: gammainc(a, x), [(2.0,)])
law("gengamma", "a c", P, lambda x, a, c: log(abs(c)) - gammaln(a) + (c * a - 1) * lx(x) - exp(c * lx(x)), lambda x, a, c: gammainc(a, exp(c * lx(x))) if c > 0 else 1 - gammainc(a, exp(c * lx(x))), [(1.5, 1.2)], valid=lambda a, c: a > 0 and abs(c) > 1e-3)
law("gennorm", "beta", R, lambda x, b: log(b / 2) - gammaln(1 / b) - abs(x) ** b, lambda x, b: 0.5 + 0.5 * np.sign(x) * gammainc(1 / b, abs(x) ** b), [(1.5,)])
law("halfgennorm", "beta", P, lambda x, b: log(b) - gammaln(1 / b) - x**b, lambda x, b: gammainc(1 / b, x**b), [(1.0,)])
law("invgamma", "a", P, lambda x, a: -(a + 1) * lx(x) - gammaln(a) - 1 / x, lambda x, a: 1 - gammainc(a, 1 / np.maximum(x, 1e-300)), [(2.0,)])
law("loggamma", "c", R, lambda x, c: c * x - exp(x) - gammaln(c), lambda x, c: gammainc(c, exp(x)), [(1.0,)])
law("nakagami", "nu", P, lambda x, n: log(2) + n * log(n) - gammaln(n) + (2 * n - 1) * lx(x) - n * x * x, lambda x, n: gammainc(n, n * x * x), [(1.0,)])


def _pearson(x, k):
    b = 2 / k
    a, z = b * b, (x + b) * b
    return log(abs(b)) + (a - 1) * lx(z) - z - gammaln(a)


law("pearson3", "skew", lambda k: (-INF, INF) if abs(k) < 1e-4 else (-2 / k, INF) if k > 0 else (-INF, -2 / k), lambda x, k: _nl(x) if abs(k) < 1e-4 else _pearson(x, k), lambda x, k: ndtr(x) if abs(k) < 1e-4 else gammainc(4 / k**2, (x + 2 / k) * 2 / k) if k > 0 else 1 - gammainc(4 / k**2, (x + 2 / k) * 2 / k), [(0.5,), (-0.5,)], valid=lambda k: abs(k) < 20)

# ---- with the incomplete beta function
law("beta", "a b", U, lambda x, a, b: (a - 1) * lx(x) + (b - 1) * lx(1 - x) - betaln(a, b), lambda x, a, b: betainc(a, b, x), [(2.0, 2.0), (1.0, 3.0)])
law("betaprime", "a b", P, lambda x, a, b: (a - 1) * lx(x) - (a + b) * log1p(x) - betaln(a, b), lambda x, a, b: betainc(a, b, x / (1 + x)), [(2.0, 3.0)])
law("f", "dfn dfd", P, lambda x, n, d: d / 2 * log(d) + n / 2 * log(n) + (n / 2 - 1) * lx(x) - (n + d) / 2 * log(d + n * x) - betaln(n / 2, d / 2), lambda x, n, d: betainc(n / 2, d / 2, n * x / (d + n * x)), [(5.0, 10.0)])
law("jf_skew_t", "a b", R, lambda x, a, b: -((a + b - 1) * log(2) + betaln(a, b) + 0.5 * log(a + b)) + (a + 0.5) * log1p(x / sqrt(a + b + x * x)) + (b + 0.5) * log1p(-x / sqrt(a + b + x * x)), lambda x, a, b: betainc(a, b, (1 + x / sqrt(a + b + x * x)) / 2), [(3.0, 3.0)])
law("rdist", "c", lambda c: (-1.0, 1.0), lambda x, c: (c / 2 - 1) * lx(1 - x * x) - betaln(0.5, c / 2), lambda x, c: betainc(c / 2, c / 2, (x + 1) / 2), [(3.0,)])
law("t", "df", R, lambda x, d: gammaln((d + 1) / 2) - gammaln(d / 2) - 0.5 * log(d * pi) - (d + 1) / 2 * log1p(x * x / d), lambda x, d: np.where(x > 0, 1 - 0.5 * betainc(d / 2, 0.5, d / (d + x * x)), 0.5 * betainc(d / 2, 0.5, d / (d + x * x))), [(5.0,)])

# ---- with quadrature


def _landau_density():
    """A grid and the density on it, by integrating sin(pi t) exp(-t log t - x t) / pi over t."""
    t = np.linspace(1e-6, 30, 2000)
    g = np.linspace(-4, 60, 3000)
    body = exp(np.clip(-t[None, :] * log(t)[None, :] - g[:, None] * t[None, :], -700, 300)) * np.sin(pi * t)[None, :]
    p = np.trapezoid(body, t, axis=1) / pi
    return g, np.maximum(p, 1e-300)


_LANDAU: list = []


def _landau_table():
    if not _LANDAU:
        g, p = _landau_density()
        p = np.where(g < -3.2, 1e-12, p)
        c = np.concatenate([[0], np.cumsum((p[1:] + p[:-1]) / 2 * np.diff(g))])
        _LANDAU.append((g, log(p), c / (c[-1] + 1 / 60)))
    return _LANDAU[0]


law("landau", "", R, lambda x: np.where(x > 60, -2 * lx(x), np.interp(x, _landau_table()[0], _landau_table()[1])), lambda x: np.where(x > 60, 1 - 1 / np.maximum(x, 1), np.interp(x, _landau_table()[0], _landau_table()[2])))
_nig = lambda x, a, b: log(a / pi) + sqrt(a * a - b * b) + b * x + log(bessel_k1e(a * sqrt(1 + x * x))) - a * sqrt(1 + x * x) - 0.5 * log1p(x * x)
law("norminvgauss", "a b", R, _nig, lambda x, a, b: trapezoid_grid(lambda g: _nig(g, a, b), -INF, INF, x), [(1.0, 0.0)], valid=lambda a, b: a > abs(b))
_rice = lambda x, b: lx(x) - (x - b) ** 2 / 2 + log(bessel_i0e(x * b))
law("rice", "b", P, _rice, lambda x, b: trapezoid_grid(lambda g: _rice(g, b), 0.0, INF, x) if b < 20 else ndtr(x - b - 0.5 / b), [(1.0,)], valid=lambda b: b >= 0)
_skn = lambda x, a: log(2) + _nl(x) + log_ndtr(a * x)
law("skewnorm", "a", R, _skn, lambda x, a: trapezoid_grid(lambda g: _skn(g, a), -INF, INF, x), [(2.0,), (-2.0,)], valid=anyway)

# ---- left out by default
law("exponpow", "b", P, lambda x, b: 1 + log(b) + (b - 1) * lx(x) + x**b - exp(x**b), lambda x, b: -expm1(-expm1(x**b)), [(1.0,)], lambda q, b: log1p(-log1p(-q)) ** (1 / b))
law("mielke", "k s", P, lambda x, k, s: log(k) + (k - 1) * lx(x) - (1 + k / s) * log1p(x**s), lambda x, k, s: x**k / (1 + x**s) ** (k / s), [(2.0, 3.0)])
law("wald", "", P, lambda x: -0.5 * LOG2PI - 1.5 * lx(x) - (x - 1) ** 2 / (2 * x), lambda x: ndtr((x - 1) / sqrt(np.maximum(x, 1e-300))) + exp(2 + log_ndtr(-(x + 1) / sqrt(np.maximum(x, 1e-300)))))
law("recipinvgauss", "mu", P, lambda x, m: -((1 - m * x) ** 2) / (2 * x * m * m) - 0.5 * (LOG2PI + lx(x)), lambda x, m: 1 - LAWS["invgauss"].std_cdf(1 / np.maximum(x, 1e-300), m), [(1.0,)])
law("kappa4", "h k", lambda h, k: ((1 - h ** -k) / k if h > 0 and k else -INF, 1 / k if k > 0 else INF), lambda x, h, k: (1 / k - 1) * lx(1 - k * x) + (1 / h - 1) * lx(1 - h * exp(lx(1 - k * x) / k)), lambda x, h, k: exp(lx(1 - h * exp(lx(1 - k * x) / k)) / h), [(0.5, 0.2)], valid=lambda h, k: h > 1e-3 and k > 1e-3)
law("tukeylambda", "lam", lambda l: (-1 / l, 1 / l) if l > 0 else (-INF, INF), lambda x, l: _tukey(x, l, True), lambda x, l: _tukey(x, l, False), [(0.14,)], lambda q, l: (q**l - (1 - q) ** l) / l, lambda l: abs(l) > 1e-6)
law("vonmises_line", "kappa", lambda k: (-pi, pi), lambda x, k: k * (np.cos(x) - 1) - log(2 * pi * bessel_i0e(np.array(k))), lambda x, k: trapezoid_grid(lambda g: k * (np.cos(g) - 1), -pi, pi, x), [(1.0,)])
law("vonmises", "kappa", lambda k: (-pi, pi), lambda x, k: k * (np.cos(x) - 1) - log(2 * pi * bessel_i0e(np.array(k))), lambda x, k: trapezoid_grid(lambda g: k * (np.cos(g) - 1), -pi, pi, x), [(1.0,)])
_ncx2 = lambda x, d, n: lx(sum(exp(-n / 2 + j * log(n / 2) - gammaln(j + 1) + (d / 2 + j - 1) * lx(x) - x / 2 - gammaln(d / 2 + j) - (d / 2 + j) * log(2)) for j in range(int(n / 2 + 8 * sqrt(n / 2 + 1)) + 8)))
law("ncx2", "df nc", P, _ncx2, lambda x, d, n: trapezoid_grid(lambda g: _ncx2(g, d, n), 0.0, INF, x), [(3.0, 1.0)], valid=lambda d, n: d > 0 and 0 < n < 400)
law("kstwobign", "", P, lambda x: lx(8 * x * sum((-1) ** (k - 1) * k * k * exp(-2 * k * k * x * x) for k in range(1, 30))), lambda x: 1 - 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * x * x) for k in range(1, 30)))


def _tukey(x, l, density):
    q = np.linspace(1e-7, 1 - 1e-7, 4001)
    g = (q**l - (1 - q) ** l) / l
    p = np.interp(x, g, q)
    return -log(p ** (l - 1) + (1 - p) ** (l - 1)) if density else p


# more that are left out by default: integrals on fixed grids


def _integral(f, low, high, n=2001):
    """Log of the integral of exp(f) over [low, high], inside out so that ends may be singular."""
    u = (np.arange(n) + 0.5) / n
    w = u * u * u * (10 - 15 * u + 6 * u * u)  # crowds the grid at both ends
    x, dx = low + (high - low) * w, (high - low) * 30 * u * u * (1 - u) ** 2 / n
    g = f(x)
    top = np.max(g)
    return top + log(np.sum(exp(g - top) * dx))


def _log_k(v, x):
    """Log of the modified Bessel function of the second kind of any order, by its integral over cosh."""
    x = np.maximum(np.atleast_1d(np.asarray(x, float)), 1e-8)
    end = np.arccosh(1 + 60 / x) + abs(v) / np.maximum(x, 1) + 1
    u = (np.arange(600) + 0.5) / 600
    t = end[:, None] * u[None, :]
    e = -x[:, None] * (np.cosh(np.minimum(t, 300)) - 1) + np.logaddexp(v * t, -v * t) - log(2)
    top = e.max(axis=1)
    return -x + top + log((exp(e - top[:, None])).sum(axis=1) * end / 600)


_gig = lambda x, p, b: (p - 1) * lx(x) - b * (x + 1 / np.maximum(x, 1e-300)) / 2 - log(2) - _log_k(p, b)[0]
law("geninvgauss", "p b", P, _gig, lambda x, p, b: trapezoid_grid(lambda g: _gig(g, p, b), 0.0, INF, x, 20001), [(1.0, 1.0)], valid=lambda p, b: 1e-3 < b < 500 and abs(p) < 100)
_ghy = lambda x, a, b, c, z: (a - 1) * lx(x) + (b - 1) * lx(1 - x) - c * log1p(z * x) - _integral(lambda t: (a - 1) * lx(t) + (b - 1) * lx(1 - t) - c * log1p(z * t), 0.0, 1.0)
law("gausshyper", "a b c z", U, _ghy, lambda x, a, b, c, z: trapezoid_grid(lambda g: _ghy(g, a, b, c, z), 0.0, 1.0, x, 20001), [(2.0, 2.0, 1.0, 1.0)], valid=lambda a, b, c, z: a > 0 and b > 0 and z > -1)


def _hyperbolic(x, p, a, b):
    g = sqrt(a * a - b * b)
    r = sqrt(1 + np.asarray(x, float) ** 2)
    k = _log_k(p - 0.5, np.ravel(a * r)).reshape(np.shape(r))
    return p * log(g) - LOG2PI / 2 - (p - 0.5) * log(a) - _log_k(p, g)[0] + b * x + k - (0.5 - p) * log(r)


law("genhyperbolic", "p a b", R, _hyperbolic, lambda x, p, a, b: trapezoid_grid(lambda g: _hyperbolic(g, p, a, b), -INF, INF, x), [(0.5, 1.5, 0.0)], valid=lambda p, a, b: a > abs(b) and abs(p) < 50)


def _terms(nc):
    j = np.arange(max(0, int(nc / 2 - 8 * sqrt(nc / 2 + 1)) - 2), int(nc / 2 + 8 * sqrt(nc / 2 + 1)) + 8)
    return [(float(k), float(exp(-nc / 2 + k * log(nc / 2) - gammaln(float(k + 1))))) for k in j]


law(
    "ncf", "dfn dfd nc", P,
    lambda x, n, d, c: lx(sum(w * exp((n / 2 + j) * log(n / d) + (n / 2 + j - 1) * lx(x) - ((n + d) / 2 + j) * log1p(n * x / d) - betaln(n / 2 + j, d / 2)) for j, w in _terms(c))),
    lambda x, n, d, c: sum(w * betainc(n / 2 + j, d / 2, n * x / (n * x + d)) for j, w in _terms(c)),
    [(5.0, 10.0, 1.0)], valid=lambda n, d, c: n > 0 and d > 0 and 0 < c < 400,
)


def _nct(x, d, c, density):
    """Over the distribution of the square root of the chi-square part."""
    width = 8 / sqrt(2 * d)
    s = np.linspace(max(1e-6, 1 - width), 1 + width, 801)
    g = exp(log(2) + d / 2 * log(d / 2) - gammaln(d / 2) + (d - 1) * log(s) - d * s * s / 2)
    g = g / np.sum(g)
    z = np.ravel(x)[:, None] * s[None, :] - c
    out = (exp(_nl(z)) * s if density else ndtr(z)) @ g
    return (lx(out) if density else out).reshape(np.shape(x))


law("nct", "df nc", R, lambda x, d, c: _nct(x, d, c, True), lambda x, d, c: _nct(x, d, c, False), [(8.0, 0.5)], valid=lambda d, c: d > 0 and abs(c) < 50)


def _mills(y):
    """Log of the normal tail over the normal density."""
    return log_ndtr(-y) - _nl(y)


law(
    "dpareto_lognorm", "u s a b", P,
    lambda x, u, s, a, b: log(a * b / (a + b)) - lx(x) + _nl((lx(x) - u) / s) + np.logaddexp(_mills(a * s - (lx(x) - u) / s), _mills(b * s + (lx(x) - u) / s)),
    lambda x, u, s, a, b: ndtr((lx(x) - u) / s) - exp(_nl((lx(x) - u) / s) + _mills(a * s - (lx(x) - u) / s)) * b / (a + b) + exp(_nl((lx(x) - u) / s) + _mills(b * s + (lx(x) - u) / s)) * a / (a + b),
    [(0.0, 1.0, 3.0, 3.0)], valid=lambda u, s, a, b: s > 0 and a > 0 and b > 0,
)

#: Families whose fit takes over five times the median here (2000 gamma values): ridges in the likelihood that a simplex follows for long
#: (t, powerlognorm, powernorm, beta, genlogistic), quadrature or tables in each evaluation (norminvgauss, landau).
SLOW = frozenset("beta genlogistic landau norminvgauss powerlognorm powernorm t".split())
#: Families whose tail falls as a power of x, so that some moments are infinite and single values sway a likelihood.
HEAVY = frozenset("alpha betaprime burr burr12 cauchy f fisk foldcauchy genpareto halfcauchy invgamma invweibull kappa3 levy levy_l loglaplace lomax pareto skewcauchy t".split())
DEFAULT_EXCLUDED = frozenset(
    "levy_stable kappa4 ncx2 ksone ncf wald mielke exponpow studentized_range gausshyper geninvgauss genhyperbolic kstwo kstwobign recipinvgauss vonmises vonmises_line tukeylambda nct dpareto_lognorm".split()
)
#: Right-skewed whatever their shapes: what a markedly left-skewed column cannot be. Families that some shapes skew to the left
#: (weibull_min above 3.6, genextreme, gompertz, gengamma, loggamma and their like) stay candidates.
POSITIVE_SKEW = frozenset(
    "expon halfcauchy halflogistic halfnorm rayleigh lognorm chi2 gamma erlang pareto fisk invweibull invgamma halfgennorm powerlognorm rice burr wald".split()
)
