"""Special functions and a simplex optimiser in numpy (there is no SciPy here)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

SQRT2, SQRT2PI, LOG2PI = math.sqrt(2), math.sqrt(2 * math.pi), math.log(2 * math.pi)

_ERFC = (
    -1.3026537197817094, 6.4196979235649026e-1, 1.9476473204185836e-2, -9.561514786808631e-3, -9.46595344482036e-4, 3.66839497852761e-4,
    4.2523324806907e-5, -2.0278578112534e-5, -1.624290004647e-6, 1.303655835580e-6, 1.5626441722e-8, -8.5238095915e-8, 6.529054439e-9,
    5.059343495e-9, -9.91364156e-10, -2.27365122e-10, 9.6467911e-11, 2.394038e-12, -6.886027e-12, 8.94487e-13, 3.13092e-13, -1.12708e-13,
    3.81e-16, 7.106e-15, -1.523e-15, -9.4e-17, 1.21e-16, -2.8e-17,
)


def erfc(x: np.ndarray) -> np.ndarray:
    """Complementary error function by its Chebyshev expansion (about 1e-14 relative)."""
    x = np.asarray(x, float)
    z = np.abs(x)
    t = 2 / (2 + z)
    y = 4 * t - 2
    d = dd = np.zeros_like(z)
    for c in _ERFC[:0:-1]:
        d, dd = y * d - dd + c, d
    with np.errstate(over="ignore", under="ignore"):
        tail = t * np.exp(-z * z + 0.5 * (_ERFC[0] + y * d) - dd)
    return np.where(x >= 0, tail, 2 - tail)


def erf(x):
    return 1 - erfc(x)


def ndtr(x):
    """Standard normal distribution function."""
    return 0.5 * erfc(-np.asarray(x, float) / SQRT2)


def log_ndtr(x):
    x = np.asarray(x, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        far = -0.5 * x * x - np.log(np.maximum(-x, 1e-300)) - 0.5 * LOG2PI + np.log1p(-1 / np.maximum(x * x, 1))
        return np.where(x < -20, far, np.log(np.maximum(ndtr(x), 1e-320)))


_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def ndtri(p):
    """Inverse of ndtr: Acklam's rational approximation and one Halley step."""
    p = np.asarray(p, float)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        q = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
        tail = np.polyval(_C, q) / np.polyval(_D, q)
        r = (p - 0.5) ** 2
        x = np.where(np.abs(p - 0.5) <= 0.47575, (p - 0.5) * np.polyval(_A, r) / np.polyval(_B, r), np.where(p < 0.5, tail, -tail))
        e = (ndtr(x) - p) * SQRT2PI * np.exp(x * x / 2)
        x = x - np.where(np.isfinite(e), e / (1 + x * e / 2), 0)
    return np.where(p <= 0, np.where(p == 0, -np.inf, np.nan), np.where(p >= 1, np.where(p == 1, np.inf, np.nan), x))


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def gammaln(x):
    if np.ndim(x) == 0:
        return math.lgamma(x) if x > 0 else math.inf
    x = np.asarray(x, float)
    keys, back = np.unique(x, return_inverse=True)
    good = keys > 0
    out = np.full(len(keys), np.inf)
    out[good] = _lgamma(keys[good]).astype(float)
    return out[back].reshape(x.shape)


def betaln(a, b):
    return gammaln(a) + gammaln(b) - gammaln(a + b)


def gammainc(a: float, x):
    """Regularised lower incomplete gamma function P(a, x), scalar a."""
    x = np.maximum(np.asarray(x, float), 0)
    out = np.zeros_like(x)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
        scale = np.exp(a * np.log(np.maximum(x, 1e-300)) - x - math.lgamma(a))
        low = (x < a + 1) & (x > 0)
        if low.any():
            out[low] = _gamma_series(a, x[low]) * scale[low]
        high = x >= a + 1
        if high.any():
            out[high] = 1 - scale[high] * _gamma_fraction(a, np.minimum(x[high], 1e8))
    return np.clip(np.where(np.isinf(x), 1.0, out), 0, 1)


#: Steps of a series or fraction after which the elements that have converged leave it.
CHECK = 4


def _gamma_series(a, z):
    out, at = np.empty_like(z), np.arange(z.size)
    term, k = np.full(z.size, 1 / a), a
    total = term.copy()
    for i in range(int(200 + 10 * math.sqrt(a))):
        k += 1
        term = term * z / k
        total += term
        if i % CHECK == 0 and (done := term < total * 1e-16).any():
            out[at[done]] = total[done]
            at, z, term, total = (v[~done] for v in (at, z, term, total))
            if not at.size:
                return out
    out[at] = total
    return out


def _gamma_fraction(a, z):
    out, at = np.empty_like(z), np.arange(z.size)
    b = z + 1 - a
    c, d = np.full_like(z, 1e300), 1 / b
    h = d.copy()
    for i in range(1, int(200 + 10 * math.sqrt(a))):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if i % CHECK == 0 and (done := np.abs(d * c - 1) < 1e-15).any():
            out[at[done]] = h[done]
            at, b, c, d, h = (v[~done] for v in (at, b, c, d, h))
            if not at.size:
                return out
    out[at] = h
    return out


def betainc(a: float, b: float, x):
    """Regularised incomplete beta function I_x(a, b), scalar a and b."""
    x = np.clip(np.asarray(x, float), 0, 1)
    out = np.full_like(x, np.nan)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
        front = np.exp(a * np.log(np.maximum(x, 1e-300)) + b * np.log(np.maximum(1 - x, 1e-300)) - betaln(a, b))
        swap = x > (a + 1) / (a + b + 2)
        high, low = swap & (x < 1), ~swap & (x > 0)
        out[high] = 1 - front[high] * _beta_fraction(b, a, 1 - x[high]) / b
        out[low] = front[low] * _beta_fraction(a, b, x[low]) / a
    return np.clip(np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out)), 0, 1)


def _beta_fraction(a, b, x):
    tiny = 1e-300
    out, at = np.empty_like(x), np.arange(x.size)
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, int(300 + 5 * math.sqrt(max(a, b)))):
        for an in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + an * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if m % CHECK == 0 and (done := np.abs(d * c - 1) < 1e-14).any():
            out[at[done]] = h[done]
            at, x, c, d, h = (v[~done] for v in (at, x, c, d, h))
            if not at.size:
                return out
    out[at] = h
    return out


def kolmogorov_sf(y: float) -> float:
    """P(K > y) of the Kolmogorov distribution."""
    if y <= 0:
        return 1.0
    if y < 1.18:
        t = math.exp(-(math.pi**2) / (8 * y * y))
        return max(0.0, 1 - SQRT2PI / y * sum(t ** ((2 * k - 1) ** 2) for k in range(1, 6)))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * y * y) for k in range(1, 8))))


def kolmogorov_exact(n: int, d: float) -> float:
    """P(D >= d) for the K-S statistic of ``n`` values, by the matrix power of Marsaglia, Tsang and Wang (2003)."""
    if n * d * d > 18 or d >= 1:
        return 0.0
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    i = np.arange(m)
    gap = i[:, None] - i[None, :] + 1
    a = (gap >= 0).astype(float)
    a[:, 0] -= h ** (i + 1)
    a[m - 1, :] -= h ** (m - i)
    a[m - 1, 0] += max(2 * h - 1, 0.0) ** m
    a /= np.array([math.factorial(g) if g > 0 else 1 for g in range(m + 1)], float)[np.maximum(gap, 0)]
    out, shift, base, base_shift = np.eye(m), 0, a, 0
    left = n
    while left:
        if left & 1:
            out, shift = out @ base, shift + base_shift
        base, base_shift, left = base @ base, 2 * base_shift, left >> 1
        top = base[k - 1, k - 1]
        if top > 1e140:
            base, base_shift = base * 1e-140, base_shift + 140
        if out[k - 1, k - 1] > 1e140:
            out, shift = out * 1e-140, shift + 140
    if out[k - 1, k - 1] <= 0:
        return 1.0
    log = math.log(out[k - 1, k - 1]) + shift * math.log(10) + math.lgamma(n + 1) - n * math.log(n)
    return min(1.0, max(0.0, 1 - math.exp(min(log, 0.0))))


def bessel_i0e(x):
    """Exponentially scaled modified Bessel function of order 0 (1.6e-7)."""
    return _bessel(x, (1.0, 3.5156229, 3.0899424, 1.2067492, 0.2659732, 0.0360768, 0.0045813), (0.39894228, 0.01328592, 0.00225319, -0.00157565, 0.00916281, -0.02057706, 0.02635537, -0.01647633, 0.00392377))


def bessel_k1e(x):
    """Exponentially scaled modified Bessel function of the second kind of order 1 (2e-7)."""
    x = np.asarray(x, float)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        y = np.minimum(x, 2) ** 2 / 4
        t2 = (np.minimum(x, 3.75) / 3.75) ** 2
        i1 = np.minimum(x, 2) * np.polyval((0.00032411, 0.00301532, 0.02658733, 0.15084934, 0.51498869, 0.87890594, 0.5), t2)
        low = (np.log(np.minimum(x, 2) / 2) * i1 + np.polyval((-0.00004686, -0.00110404, -0.01919402, -0.18156897, -0.67278579, 0.15443144, 1.0), y) / np.minimum(x, 2)) * np.exp(np.minimum(x, 2))
        high = np.polyval((-0.00068245, 0.00325614, -0.00780353, 0.01504268, -0.03655620, 0.23498619, 1.25331414), 2 / np.maximum(x, 2)) / np.sqrt(np.maximum(x, 2))
    return np.where(x <= 2, low, high)


def _bessel(x, small, large):
    x = np.abs(np.asarray(x, float))
    low = np.polyval(small[::-1], (np.minimum(x, 3.75) / 3.75) ** 2) * np.exp(-np.minimum(x, 3.75))
    high = np.polyval(large[::-1], 3.75 / np.maximum(x, 3.75)) / np.sqrt(np.maximum(x, 3.75))
    return np.where(x < 3.75, low, high)


def invert(cdf: Callable, q, low: float, high: float):
    """Quantiles by bracketing and bisection, vectorised."""
    q = np.asarray(q, float)
    lo = np.full(q.shape, low if np.isfinite(low) else -1.0)
    hi = np.full(q.shape, high if np.isfinite(high) else 1.0)
    with np.errstate(all="ignore"):
        if not np.isfinite(low):
            if np.isfinite(high):
                lo = hi - 1.0
            for _ in range(200):
                far = cdf(lo) > q
                if not far.any():
                    break
                lo = np.where(far, lo * 2 if not np.isfinite(high) else high - (high - lo) * 2, lo)
        if not np.isfinite(high):
            hi = np.maximum(hi, lo + 1) if np.isfinite(low) else hi
            for _ in range(200):
                far = cdf(hi) < q
                if not far.any():
                    break
                hi = np.where(far, lo + (hi - lo) * 2 if np.isfinite(low) else hi * 2, hi)
        for _ in range(100):
            mid = (lo + hi) / 2
            up = cdf(mid) < q
            lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    out = (lo + hi) / 2
    return np.where(q <= 0, np.where(q == 0, low, np.nan), np.where(q >= 1, np.where(q == 1, high, np.nan), out))


def nelder_mead(f: Callable, start: np.ndarray, steps: np.ndarray, tolerance: float = 1e-8, most: int = 2000) -> tuple[np.ndarray, float]:
    """Minimum of ``f`` by the downhill simplex."""
    n = len(start)
    points = np.vstack([start, start + np.diag(steps)])
    values = np.array([f(p) for p in points])
    for _ in range(most):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] <= tolerance * (abs(values[0]) + tolerance) and np.abs(points[1:] - points[0]).max() <= tolerance**0.5 * (1 + np.abs(points[0]).max()):
            break
        centre = points[:-1].mean(axis=0)
        tried = centre + (centre - points[-1])
        value = f(tried)
        if value < values[0]:
            further = centre + 2 * (centre - points[-1])
            at = f(further)
            points[-1], values[-1] = (further, at) if at < value else (tried, value)
        elif value < values[-2]:
            points[-1], values[-1] = tried, value
        else:
            inside = centre + 0.5 * ((tried if value < values[-1] else points[-1]) - centre)
            at = f(inside)
            if at < min(value, values[-1]):
                points[-1], values[-1] = inside, at
            else:
                points[1:] = points[0] + 0.5 * (points[1:] - points[0])
                values[1:] = [f(p) for p in points[1:]]
    best = int(values.argmin())
    return points[best], float(values[best])
