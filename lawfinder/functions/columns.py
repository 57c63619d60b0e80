"""Families whose estimates and functions are plain Column expressions, so whole fits stay in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

def over(a: str, b: str) -> str:
    """a / b in SQL as IEEE arithmetic has it, by zero too."""
    return f"if({b} = 0, ({a}) * double('infinity'), ({a}) / ({b}))"


def quotient(a: Column, b: Column) -> Column:
    """a / b as IEEE arithmetic has it, by zero too."""
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / b)


def log(x: Column) -> Column:
    """The logarithm, of zero -infinity and of negative numbers NaN."""
    return F.when(x > 0, F.ln(x)).when(x == 0, float("-inf")).otherwise(float("nan"))


_SPREAD = "(mean_log - log_min)"
_EXCESS = f"(mean_inverse - {over('1D', 'data_mean')})"

#: name: (parameter names, estimates over column_stats). Those of lognorm, pareto and invgauss are not finite where values are zero or less.
CLOSED = {
    "norm": (("loc", "scale"), ("data_mean", "data_stddev")),
    "expon": (("loc", "scale"), ("data_min", "data_mean - data_min")),
    "uniform": (("loc", "scale"), ("data_min", "data_max - data_min")),
    "laplace": (("loc", "scale"), ("q50", "mean_deviation")),
    "halfnorm": (("loc", "scale"), ("data_min", "sqrt(mean_square - 2 * data_min * data_mean + data_min * data_min)")),
    "rayleigh": (("loc", "scale"), ("0D", "sqrt(mean_square / 2)")),
    "maxwell": (("loc", "scale"), ("0D", "sqrt(mean_square / 3)")),
    "lognorm": (("s", "loc", "scale"), ("sd_log", "0D", "exp(mean_log)")),
    "pareto": (("b", "loc", "scale"), (over("1D", _SPREAD), "0D", "data_min")),
    "invgauss": (("mu", "loc", "scale"), (f"data_mean * {_EXCESS}", "0D", over("1D", _EXCESS))),
}

#: Where densities vanish at the end of their support, what lies there or beyond counts as so many scales from it.
LEAST = 1e-300


def _logs(scale: str) -> str:
    """The sum of ln(value / scale), of values at zero or less ln(LEAST)."""
    return f"(positive_log - n_positive * ln({scale}) + (n - n_positive) * {math.log(LEAST)!r}D)"


#: The log-likelihood at those estimates, over the same sums: no second pass.
LOGLIK = {
    "norm": "-n / 2 * (ln(2 * pi() * data_stddev * data_stddev) + 1)",
    "expon": "-n * (ln(data_mean - data_min) + 1)",
    "uniform": "-n * ln(data_max - data_min)",
    "laplace": "-n * (ln(2 * mean_deviation) + 1)",
    "halfnorm": "n * ln(2D) - n / 2 * (ln(2 * pi() * (mean_square - 2 * data_min * data_mean + data_min * data_min)) + 1)",
    "rayleigh": f"{_logs('sqrt(mean_square / 2)')} - positive_square / mean_square - n * ln(mean_square / 2) / 2",
    "maxwell": f"n * (ln(2D) - ln(2 * pi()) / 2) + 2 * {_logs('sqrt(mean_square / 3)')} - 1.5D * positive_square / mean_square - n * ln(mean_square / 3) / 2",
    "lognorm": "-n / 2 * (ln(2 * pi() * sd_log * sd_log) + 1) - n * mean_log",
    "pareto": f"-n * ln({_SPREAD}) + n * {over('log_min', _SPREAD)} - ({over('1D', _SPREAD)} + 1) * n * mean_log",
    "invgauss": "if(data_min < 0, double('NaN'), -n / 2 * ln(2 * pi()) - 1.5D * n * (mean_log + ln(mean_inverse - 1 / data_mean)) + n * ln(mean_inverse - 1 / data_mean)"
    " - n * (1 / (2 * data_mean * (mean_inverse - 1 / data_mean)) - 1 / (data_mean * (mean_inverse - 1 / data_mean)) + mean_inverse / (2 * (mean_inverse - 1 / data_mean))))",
}


#: Hart's rational approximation of the normal tail (double precision), numerator and denominator from the highest power.
HART_UP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_DOWN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: Beyond this many deviations the tail comes from a continued fraction.
HART_END = 7.07106781186547


def polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_tail(a: Column, e: Column) -> Column:
    """Mass of the standard normal law beyond ``a`` >= 0; ``e`` is exp(-a * a / 2)."""
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    return F.when(a < HART_END, e * polynomial(HART_UP, a) / polynomial(HART_DOWN, a)).otherwise(far)


def phi(z: Column) -> Column:
    """Standard normal distribution function."""
    tail = normal_tail(F.abs(z), F.exp(-z * z / 2))
    return F.when(z > 0, 1 - tail).otherwise(tail)


def cdf(name: str, x: Column, p: list[Column]) -> Column:
    *s, loc, scale = p
    z = (x - loc) / scale
    body = {
        "norm": lambda: phi(z),
        "expon": lambda: F.when(z <= 0, 0.0).otherwise(1 - F.exp(-z)),
        "uniform": lambda: F.least(F.lit(1.0), F.greatest(F.lit(0.0), z)),
        "laplace": lambda: F.when(z < 0, F.exp(z) / 2).otherwise(1 - F.exp(-z) / 2),
        "halfnorm": lambda: F.when(z <= 0, 0.0).otherwise(2 * phi(z) - 1),
        "rayleigh": lambda: F.when(z <= 0, 0.0).otherwise(1 - F.exp(-z * z / 2)),
        "maxwell": lambda: F.when(z <= 0, 0.0).otherwise(2 * phi(z) - 1 - math.sqrt(2 / math.pi) * z * F.exp(-z * z / 2)),
        "lognorm": lambda: F.when(z <= 0, 0.0).otherwise(phi(F.ln(z) / s[0])),
        "pareto": lambda: F.when(z <= 1, 0.0).otherwise(1 - F.pow(z, -s[0])),
        "weibull_min": lambda: F.when(z <= 0, 0.0).otherwise(1 - F.exp(-F.pow(z, s[0]))),
        "logistic": lambda: 1 / (1 + F.exp(-z)),
        "gumbel_r": lambda: F.exp(-F.exp(-z)),
        "invgauss": lambda: F.when(z <= 0, 0.0).otherwise(phi((z / s[0] - 1) / F.sqrt(z)) + F.exp(2 / s[0]) * phi(-(z / s[0] + 1) / F.sqrt(z))),
    }
    return body[name]()


def logpdf(name: str, x: Column, p: list[Column]) -> Column:
    *s, loc, scale = p
    z = (x - loc) / scale
    half_log_2pi = 0.5 * math.log(2 * math.pi)
    low = F.lit(float("-inf"))
    inside = lambda ok, v: F.when(ok, v).otherwise(low)
    body = {
        "norm": lambda: -z * z / 2 - half_log_2pi,
        "expon": lambda: inside(z >= 0, -z),
        "uniform": lambda: inside((z >= 0) & (z <= 1), F.lit(0.0)),
        "laplace": lambda: -F.abs(z) - math.log(2),
        "halfnorm": lambda: inside(z >= 0, math.log(2) - z * z / 2 - half_log_2pi),
        "rayleigh": lambda: inside(z > 0, F.ln(z) - z * z / 2),
        "maxwell": lambda: inside(z > 0, math.log(2) - half_log_2pi + 2 * F.ln(z) - z * z / 2),
        "lognorm": lambda: inside(z > 0, -F.pow(F.ln(z) / s[0], F.lit(2)) / 2 - half_log_2pi - F.ln(s[0]) - F.ln(z)),
        "pareto": lambda: inside(z >= 1, F.ln(s[0]) - (s[0] + 1) * F.ln(z)),
        "invgauss": lambda: inside(z > 0, -half_log_2pi - 1.5 * F.ln(z) - F.pow(z - s[0], F.lit(2)) / (2 * z * s[0] * s[0])),
        "weibull_min": lambda: inside(z > 0, F.ln(s[0]) + (s[0] - 1) * F.ln(z) - F.pow(z, s[0])),
        "logistic": lambda: -F.abs(z) - 2 * F.log1p(F.exp(-F.abs(z))),
        "gumbel_r": lambda: -z - F.exp(-z),
    }
    return body[name]() - F.ln(scale)


def pdf(name: str, x: Column, p: list[Column]) -> Column:
    return F.exp(logpdf(name, x, p))


def ppf(name: str, q: Column, p: list[Column]) -> Column:
    *s, loc, scale = p
    body = {
        "expon": lambda: -F.log1p(-q),
        "uniform": lambda: q,
        "laplace": lambda: F.when(q < 0.5, F.ln(2 * q)).otherwise(-F.ln(2 * (1 - q))),
        "rayleigh": lambda: F.sqrt(-2 * F.log1p(-q)),
        "weibull_min": lambda: F.pow(-F.log1p(-q), 1 / s[0]),
        "pareto": lambda: F.pow(1 - q, -1 / s[0]),
        "logistic": lambda: F.ln(q / (1 - q)),
        "gumbel_r": lambda: -F.ln(-F.ln(q)),
        "norm": lambda: normal_quantile(q),
        "halfnorm": lambda: normal_quantile((1 + q) / 2),
        "lognorm": lambda: F.exp(s[0] * normal_quantile(q)),
    }
    return loc + scale * body[name]()


def normal_quantile(q: Column) -> Column:
    """Acklam's rational approximation (1.2e-9)."""
    from lawfinder.functions.special import _A, _B, _C, _D

    t = F.sqrt(-2 * F.ln(F.least(q, 1 - q)))
    tail = polynomial(_C, t) / polynomial(_D, t)
    r = (q - 0.5) * (q - 0.5)
    return F.when(F.abs(q - 0.5) <= 0.47575, (q - 0.5) * polynomial(_A, r) / polynomial(_B, r)).when(q < 0.5, tail).otherwise(-tail)
