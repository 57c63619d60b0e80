"""Special functions, laws, registry and the kernel."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from lawfinder.functions import columns, fast_ppf, kernel, registry
from lawfinder.functions import special as sp
from lawfinder.functions.discrete import DISCRETE
from lawfinder.functions.laws import DEFAULT_EXCLUDED, LAWS, Law


def test_erfc_and_normal():
    x = np.linspace(-6, 6, 201)
    assert np.allclose(sp.erfc(x), [math.erfc(v) for v in x], rtol=1e-12)
    q = np.linspace(0.001, 0.999, 999)
    assert np.allclose(sp.ndtr(sp.ndtri(q)), q, atol=1e-13)
    assert sp.ndtri(np.array([0.0, 1.0])).tolist() == [-math.inf, math.inf]
    assert np.allclose(sp.log_ndtr(np.array([-40.0, -5.0, 0.0])), [-804.608442, -15.064998, math.log(0.5)], atol=1e-5)


def test_incomplete_functions(spark):
    """Against the mathematics library that Spark ships."""
    gamma, beta = spark._jvm.org.apache.commons.math3.special.Gamma, spark._jvm.org.apache.commons.math3.special.Beta
    for a in (0.3, 1.0, 2.5, 30.0, 400.0):
        x = np.array([0.01, 0.5, 1.0, a, 2 * a, 3 * a + 10])
        assert np.allclose(sp.gammainc(a, x), [gamma.regularizedGammaP(float(a), float(v)) for v in x], atol=1e-11)
    for a, b in ((0.5, 0.5), (2.0, 3.0), (50.0, 7.0)):
        x = np.array([0.01, 0.3, 0.5, 0.9, 0.999])
        assert np.allclose(sp.betainc(a, b, x), [beta.regularizedBeta(float(v), float(a), float(b)) for v in x], atol=1e-11)
    assert sp.gammaln(np.array([0.5, 5.0])).tolist() == [math.lgamma(0.5), math.lgamma(5.0)]


def test_kolmogorov():
    assert sp.kolmogorov_sf(0.0) == 1 and sp.kolmogorov_sf(5.0) < 1e-20
    assert sp.kolmogorov_sf(1.3580986) == pytest.approx(0.05, abs=1e-5)
    assert sp.kolmogorov_sf(1.1799) == pytest.approx(sp.kolmogorov_sf(1.1801), abs=1e-3)


def test_simplex():
    x, v = sp.nelder_mead(lambda p: (1 - p[0]) ** 2 + 100 * (p[1] - p[0] ** 2) ** 2, np.array([-1.2, 1.0]), np.array([0.5, 0.5]), 1e-12)
    assert np.allclose(x, 1, atol=1e-3) and v < 1e-6


@pytest.mark.parametrize("name", sorted(LAWS))
def test_law_is_consistent(name):
    """Quantiles undo the distribution function, whose slope is the density."""
    law = LAWS[name]
    p = (*law.starts[0], 1.5, 2.0)
    q = np.linspace(0.03, 0.97, 48)
    x = law.ppf(q, *p)
    assert np.allclose(law.cdf(x, *p), q, atol=1e-6)
    assert (np.diff(x) >= 0).all() and (law.pdf(x, *p) >= 0).all()
    h = 1e-5 * np.maximum(1, abs(x))
    slope = (law.cdf(x + h, *p) - law.cdf(x - h, *p)) / (2 * h)
    off = abs(slope - law.pdf(x, *p)) / (law.pdf(x, *p) + 1e-2)
    assert np.quantile(off, 0.9) < (0.06 if name == "landau" else 5e-3)
    a, b = law.bounds(*p)
    assert law.cdf(np.array([a - 1 if math.isfinite(a) else -1e12]), *p)[0] < 1e-3
    assert law.cdf(np.array([b + 1 if math.isfinite(b) else 1e12]), *p)[0] > 1 - 1e-3


def test_catalogue():
    assert len([n for n in LAWS if n not in DEFAULT_EXCLUDED]) == 90 and len(DISCRETE) == 16
    assert "norm" not in registry.continuous_names(support_at_zero=True) and "gamma" in registry.continuous_names(support_at_zero=True)
    assert len(registry.continuous_names(excluded=())) == len(LAWS)
    assert registry.continuous_names(most=3) == registry.continuous_names()[:3]
    mixed = registry.interleaved(registry.continuous_names())
    assert sorted(mixed) == sorted(registry.continuous_names())


def test_registry():
    law = Law("mine", (), lambda: (0.0, math.inf), lambda x: -x, lambda x: -np.expm1(-x), ((),))
    with pytest.raises(ValueError):
        registry.register_distribution("norm", law)
    with pytest.raises(TypeError):
        registry.register_distribution("mine", object())
    registry.register_distribution("mine", law)
    try:
        with pytest.raises(ValueError):
            registry.register_distribution("mine", law)
        registry.register_distribution("mine", law, overwrite=True)
        assert "mine" in registry.continuous_names() and registry.get_law("mine") is law
    finally:
        registry.unregister_distribution("mine")
    with pytest.raises(KeyError):
        registry.unregister_distribution("mine")
    registry.add_exclusion("norm")
    assert "norm" not in registry.continuous_names()
    registry.remove_exclusion("norm")
    registry.reset_exclusions()
    assert registry.get_exclusions() == set(DEFAULT_EXCLUDED)


@pytest.mark.parametrize(
    ("name", "draw", "want", "close"),
    [
        ("norm", lambda r: r.normal(50, 10, 5000), (50, 10), 0.05),
        ("expon", lambda r: r.exponential(5, 5000), (0, 5), 0.05),
        ("uniform", lambda r: r.uniform(10, 90, 5000), (10, 80), 0.05),
        ("laplace", lambda r: r.laplace(3, 2, 5000), (3, 2), 0.08),
        ("logistic", lambda r: r.logistic(3, 2, 5000), (3, 2), 0.08),
        ("gumbel_r", lambda r: r.gumbel(3, 2, 5000), (3, 2), 0.08),
    ],
)
def test_recovery(name, draw, want, close):
    p = kernel.fit_mle(LAWS[name], draw(np.random.default_rng(3)))
    assert np.allclose(p, want, rtol=close, atol=0.2)


@pytest.mark.parametrize(("name", "draw"), [("norm", lambda r: r.normal(50, 10, 3000)), ("gamma", lambda r: r.gamma(3, 2, 3000)), ("lognorm", lambda r: r.lognormal(1, 0.5, 3000)), ("weibull_min", lambda r: 5 * r.weibull(1.5, 3000)), ("expon", lambda r: r.exponential(5, 3000))])
def test_true_family_is_near_the_top(name, draw):
    x = draw(np.random.default_rng(4))
    density, edges = np.histogram(x, 30, density=True)
    aic = {n: kernel.score(LAWS[n], kernel.fit_mle(LAWS[n], x), x, density, edges, False, None, None)["aic"] for n in ("norm", "expon", "gamma", "uniform", "lognorm", "weibull_min", "cauchy", "laplace")}
    assert aic[name] <= min(aic.values()) + 4


def test_spacings_and_censoring():
    r = np.random.default_rng(5)
    assert np.allclose(kernel.fit_mse(LAWS["norm"], r.normal(5, 2, 2000)), (5, 2), rtol=0.08)
    t, c = 10 * r.weibull(2, 3000), r.uniform(5, 20, 3000)
    p = kernel.fit_censored(LAWS["weibull_min"], np.minimum(t, c), t <= c)
    assert p[0] == pytest.approx(2, rel=0.15) and p[1] + p[2] == pytest.approx(10, rel=0.15)
    with pytest.raises(ValueError):
        kernel.fit_censored(LAWS["norm"], t, np.zeros(len(t), bool))


def test_scores():
    x = np.sort(np.random.default_rng(6).normal(0, 1, 500))
    f = LAWS["norm"].cdf(x, 0.0, 1.0)
    d, p = kernel.ks_statistic(x, f)
    assert 0 < d < 0.08 and 0.05 < p <= 1
    assert kernel.ks_statistic(x, np.full(500, np.nan)) == (math.inf, 0.0)
    assert kernel.ad_statistic(f) < 3 and kernel.ad_statistic(f[:1]) == math.inf
    assert kernel.ad_pvalue("norm", 0.1, 500) == 0.25 and kernel.ad_pvalue("norm", 9.0, 500) == 0.005
    assert 0.01 < kernel.ad_pvalue("norm", 0.75, 500) < 0.1 and kernel.ad_pvalue("gamma", 0.5, 500) is None
    assert kernel.is_heavy_tailed(np.random.default_rng(1).standard_t(1.5, 2000)) and not kernel.is_heavy_tailed(x)
    assert not kernel.is_heavy_tailed(np.array([1.0, np.nan, 1e9]))


@settings(max_examples=30, deadline=None)
@given(st.sampled_from(["norm", "expon", "gamma", "laplace", "weibull_min"]), st.floats(-3, 3), st.floats(0.2, 4), st.floats(-1, 1), st.floats(0.3, 5))
def test_truncation(name, loc, scale, low, width):
    law = LAWS[name]
    t = kernel.Truncated(law, (*law.starts[0], loc, scale), low, low + width)
    if t.mass < 1e-6:
        return
    x = t.ppf(np.linspace(0, 1, 21))
    assert (x >= low - 1e-9).all() and (x <= low + width + 1e-9).all()
    assert np.allclose(t.cdf(x[1:-1]), np.linspace(0, 1, 21)[1:-1], atol=1e-5)
    assert t.pdf(np.array([low - 0.1, low + width + 0.1])).tolist() == [0, 0]
    m, sd = t.moments()
    assert low <= m <= low + width and 0 <= sd <= width


def test_truncation_errors():
    with pytest.raises(ValueError):
        kernel.Truncated(LAWS["norm"], (0.0, 1.0), 2.0, 1.0)
    none = kernel.Truncated(LAWS["uniform"], (0.0, 1.0), 5.0, 6.0)
    assert none.pdf(np.array([5.5])).tolist() == [0]
    with pytest.raises(ValueError):
        none.ppf(np.array([0.5]))


@pytest.mark.parametrize("name", sorted(DISCRETE))
def test_discrete_law_sums_to_one(name):
    law = DISCRETE[name]
    p = {"poisson": (4.0,), "geom": (0.3,), "binom": (9.0, 0.4), "nbinom": (5.0, 0.4), "zipf": (3.0,), "zipfian": (1.2, 9.0), "hypergeom": (30.0, 12.0, 9.0), "betabinom": (9.0, 2.0, 3.0), "betanbinom": (4.0, 6.0, 2.0), "boltzmann": (0.5, 9.0), "dlaplace": (0.8,), "logser": (0.6,), "planck": (0.5,), "skellam": (3.0, 2.0), "yulesimon": (4.0,), "nhypergeom": (30.0, 12.0, 3.0)}[name]
    k = np.arange(-60, 3000)
    pmf = law.pmf(k, *p)
    assert pmf.sum() == pytest.approx(1, abs=2e-3) and (pmf >= 0).all()
    assert np.allclose(law.cdf(k[:200], *p), np.cumsum(pmf)[:200], atol=1e-6)
    assert abs(float(law.rvs(4000, *p, seed=1).mean()) - float((k * pmf).sum())) < 0.5


@pytest.mark.parametrize(("name", "draw", "want"), [("poisson", lambda r: r.poisson(7, 5000), (7,)), ("nbinom", lambda r: r.negative_binomial(5, 0.4, 5000), (5, 0.4)), ("geom", lambda r: r.geometric(0.3, 5000), (0.3,)), ("binom", lambda r: r.binomial(12, 0.4, 5000), (12, 0.4))])
def test_discrete_recovery(name, draw, want):
    v, c = np.unique(draw(np.random.default_rng(7)), return_counts=True)
    p = kernel.fit_discrete(DISCRETE[name], v.astype(float), c.astype(float))
    assert np.allclose(p, want, rtol=0.15)
    s = kernel.score_discrete(DISCRETE[name], p, v.astype(float), c.astype(float), True)
    assert s["ks_statistic"] < 0.03 and s["pvalue"] > 0.01
    legacy = kernel.score_discrete(DISCRETE[name], p, v.astype(float), c.astype(float), True, every_row=True)
    assert legacy["ks_statistic"] >= s["ks_statistic"]


def test_fast_quantiles():
    q = np.linspace(0.01, 0.99, 50)
    for name in fast_ppf.FAST:
        p = (*LAWS[name].starts[0], 1.0, 2.0)
        assert fast_ppf.has_fast_ppf(name) and np.allclose(LAWS[name].cdf(fast_ppf.fast_ppf(name, p, q), *p), q, atol=1e-6)
    cut = fast_ppf.fast_ppf("norm", (0.0, 1.0), q, -1.0, 1.0)
    assert cut.min() >= -1 and cut.max() <= 1
    assert fast_ppf.fast_ppf_batch([("norm", (0, 1)), ("expon", (0, 2))], np.column_stack([q, q])).shape == (50, 2)
    fast_ppf.clear_ppf_cache()
    assert not fast_ppf.has_fast_ppf("gamma")


def test_exact_kolmogorov():
    """The published example, all small n by simulation-free identities, and the limit law from 140 values on."""
    assert 1 - sp.kolmogorov_exact(10, 0.274) == pytest.approx(0.6284796154565, abs=1e-12)
    for d in (0.5, 0.6, 0.9):
        assert sp.kolmogorov_exact(1, d) == pytest.approx(2 * (1 - d))
    assert sp.kolmogorov_exact(3, 1.0) == 0.0 and sp.kolmogorov_exact(140, 0.01) == pytest.approx(1)
    n = 140
    for d in (0.05, 0.08, 0.12):
        assert sp.kolmogorov_exact(n, d) == pytest.approx(sp.kolmogorov_sf(kernel.corrected(n, d)), abs=2e-4)


def test_normal_columns(spark):
    x = [i / 20 for i in range(-180, 181)]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", columns.phi(F.col("x")).alias("p"))
    for r in df.collect():
        assert r.p == pytest.approx(math.erfc(-r.x / math.sqrt(2)) / 2, rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("name", ["norm", "expon", "uniform", "laplace", "halfnorm", "gamma", "weibull_min"])
def test_fit_of_counted_values_is_that_of_repeated_ones(name):
    x, counts = np.unique(np.random.default_rng(5).gamma(2.0, 3.0, 4000).round(1), return_counts=True)
    want = kernel.fit_mle(LAWS[name], np.repeat(x, counts))
    assert kernel.fit_mle(LAWS[name], x, counts) == pytest.approx(want, rel=1e-4, abs=1e-9)
    # more rows than fit in memory
    assert np.isfinite(kernel.fit_mle(LAWS[name], x, counts * 10**9)).all()
    few, most = x[:40], np.minimum(counts[:40], 3)
    assert kernel.fit_mle(LAWS[name], few, most) == pytest.approx(kernel.fit_mle(LAWS[name], np.repeat(few, most)), rel=1e-6, abs=1e-9)
