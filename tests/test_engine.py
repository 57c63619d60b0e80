"""Fitters, results, samples, several columns, files, streams and the queries, on Spark."""

import math
import warnings

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lawfinder import DiscreteDistributionFitter, DistributionFitter, FitResult, FitterConfig, FitterConfigBuilder, GaussianCopula, GaussianMixture, MultivariateNormal, SerializationError, load, sample_distributed, save
from lawfinder.functions import registry
from lawfinder.functions.laws import Law
from lawfinder.operators import closed, diagnostics, fitting, sampling, stats
from lawfinder.operators.results import FitResults
from lawfinder.plans import catalogue
from lawfinder.sources import models, tables
from lawfinder.streaming.drift import DriftMonitor, windowed_moments

SOME = ["norm", "expon", "uniform", "gamma", "laplace"]


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(42)
    rows = zip(r.normal(50, 10, 3000).tolist(), r.exponential(5, 3000).tolist(), r.poisson(7, 3000).tolist(), r.binomial(12, 0.4, 3000).tolist(), ["x"] * 3000, strict=True)
    df = spark.createDataFrame(list(rows), "value double, wait double, counts long, hits long, name string").cache()
    df.count()
    return df


@pytest.fixture(scope="module")
def results(spark, data):
    return DistributionFitter(spark).fit(data, columns=["value", "wait"], distributions=SOME)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_is_its_sql(spark, name):
    """Each query against its SQL on the smallest tables."""
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, d)
    want = con.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    plain = lambda v: round(v, 4) if isinstance(v, float) else v
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    a, b = key(got.select(*columns).collect()), key(want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or (isinstance(u, float) and u == pytest.approx(float(v), abs=2e-3, rel=1e-6)) for u, v in zip(x, y, strict=True)), (x, y)


#: Queries that hold on values of zero, for which half of the positive families have no finite estimates.
ON_ZEROS = ["closed_form_fits", "likelihoods", "likelihoods_of_rows", "sse_scores", "ks_ad_distances", "ranked_fits", "top_fits", "filtered_fits", "fit_summary", "quality_report", "saved_and_loaded"]


@pytest.fixture(scope="module")
def zeros_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("zeros")
    duckdb.sql(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 100 = 0 THEN 0 ELSE value END AS value) FROM '/root/testdata/sf0.001/events.parquet') TO '{d}/events.parquet'")
    return str(d)


@pytest.mark.parametrize("name", ON_ZEROS)
def test_query_is_its_sql_on_zeros(spark, zeros_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{zeros_dir}/events.parquet'")
    want = con.execute(catalogue.SQL[name])
    columns = [c[0] for c in want.description]
    plain = lambda v: "NaN" if isinstance(v, float) and math.isnan(v) else round(v, 4) if isinstance(v, float) else v
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    a, b = key(catalogue.QUERIES[name](spark, zeros_dir).select(*columns).collect()), key(want.fetchall())
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or (isinstance(u, float) and u == pytest.approx(v, abs=2e-3, rel=1e-6)) for u, v in zip(x, y, strict=True)), (x, y)


def test_entry(spark):
    assert __spark_entry__.entry(spark).first()["distribution"]
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_fit(results, data):
    best = results.best_per_column(1, "aic")
    assert best["value"][0].distribution in ("norm", "gamma") and best["wait"][0].distribution in ("expon", "gamma")
    assert results.column_names == ["value", "wait"] and len(results) == 10
    norm = results.for_column("value").filter(sse_threshold=1.0).df.where("distribution = 'norm'").first()
    assert np.allclose(norm.parameters, (50, 10), rtol=0.03) and norm.data_count == 3000
    assert results.best(3, "bic")[0].bic <= results.best(3, "bic")[2].bic
    with pytest.raises(ValueError):
        results.best(0)
    with pytest.raises(ValueError):
        results.best(1, "nothing")
    assert results.filter(ks_threshold=0.05, pvalue_threshold=0.0).count() < 10
    report = results.quality_report()
    assert report["summary"]["total_distributions"] == 10 and report["n_acceptable"] >= 1
    with pytest.warns(UserWarning):
        results._like(results.df.where("distribution = 'uniform' AND column_name = 'wait'")).best(1, warn_if_poor=True)


def test_all_families(spark, data):
    r = DistributionFitter(spark).fit(data, column="value")
    assert r.count() > 85
    top = {x.distribution for x in r.best(40, "aic")}
    assert {"norm", "t", "gennorm"} <= top and "expon" not in top
    assert fitting.RESULT_SCHEMA.names == r.df.columns


def test_lazy(spark, data):
    r = DistributionFitter(spark).fit(data, column="value", distributions=SOME, lazy_metrics=True)
    assert r.is_lazy and r.df.where("ks_statistic IS NOT NULL").count() == 0
    assert r.best(1)[0].distribution in ("norm", "gamma") and r.shortlist(1)[0].distribution in ("norm", "gamma")
    assert r.materialize().df.where("ks_statistic IS NULL").count() == 0 and r.filter(ks_threshold=0.1).count() >= 1


def test_bounds_and_settings(spark, data):
    r = DistributionFitter(spark).fit(data, columns=["value", "wait"], config=FitterConfigBuilder().with_bounds({"value": 20.0}, {"value": 80.0}).with_bins(30, False).build(), distributions=["norm"])
    b = r.best_per_column()["value"][0]
    assert (b.lower_bound, b.upper_bound) == (20, 80) and b.pdf([10.0]).tolist() == [0] and b.cdf([80.0]).tolist() == [1]
    x = b.sample_values(500, 1)
    assert x.min() >= 20 and x.max() <= 80
    built = FitterConfigBuilder().with_sampling(True, 0.5).with_adaptive_sampling(False).with_lazy_metrics().with_prefilter("aggressive").with_support_at_zero().with_max_distributions(3).with_partitions(2).with_estimation_method("auto").with_censoring("e").build()
    assert built.prefilter == "aggressive" and built.with_(bins=9).bins == 9
    for bad in ({"bins": 0}, {"sample_fraction": 2.0}, {"estimation_method": "x"}, {"prefilter": 3}, {"lower_bound": 2, "upper_bound": 1}, {"bins": (1.0, 1.0)}, {"max_distributions": 0}):
        with pytest.raises(ValueError):
            FitterConfig(**bad)
    fit = DistributionFitter(spark).fit
    with pytest.raises(ValueError):
        fit(data)
    with pytest.raises(ValueError):
        fit(data, column="nope")
    with pytest.raises(TypeError):
        fit(data, column="name")
    with pytest.raises(ValueError):
        fit(data.limit(0), column="value")
    with pytest.raises(ValueError):
        fit(data, column="value", bounded=True, lower_bound={"x": 1.0})


def test_odd_columns(spark):
    nan = spark.createDataFrame([(float("nan"),), (None,), (float("inf"),)], "value double")
    assert DistributionFitter(spark).fit(nan, column="value").count() == 0
    mixed = spark.createDataFrame([(float("nan"),), (None,)] + [(float(v),) for v in np.random.default_rng(1).normal(0, 1, 500)], "value double")
    assert DistributionFitter(spark).fit(mixed, column="value", distributions=["norm"]).best()[0].data["data_count"] == 500
    constant = spark.createDataFrame([(42.0,)] * 50, "value double")
    assert DistributionFitter(spark).fit(constant, column="value", distributions=["norm", "uniform"]).count() <= 2
    assert closed.full_fit(stats.long_frame(constant, ["value"])).count() == 0
    assert stats.histogram(stats.long_frame(constant, ["value"])).first()["density"] == 1.0


def test_prefilter_and_sampling(spark, data):
    assert "expon" not in fitting.prefiltered(["norm", "expon"], -2.0, 0.0, True)
    assert fitting.prefiltered(["expon"], -2.0, 0.0, True) == ["expon"]
    assert "uniform" not in fitting.prefiltered(["norm", "uniform"], 0.0, 11.0, "aggressive")
    assert fitting.strategy(0.1) == ("uniform", 0) and fitting.strategy(1.0) == ("stratified", 5) and fitting.strategy(-9.0) == ("stratified", 10)
    few = fitting.sampled(data, ["wait"], 3000, 600, 1).count()
    assert 450 < few < 750
    some = fitting.stratified(data, "wait", 3000, 600, 5, 1)
    assert 600 < some.count() < 2000 and some.columns == data.columns
    r = DistributionFitter(spark).fit(data, column="wait", sample_threshold=1000, distributions=["expon"])
    assert r.best()[0].parameters[1] == pytest.approx(5, rel=0.2)


def test_samples_of_any_table():
    """A share that no whole number of small buckets could say: 10,000 of 10 ** 11 and of 10 ** 15 rows."""
    for n in (10**7, 10**11, 10**15):
        assert fitting.below(10_000 / n) / 2**63 * n == pytest.approx(10_000, rel=1e-6)
    assert fitting.below(1.0) == 2**63 - 1
    assert fitting.stratum_shares({0: 1000, 1: 10**9, 2: 600}, 1e-6, 500) == {0: 0.5, 1: 1e-6, 2: 500 / 600}


def test_heavy_tails_by_the_histogram():
    r = np.random.default_rng(3)
    for x, want in ((r.normal(50, 10, 5000), False), (r.exponential(5, 5000), False), (r.pareto(1.2, 5000), True), (np.append(r.uniform(0, 1, 5000), 4.0), True), (np.append(r.uniform(0, 1, 5000), 2.5), False)):
        density, edges = np.histogram(x, 60, density=True)
        z = (x - x.mean()) / x.std()
        stats_ = {"n": len(x), "data_stddev": x.std(), "data_kurtosis": 0.0 if len(x) % 2 else (z**4).mean() - 3, "data_max": x.max()}
        assert fitting.heavy_tailed(stats_, edges, density) == want


def test_sampled_sizes(spark):
    rows = spark.range(200_000).select((F.col("id") % 3).cast("double").alias("x"), "id")
    got = fitting.sampled(rows, ["x"], 200_000, 3000, 5, ["id"])
    assert got.count() == 3000 and got.columns == ["x", "id"]
    assert sorted(got.collect()) == sorted(fitting.sampled(rows, ["x"], 200_000, 3000, 5, ["id"]).collect())
    assert got.groupBy("x").count().agg(F.min("count")).first()[0] > 800  # equal values do not share a fate
    assert fitting.thinned(rows, ["x"], 200_000, 3000, 5).count() == pytest.approx(3000, rel=0.1)


def test_scores_above_the_threshold(spark):
    """SSE, counts and moments are those of all rows however small the sample."""
    rows = spark.range(40_000).select((F.randn(7) * 3 + 10).alias("value"))
    found = DistributionFitter(spark).fit(rows, column="value", distributions=["norm", "expon", "uniform"], sample_threshold=10_000, max_sample_size=4000)
    best = found.best(3, "sse")
    assert best[0].distribution == "norm" and best[0].sse < 0.001 and best[0].data["data_count"] == 40_000
    out = found.df
    again = {r.distribution: r.sse for r in closed.sse(stats.long_frame(rows, ["value"]), out.select("column_name", "distribution", "parameters"), None, ("norm", "expon", "uniform")).collect()}
    assert {r.distribution: r.sse for r in out.collect()} == pytest.approx(again, rel=1e-6)
    top = rows.agg(F.max("value"), F.skewness("value")).first()
    assert (best[0].data["data_max"], best[0].data["data_skewness"]) == pytest.approx(tuple(top))


def test_whole_table_is_not_brought_to_the_driver(spark, monkeypatch):
    """Where all rows are asked for, closed forms are fitted and scored in the plan, with the scores of the tasks."""
    rows = spark.range(12_000).select(F.round(F.rand(7) * 30 - 9, 2).alias("value"), F.round(F.randn(8), 2).alias("other")).cache()
    laws, sizes, samples = list(fitting.IN_PLAN), [], fitting._samples
    monkeypatch.setattr(fitting, "_samples", lambda *a: sizes.append(samples(*a)) or sizes[-1])
    fit = lambda: DistributionFitter(spark).fit(rows, columns=["value", "other"], distributions=laws, fitting_sample_size=1 << 40).df.collect()
    got = {(r.column_name, r.distribution): r.asDict() for r in fit()}
    assert {len(p["x"]) for p in sizes[0].values()} == {fitting.SHOWN}
    monkeypatch.setattr(fitting, "SHOWN", 1 << 40)  # the same by tasks over all values
    want = {(r.column_name, r.distribution): r.asDict() for r in fit()}
    assert len(got) == len(want) == 10
    for k, row in want.items():
        for name, v in row.items():
            assert got[k][name] == (v if v is None or isinstance(v, str) else pytest.approx(v, rel=1e-6, abs=1e-9)), (k, name)


def test_closed_forms_of_a_table_leave_its_rows_where_they_are(spark, monkeypatch):
    held, samples = [], fitting._samples
    monkeypatch.setattr(fitting, "_samples", lambda *a: held.append(samples(*a)) or held[-1])
    got = catalogue.fitter_closed_forms(spark, "/root/testdata/sf0.1").collect()
    assert len(got) == 4 and {r.data_count for r in got} == {100_000} and len(held[0]["value"]["x"]) == fitting.SHOWN


@pytest.mark.parametrize("name", ["gumbel_r", *fitting.IN_PLAN])
def test_asked_for_rows_are_not_thinned(spark, name):
    """A fitting sample as large as the table is the table, above sample_threshold too."""
    rows = spark.range(12_000).select((F.randn(9) * 3 + 10).alias("value")).cache()
    fit = lambda **k: DistributionFitter(spark).fit(rows, column="value", distributions=[name], fitting_sample_size=1 << 40, **k).best(1, "aic")[0]
    assert fit(sample_threshold=1000, max_sample_size=400).aic == pytest.approx(fit().aic, rel=1e-9)


def test_discrete_fits_are_of_all_rows(spark, monkeypatch):
    rows = spark.range(30_000).select((F.col("id") % 7 + 1).alias("k"), (F.col("id") * 1_000_003).alias("wide"))
    row = DiscreteDistributionFitter(spark).fit(rows, column="k", distributions=["poisson"]).best(metric="aic")[0]
    mean = sum(i % 7 + 1 for i in range(30_000)) / 30_000
    assert row.parameters == pytest.approx([mean]) and row.data["data_count"] == 30_000
    assert row.aic == pytest.approx(2 - 2 * sum((i % 7 + 1) * math.log(mean) - mean - math.lgamma(i % 7 + 2) for i in range(30_000)))
    monkeypatch.setattr(fitting, "MOST_VALUES", 1000)  # too many values to count: a sample's counts
    wide = DiscreteDistributionFitter(spark).fit(rows, columns=["k", "wide"], distributions=["geom", "poisson"])
    assert wide.for_column("k").best(2, "aic")[0].data["data_count"] == 30_000 and wide.column_names == ["k", "wide"]


def test_shortlist_of_each_column(spark, data):
    found = DistributionFitter(spark).fit(data, columns=["value", "wait"], lazy_metrics=True, distributions=["norm", "expon", "uniform", "gamma", "logistic", "laplace", "gumbel_r", "rayleigh", "halfnorm", "cauchy"])
    asked = []
    whole = FitResults.materialize

    def spy(self):
        asked.append({r.column_name: r["count"] for r in self._df.groupBy("column_name").count().collect()})
        return whole(self)

    FitResults.materialize = spy
    try:
        top = found.shortlist(1)
    finally:
        FitResults.materialize = whole
    assert asked and set(asked[0]) == {"value", "wait"} and set(asked[0].values()) == {8}
    assert top[0].ks_statistic == pytest.approx(min(r.ks_statistic for r in found.best_per_column(10)["value"] + found.best_per_column(10)["wait"]))


def test_far_values_and_many_edges(spark):
    rows = spark.createDataFrame([(1,), (1,), (3,), (10**12,), (-4,)], "k long")
    got = {r.value: (r.empirical, r.theoretical) for r in diagnostics.discrete_data(rows, "k", FitResult("poisson", [2.0])).collect()}
    assert sorted(got) == [-4, 0, 1, 2, 3, 4, 5, *range(10**12 - 2, 10**12 + 3)]
    assert got[1][0] == 0.4 and got[2] == (0.0, pytest.approx(2 * math.exp(-2))) and got[-4] == (0.2, 0.0)
    values = spark.range(5000).select((F.col("id") / 7).alias("value"))
    edges = [i / 5 for i in range(3001)]
    h = {r.bin_id: r.n for r in stats.histogram(stats.long_frame(values, ["value"]), edges=edges).collect()}
    want = np.histogram([i / 7 for i in range(5000)], edges)[0]
    assert h == {i: int(n) for i, n in enumerate(want) if n}


def test_running_counts_of_two_far_modes(spark):
    x = np.concatenate([np.random.default_rng(1).normal(0, 1e-6, 3000), np.random.default_rng(2).normal(1e9, 1e-3, 3000), [5.0] * 4000])
    rows = stats.long_frame(spark.createDataFrame([(float(v),) for v in x], "v double"), ["v"])
    got = {r.value: (r.before, r.upto) for r in stats.ecdf(rows).collect()}
    ordered = np.sort(x)
    assert got == {v: (np.searchsorted(ordered, v), np.searchsorted(ordered, v, "right")) for v in set(x.tolist())}


def test_running_counts_whatever_order_tasks_end_in(spark):
    """The plan comes to the buckets twice, which must be the same ones."""
    rows = spark.range(60_000).select(F.lit("v").alias("column_name"), F.rand(5).alias("value"))
    plans = [stats.ecdf(rows), stats.with_previous(rows), stats.ecdf_counts(rows.select("value", F.lit(1).alias("n")), "n")]
    assert not any("percentile_approx" in df._jdf.queryExecution().toString() for df in plans)
    cuts = [stats._cuts(some, ["column_name"]).first()["_q"] for some in (rows.repartition(7, "value"), rows.orderBy(F.desc("value")), rows.coalesce(1))]
    assert cuts[0] == cuts[1] == cuts[2] == sorted(cuts[0]) and len(cuts[0]) == stats.CUTS - 1


def test_qq_plan_has_one_set_of_buckets(spark, data):
    df = diagnostics.qq_data(data, "wait", FitResult("expon", [0.0, 5.0]))
    assert "percentile_approx" not in df._jdf.queryExecution().toString()
    got = df.orderBy("sample").toPandas()
    assert np.allclose(got.p, (got.n.cumsum() - (got.n - 1) / 2 - 0.375) / 3000.25)


def test_cdf_plan_has_one_set_of_buckets(spark, data):
    df = diagnostics.cdf_data(data, "wait", FitResult("expon", [0.0, 5.0]))
    assert "percentile_approx" not in df._jdf.queryExecution().toString()
    x = np.sort([r.wait for r in data.select("wait").collect()])
    got = df.orderBy("value").toPandas()
    assert np.allclose(got.empirical, np.searchsorted(x, got.value, "right") / 3000)


def test_discrete(spark, data):
    r = DiscreteDistributionFitter(spark).fit(data, columns=["counts", "hits"])
    aic = {(x.column_name, x.distribution): x.aic for x in r.df.collect()}
    for column, true in (("counts", "poisson"), ("hits", "binom")):
        # families that contain the true one may win by chance, by little more than their extra parameters allow
        assert aic[column, true] <= min(v for (c, _), v in aic.items() if c == column) + 6
        assert aic[column, true] < aic[column, "planck"] - 100
    law = r.for_column("counts").df.where("distribution = 'poisson'").first()
    fitted = FitResult.of(law)
    assert fitted.pmf(range(60)).sum() == pytest.approx(1) and fitted.cdf([100])[0] == pytest.approx(1)
    low = DiscreteDistributionFitter(spark).fit(data, column="counts", distributions=["poisson"], bounded=True, lower_bound=2, upper_bound=12).best(metric="aic")[0]
    assert low.pmf([1, 13]).tolist() == [0, 0] and low.pmf(range(2, 13)).sum() == pytest.approx(1)


def test_censored_and_custom(spark, data):
    rows = data.select(F.least("wait", F.lit(8.0)).alias("t"), (F.col("wait") <= 8).alias("e"))
    b = DistributionFitter(spark).fit(rows, column="t", censoring_column="e", distributions=["expon"]).best(metric="aic")[0]
    assert sum(b.parameters) == pytest.approx(5, rel=0.15) and b.ks_statistic is None
    law = Law("halved", (), lambda: (0.0, math.inf), lambda x: -x, lambda x: -np.expm1(-x), ((),))
    DistributionFitter.register_distribution("halved", law)
    try:
        r = DistributionFitter(spark).fit(data, column="wait", distributions=["halved", "norm"])
        assert r.best(1, "aic")[0].distribution == "halved" and r.best(1, "aic")[0].cdf([1e9])[0] == 1
    finally:
        registry.unregister_distribution("halved")


def test_heavy_tail_warning(spark):
    x = spark.createDataFrame([(float(v),) for v in np.random.default_rng(1).pareto(1.2, 2000)], "value double")
    with pytest.warns(UserWarning, match="heavy-tailed"):
        DistributionFitter(spark).fit(x, column="value", distributions=["norm"])
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        DistributionFitter(spark).fit(x, column="value", distributions=["lomax"], estimation_method="auto")


def test_progress(spark, data):
    seen = []
    DistributionFitter(spark).fit(data, column="value", distributions=SOME, progress_callback=lambda *a: seen.append(a))
    assert seen[-1][2] == 100.0


def test_bootstrap(spark, data):
    got = FitResult("norm", [50.0, 10.0]).confidence_intervals(data, "value", n_bootstrap=40)
    assert got["loc"][0] < 50.2 and got["loc"][1] > 49.5 and got["scale"][0] < got["scale"][1]
    assert FitResult("poisson", [7.0]).confidence_intervals(data, "counts", n_bootstrap=20)["mu"][0] < 7.2
    with pytest.raises(ValueError):
        FitResult("norm", [0.0, 1.0]).confidence_intervals(data, "value", n_bootstrap=5)


def test_bootstrap_of_all_rows(spark, monkeypatch):
    rows = spark.range(40_000).select(F.randn(3).alias("value"), (F.col("id") % 5).alias("k"))
    low, high = FitResult("norm", [0.0, 1.0]).confidence_intervals(rows, "value", n_bootstrap=100, max_samples=None)["loc"]
    assert high - low == pytest.approx(2 * 1.96 / 200, rel=0.35)  # as wide as 40,000 rows make it
    low, high = FitResult("poisson", [2.0]).confidence_intervals(rows, "k", n_bootstrap=100, max_samples=None)["mu"]
    assert high - low == pytest.approx(2 * 1.96 * 2**0.5 / 200, rel=0.35)
    asked = {}
    monkeypatch.setattr(FitResult, "confidence_intervals", lambda self, df, column, **k: asked.update(k) or {"a": (0.0, 1.0)})
    catalogue.bootstrap_intervals(spark, "/root/testdata/sf0.001")
    assert asked == {"n_bootstrap": 1000, "max_samples": None}


def test_samples(spark):
    x = sample_distributed(spark, "norm", [5.0, 2.0], 20_000)
    m = x.agg(F.avg("sample"), F.stddev("sample")).first()
    assert m[0] == pytest.approx(5, abs=0.1) and m[1] == pytest.approx(2, abs=0.1)
    one = sample_distributed(spark, "gamma", [2.0, 0.0, 3.0], 1000, num_partitions=2).toPandas()["sample"].sort_values().to_numpy()
    two = sample_distributed(spark, "gamma", [2.0, 0.0, 3.0], 1000, num_partitions=7).toPandas()["sample"].sort_values().to_numpy()
    assert np.allclose(one, two) and one.mean() == pytest.approx(6, rel=0.1)
    made = sampling.generate_samples(spark, 103, lambda n, part, seed: np.random.default_rng(seed).random((n, 2)), ["a", "b"], 5)
    assert made.count() == 103 and made.distinct().count() == 103
    with pytest.raises(ValueError):
        sample_distributed(spark, "norm", [0, 1], 0)


def test_several_columns(spark, tmp_path):
    cov = np.array([[4.0, 2, 1], [2, 9, 3], [1, 3, 16]])
    x = np.random.default_rng(2).multivariate_normal([10, 20, 30], cov, 4000)
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double").cache()
    m = MultivariateNormal.fit(df, ["a", "b", "c"])
    assert np.allclose(m.mean, x.mean(axis=0)) and np.allclose(m.covariance, np.cov(x.T))
    d = df.select(m.mahalanobis().alias("d"), m.logpdf().alias("l")).toPandas()
    off = x - x.mean(axis=0)
    assert np.allclose(np.sort(d.d), np.sort(np.sqrt(np.einsum("ni,ij,nj->n", off, np.linalg.inv(np.cov(x.T)), off))))
    assert np.allclose(np.cov(m.sample_distributed(spark, 8000).toPandas().to_numpy().T), cov, atol=1.0)
    assert m.sample(10, 1).shape == (10, 3) and np.allclose(np.diag(m.correlation_matrix()), 1)
    r = DistributionFitter(spark).fit(df, columns=["a", "b"], distributions=["norm", "uniform"])
    c = GaussianCopula.fit(r, df)
    drawn = c.sample_distributed(spark, 8000, random_seed=3).toPandas()
    assert np.corrcoef(drawn.a, drawn.b)[0, 1] == pytest.approx(c.correlation[0, 1], abs=0.05)
    assert set(c.sample(50, 1)) == {"a", "b"} and c.sample_distributed(spark, 10, return_uniform=True).where("a > 1 OR a < 0").count() == 0
    with pytest.raises(ValueError):
        GaussianCopula.fit(r, df, ["a"])
    for model in (m, c):
        for name in ("m.json", "m.pkl"):
            save(model, str(tmp_path / name))
            again = load(str(tmp_path / name))
            assert type(again) is type(model) and again.column_names == model.column_names
    near = spark.createDataFrame([(float(i), float(i) * 2) for i in range(50)], "a double, b double")
    with pytest.warns(UserWarning):
        MultivariateNormal.fit(near, ["a", "b"])


def test_mixture(spark):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(0, 1, 800), r.normal(6, 1, 1200)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    m = GaussianMixture.fit(df, ["x"], 2, max_iter=40)
    order = np.argsort(m.means[:, 0])
    assert np.allclose(m.means[order, 0], [0, 6], atol=0.3) and np.allclose(m.weights[order], [0.4, 0.6], atol=0.05)
    assert m.predict(df).select("component").distinct().count() == 2 and m.aic() < m.bic()
    one = GaussianMixture.fit(df, ["x"], 1, init="random")
    assert one.means[0, 0] == pytest.approx(x.mean(), abs=1e-6) and one.bic() > m.bic()
    assert m.sample(100, 1)[0].shape == (100, 1)
    drawn = m.sample_distributed(spark, 6000).toPandas()
    assert drawn.x.mean() == pytest.approx(x.mean(), abs=0.2)
    with pytest.raises(ValueError):
        GaussianMixture.fit(df, ["x"], 0)


def test_files(results, tmp_path, spark):
    b = results.best()[0]
    for name in ("r.json", "r.pickle"):
        b.save(str(tmp_path / name))
        again = FitResult.load(str(tmp_path / name))
        assert again.parameters == b.parameters and again.data == b.data and again.sse == b.sse
    with pytest.raises(SerializationError):
        save(b, "x.txt")
    with pytest.raises(SerializationError):
        save(object(), str(tmp_path / "y.json"))
    for bad in ('{"distribution": "nope", "parameters": [1]}', '{"distribution": "norm"}', "{", "[]", '{"distribution": "norm", "parameters": [1]}', '{"type": "Other"}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(SerializationError):
            load(str(tmp_path / "bad.json"))
    models.write_results(results, str(tmp_path / "table"))
    assert models.read_results(spark, str(tmp_path / "table")).count() == results.count()


def test_aggregates(spark, data):
    rows = stats.long_frame(data, ["value"])
    e = stats.ecdf(rows).orderBy("value").toPandas()
    assert e.upto.tolist() == e.n.cumsum().tolist() and e.total.iloc[0] == 3000
    p = stats.with_previous(stats.ecdf(rows)).orderBy("value").toPandas()
    assert np.array_equal(p.previous.to_numpy()[1:], p.value.to_numpy()[:-1]) and np.isnan(p.previous[0])
    same = data.select("value", F.lit("a").alias("g")).union(data.select(F.col("value") + 3, F.lit("b")))
    d = stats.two_sample_ks(same, "g", "a", "b").first()
    assert 0.08 < d.ks_statistic < 0.16
    assert tables.column_range(data, "counts")["count"] == 3000 and tables.get_spark_session() is not None
    assert tables.create_dataframe(spark, [1.0, 2.0], ["v"]).count() == 2
    q = stats.quantiles(rows, (0.5,)).first()
    assert q.q50 == pytest.approx(50, abs=1)


def test_diagnostics(results, data):
    b = results.for_column("value").best(1, "aic")[0]
    parts = diagnostics.diagnostics(data, "value", b)
    qq = parts["qq"].toPandas()
    assert np.corrcoef(qq.theoretical, qq["sample"])[0, 1] > 0.99
    pp = parts["pp"].toPandas()
    assert abs(pp.empirical - pp.theoretical).max() < 0.05
    assert abs(parts["residuals"].toPandas().residual.mean()) < 0.01 and parts["cdf"].count() > 0
    bars, lines = diagnostics.distribution_data(data, "value", results.for_column("value").best(2, "aic"))
    assert bars.count() > 10 and lines.count() == 2000
    counts = diagnostics.discrete_data(data, "counts", FitResult("poisson", [7.0])).toPandas()
    assert counts.theoretical.sum() == pytest.approx(1, abs=0.01)


def test_stream(spark, data, tmp_path):
    path = str(tmp_path / "in")
    data.select("value").repartition(2).write.parquet(path)
    found = []
    monitor = DriftMonitor(data, "value", on_drift=lambda i, row: found.append(i))
    stream = spark.readStream.schema("value double").parquet(path).select((F.col("value") + 8).alias("value"))
    q = monitor.start(stream, str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert found and monitor.history[0][1].drift
    assert not monitor.compare(data).first().drift
    events = spark.readStream.schema("event_id long, ts timestamp, value double").parquet("/root/testdata/sf0.001/events.parquet/../e*.parquet")
    out = windowed_moments(events, "value", "ts")
    w = out.writeStream.format("memory").queryName("moments").outputMode("complete").start()
    w.processAllAvailable()
    w.stop()
    want = catalogue.QUERIES["daily_moments"](spark, "/root/testdata/sf0.001").count()
    assert spark.table("moments").count() == want
