"""The library's queries over the test tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawfinder.functions import columns as C
from lawfinder.functions import registry
from lawfinder.operators import closed, diagnostics, fitting, lifetimes, multivariate, stats
from lawfinder.operators.results import FitResult, FitResults
from lawfinder.operators.sampling import golden
from lawfinder.sources.tables import table
from lawfinder.streaming.drift import windowed_moments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """All doubles rounded; ``other`` says the digits of single columns."""
    return df.select(*[F.round(c, other.get(c, digits)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def events(spark, d):
    return stats.long_frame(table(spark, d, "events"), ["value"])


FAMILIES = ("norm", "expon", "uniform", "halfnorm", "rayleigh", "maxwell", "lognorm", "pareto", "invgauss", "laplace")
EV = "ev AS (SELECT 'value' AS column_name, value FROM events WHERE value IS NOT NULL)"
#: Closed-form estimates of events.value in SQL: one row for each family, p0 the shape where there is one.
FITS = f"""{EV},
st AS (SELECT column_name, count(*) AS n, min(value) AS mi, max(value) AS ma, avg(value) AS me, stddev_pop(value) AS sd, avg(value * value) AS sq,
       avg(ln(value)) AS ml, stddev_pop(ln(value)) AS sl, avg(1 / value) AS iv, quantile_cont(value, 0.5) AS med FROM ev GROUP BY column_name),
md AS (SELECT ev.column_name, avg(abs(value - med)) AS dev FROM ev JOIN st USING (column_name) GROUP BY 1),
fits AS (SELECT column_name, n, distribution, s, loc, scale, k FROM st JOIN md USING (column_name), LATERAL (VALUES
  ('norm', CAST(NULL AS DOUBLE), me, sd, 2), ('expon', NULL, mi, me - mi, 2), ('uniform', NULL, mi, ma - mi, 2), ('halfnorm', NULL, mi, sqrt(sq - 2 * mi * me + mi * mi), 2),
  ('rayleigh', NULL, 0.0, sqrt(sq / 2), 2), ('maxwell', NULL, 0.0, sqrt(sq / 3), 2), ('lognorm', sl, 0.0, exp(ml), 3), ('pareto', 1 / (ml - ln(mi)), 0.0, mi, 3),
  ('invgauss', me * (iv - 1 / me), 0.0, 1 / (iv - 1 / me), 3), ('laplace', NULL, med, dev, 2)) AS t(distribution, s, loc, scale, k))"""


def phi_sql(x: str) -> str:
    """The normal distribution function by its Taylor-like series with odd factorials: another way than the library's own."""
    series = f"list_sum(list_transform(range(0, 110), lambda k: exp((2 * k + 1) * ln(greatest(abs({x}), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + ln(pi()) / 2)))"
    return f"(CASE WHEN abs({x}) > 8 THEN CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {series} END)"


def cdf_sql(x: str) -> str:
    z = f"(({x} - loc) / scale)"
    pos = lambda body: f"CASE WHEN {z} <= 0 THEN 0 ELSE {body} END"
    return f"""CASE distribution WHEN 'norm' THEN {phi_sql(z)} WHEN 'expon' THEN {pos(f"1 - exp(-{z})")} WHEN 'uniform' THEN least(1, greatest(0, {z}))
 WHEN 'laplace' THEN CASE WHEN {z} < 0 THEN exp({z}) / 2 ELSE 1 - exp(-{z}) / 2 END WHEN 'halfnorm' THEN {pos(f"2 * {phi_sql(z)} - 1")}
 WHEN 'rayleigh' THEN {pos(f"1 - exp(-{z} * {z} / 2)")} WHEN 'maxwell' THEN {pos(f"2 * {phi_sql(z)} - 1 - sqrt(2 / pi()) * {z} * exp(-{z} * {z} / 2)")}
 WHEN 'lognorm' THEN {pos(phi_sql(f"(ln({z}) / s)"))} WHEN 'pareto' THEN CASE WHEN {z} <= 1 THEN 0 ELSE 1 - pow({z}, -s) END
 WHEN 'invgauss' THEN {pos(f"{phi_sql(f'(({z} / s - 1) / sqrt({z}))')} + exp(2 / s) * {phi_sql(f'(-({z} / s + 1) / sqrt({z}))')}")} END"""


LOGPDF = """(CASE distribution WHEN 'norm' THEN -z * z / 2 - 0.5 * ln(2 * pi()) WHEN 'expon' THEN -z WHEN 'uniform' THEN 0 WHEN 'laplace' THEN -abs(z) - ln(2)
 WHEN 'halfnorm' THEN ln(2) - z * z / 2 - 0.5 * ln(2 * pi()) WHEN 'rayleigh' THEN ln(z) - z * z / 2 WHEN 'maxwell' THEN ln(2) - 0.5 * ln(2 * pi()) + 2 * ln(z) - z * z / 2
 WHEN 'lognorm' THEN -pow(ln(z) / s, 2) / 2 - 0.5 * ln(2 * pi()) - ln(s) - ln(z) WHEN 'pareto' THEN ln(s) - (s + 1) * ln(z)
 WHEN 'invgauss' THEN -0.5 * ln(2 * pi()) - 1.5 * ln(z) - pow(z - s, 2) / (2 * z * s * s) END) - ln(scale)"""
LIKE = f"""{FITS},
ll AS (SELECT column_name, distribution, sum({LOGPDF}) AS loglik FROM (
  SELECT column_name, distribution, s, scale, CASE WHEN distribution IN ('norm', 'laplace') THEN (value - loc) / scale ELSE greatest((value - loc) / scale, CASE WHEN distribution IN ('lognorm', 'rayleigh', 'maxwell', 'pareto', 'invgauss') THEN 1e-300 ELSE 0 END) END AS z
  FROM ev JOIN fits USING (column_name)) GROUP BY ALL),
sc AS (SELECT f.*, loglik, 2 * k - 2 * loglik AS aic, k * ln(n) - 2 * loglik AS bic FROM fits f JOIN ll USING (column_name, distribution))"""
SSE = f"""rg AS (SELECT min(value) AS mi, max(value) AS ma, CAST(greatest(2, ceil(pow(count(*), 1.0 / 3) - 1e-9) * 2) AS INTEGER) AS bins, count(*) AS n_all FROM ev),
hc AS (SELECT least(CAST(floor((value - mi) / ((ma - mi) / bins)) AS INTEGER), bins - 1) AS b, count(*) AS c FROM ev, rg GROUP BY 1),
gr AS (SELECT b, mi + (ma - mi) / bins * b AS lo, mi + (ma - mi) / bins * (b + 1) AS hi, (ma - mi) / bins AS w, coalesce(c, 0) / (n_all * ((ma - mi) / bins)) AS density
       FROM (SELECT *, unnest(range(0, bins)) AS b FROM rg) LEFT JOIN hc USING (b)),
ss AS (SELECT distribution, sum(pow(density - (({cdf_sql("hi")}) - ({cdf_sql("lo")})) / w, 2)) AS sse FROM gr CROSS JOIN fits GROUP BY 1)"""
DIST = f"""dv AS (SELECT column_name, value, count(*) AS c FROM ev GROUP BY ALL),
ec AS (SELECT column_name, value, c, CAST(sum(c) OVER (ORDER BY value) AS DOUBLE) AS up, CAST(sum(c) OVER (ORDER BY value) - c AS DOUBLE) AS lo, CAST(sum(c) OVER () AS DOUBLE) AS nn FROM dv),
ff AS (SELECT ec.*, distribution, {cdf_sql("value")} AS f FROM ec JOIN fits USING (column_name)),
ks AS (SELECT distribution, max(greatest(up / nn - f, f - lo / nn)) AS ks_statistic,
       -max(nn) - sum((up * up - lo * lo) * ln(g) + ((nn - lo) * (nn - lo) - (nn - up) * (nn - up)) * ln(1 - g)) / max(nn) AS ad_statistic
       FROM (SELECT *, least(greatest(f, 1e-10), 1 - 1e-10) AS g FROM ff) GROUP BY 1)"""
ALL = f"WITH {LIKE}, {SSE}, {DIST}, al AS (SELECT sc.*, sse, ks_statistic, ad_statistic FROM sc JOIN ss USING (distribution) JOIN ks USING (distribution))"


def fit_table(spark, d) -> DataFrame:
    return closed.full_fit(events(spark, d), FAMILIES)


# ---- aggregates


def _moments_sql(source: str, by: str) -> str:
    return f"""SELECT {by}, count(*) AS n, round(min(v), 6) AS data_min, round(max(v), 6) AS data_max, round(avg(v), 6) AS data_mean, round(stddev_pop(v), 6) AS data_stddev,
 round((avg(v * v * v) - 3 * avg(v) * avg(v * v) + 2 * pow(avg(v), 3)) / pow(stddev_pop(v), 3), 5) AS data_skewness, round(kurtosis_pop(v), 5) AS data_kurtosis FROM ({source}) GROUP BY {by}"""


_MOMENTS = ("n", "data_min", "data_max", "data_mean", "data_stddev", "data_skewness", "data_kurtosis")
_FOUR = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS v FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))


@query("column_stats", _moments_sql(_FOUR, "column_name"))
def column_stats(spark, d):
    rows = stats.long_frame(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return rounded(stats.column_stats(rows).select("column_name", *_MOMENTS), 6, data_skewness=5, data_kurtosis=5)


@query("grouped_stats", _moments_sql("SELECT event_type, value AS v FROM events", "event_type"))
def grouped_stats(spark, d):
    rows = stats.long_frame(table(spark, d, "events"), ["value"], keep=["event_type"])
    return rounded(stats.column_stats(rows, ["event_type"]).select("event_type", *_MOMENTS), 6, data_skewness=5, data_kurtosis=5)


@query("auto_bounds", "SELECT column_name, min(v) AS lower_bound, max(v) AS upper_bound FROM (SELECT 'o_totalprice' AS column_name, o_totalprice AS v FROM orders) GROUP BY 1")
def auto_bounds(spark, d):
    return stats.auto_bounds(stats.long_frame(table(spark, d, "orders"), ["o_totalprice"]))


@query("exact_quantiles", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.99), 6) AS q99 FROM events GROUP BY 1")
def exact_quantiles(spark, d):
    return rounded(stats.quantiles(stats.long_frame(table(spark, d, "events"), ["value"], keep=["event_type"]), (0.25, 0.5, 0.99), ["event_type"], exact=True))


@query(
    "heavy_tail_flags",
    """WITH s AS (SELECT 'n_chars' AS column_name, CAST(n_chars AS DOUBLE) AS v FROM documents UNION ALL SELECT 'o_totalprice', o_totalprice FROM orders UNION ALL SELECT 'value', value FROM events),
a AS (SELECT column_name, count(*) AS n, kurtosis_pop(v) AS k, quantile_cont(v, 0.99) AS p, max(v) AS m FROM s GROUP BY 1)
SELECT column_name, round(k, 5) AS kurtosis, round(m / p, 6) AS max_over_p99, n >= 10 AND (k > 6 OR m / p > 3) AS heavy_tailed FROM a""",
)
def heavy_tail_flags(spark, d):
    each = [stats.long_frame(table(spark, d, t), [c]) for t, c in (("documents", "n_chars"), ("orders", "o_totalprice"), ("events", "value"))]
    return rounded(stats.heavy_tail_flags(each[0].unionByName(each[1]).unionByName(each[2])), 6, kurtosis=5)


def _histogram_sql(column: str, source: str, bins: str) -> str:
    return f"""WITH r AS (SELECT min({column}) AS mi, max({column}) AS ma, {bins} AS bins, count(*) AS total FROM {source}),
h AS (SELECT least(CAST(floor(({column} - mi) / ((ma - mi) / bins)) AS INTEGER), bins - 1) AS bin_id, count(*) AS n FROM {source}, r GROUP BY 1)
SELECT '{column}' AS column_name, bin_id, round(mi + (ma - mi) / bins * bin_id, 6) AS lo, round(mi + (ma - mi) / bins * (bin_id + 1), 6) AS hi, n, round(n / (total * ((ma - mi) / bins)), 9) AS density FROM h, r"""


@query("histogram_rice", _histogram_sql("value", "events", "CAST(greatest(2, ceil(pow(count(*), 1.0 / 3) - 1e-9) * 2) AS INTEGER)"))
def histogram_rice(spark, d):
    return rounded(stats.histogram(events(spark, d)), 6, density=9)


@query("histogram_fixed", _histogram_sql("o_totalprice", "orders", "50"))
def histogram_fixed(spark, d):
    return rounded(stats.histogram(stats.long_frame(table(spark, d, "orders"), ["o_totalprice"]), 50), 6, density=9)


@query(
    "histogram_edges",
    """WITH e AS (SELECT unnest([0, 1, 2, 3]) AS bin_id, unnest([0.0, 10.0, 50.0, 100.0]) AS lo, unnest([10.0, 50.0, 100.0, 200.0]) AS hi),
h AS (SELECT bin_id, lo, hi, count(*) AS n FROM events JOIN e ON value >= lo AND (value < hi OR (bin_id = 3 AND value = hi)) GROUP BY ALL)
SELECT 'value' AS column_name, CAST(bin_id AS INTEGER) AS bin_id, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, n, round(n / (sum(n) OVER () * (hi - lo)), 9) AS density FROM h""",
)
def histogram_edges(spark, d):
    return rounded(stats.histogram(events(spark, d), edges=[0, 10, 50, 100, 200]), 6, density=9)


for _t, _c in (("lineitem", "l_quantity"), ("part", "p_size"), ("conversations", "turn")):

    @query(f"pmf_{_c}", f"SELECT '{_c}' AS column_name, CAST({_c} AS BIGINT) AS value, count(*) AS n, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM {_t}), 9) AS pmf FROM {_t} GROUP BY 2")
    def _pmf(spark, d, t=_t, c=_c):
        return rounded(stats.pmf(stats.long_frame(table(spark, d, t), [c], discrete=True)), 9)


@query(
    "ecdf_by_type",
    """WITH c AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, value, n, CAST(sum(n) OVER w - n AS BIGINT) AS before, CAST(sum(n) OVER w AS BIGINT) AS upto, CAST(sum(n) OVER (PARTITION BY event_type) AS BIGINT) AS total
FROM c WINDOW w AS (PARTITION BY event_type ORDER BY value)""",
)
def ecdf_by_type(spark, d):
    return stats.ecdf(stats.long_frame(table(spark, d, "events"), ["value"], keep=["event_type"]), ["event_type"])


# ---- fits and scores


@query("closed_form_fits", f"WITH {FITS} SELECT column_name, distribution, round(coalesce(s, -1), 6) AS shape, round(loc, 6) AS loc, round(scale, 6) AS scale, n FROM fits")
def closed_form_fits(spark, d):
    p = F.col("parameters")
    fits = closed.closed_fits(events(spark, d), FAMILIES)
    return rounded(fits.select("column_name", "distribution", F.when(F.size(p) == 3, p[0]).otherwise(-1.0).alias("shape"), F.element_at(p, -2).alias("loc"), F.element_at(p, -1).alias("scale"), "n"))


@query("likelihoods", f"WITH {LIKE} SELECT distribution, round(loglik, 3) AS loglik, round(aic, 3) AS aic, round(bic, 3) AS bic FROM sc")
def likelihoods(spark, d):
    rows = events(spark, d)
    return rounded(closed.closed_fits(rows, FAMILIES).select("distribution", "loglik", "aic", "bic"), 3)


@query("likelihoods_of_rows", f"WITH {LIKE} SELECT distribution, round(loglik, 3) AS loglik, round(aic, 3) AS aic, round(bic, 3) AS bic FROM sc")
def likelihoods_of_rows(spark, d):
    rows = events(spark, d)
    return rounded(closed.likelihoods(rows, closed.closed_fits(rows, FAMILIES), FAMILIES).select("distribution", "loglik", "aic", "bic"), 3)


@query("sse_scores", f"WITH {FITS}, {SSE} SELECT distribution, round(sse, 9) AS sse FROM ss")
def sse_scores(spark, d):
    rows = events(spark, d)
    return rounded(closed.sse(rows, closed.closed_fits(rows, FAMILIES), None, FAMILIES).select("distribution", "sse"), 9)


@query("ks_ad_distances", f"WITH {FITS}, {DIST} SELECT distribution, round(ks_statistic, 6) AS ks_statistic, round(ad_statistic, 3) AS ad_statistic FROM ks")
def ks_ad_distances(spark, d):
    rows = events(spark, d)
    return rounded(closed.distances(rows, closed.closed_fits(rows, FAMILIES), FAMILIES).select("distribution", "ks_statistic", "ad_statistic"), 6, ad_statistic=3)


@query(
    "ranked_fits",
    f"{ALL} SELECT column_name, distribution, round(aic, 3) AS aic, round(bic, 3) AS bic, round(sse, 9) AS sse, round(ks_statistic, 6) AS ks_statistic, round(ad_statistic, 3) AS ad_statistic, CAST(row_number() OVER (ORDER BY aic, distribution) AS INTEGER) AS rank FROM al",
)
def ranked_fits(spark, d):
    return rounded(fit_table(spark, d).select("column_name", "distribution", "aic", "bic", "sse", "ks_statistic", "ad_statistic", "rank"), 3, sse=9, ks_statistic=6)


@query("top_fits", f"{ALL} SELECT distribution, round(ks_statistic, 6) AS ks_statistic, CAST(row_number() OVER (ORDER BY al.ks_statistic, distribution) AS INTEGER) AS place FROM al ORDER BY place LIMIT 3")
def top_fits(spark, d):
    top = FitResults(fit_table(spark, d)).best(3)
    return rounded(spark.createDataFrame([(r.distribution, float(r.ks_statistic), i + 1) for i, r in enumerate(top)], "distribution string, ks_statistic double, place int"))


_BEST_COLUMNS = ("l_quantity", "l_extendedprice")


@query(
    "best_per_column",
    f"""WITH v AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS x FROM lineitem" for c in _BEST_COLUMNS)}),
s AS (SELECT column_name, count(*) AS n, min(x) AS mi, max(x) AS ma, avg(x) AS me, stddev_pop(x) AS sd FROM v GROUP BY 1),
a AS (SELECT column_name, 'norm' AS distribution, 4 + n * (ln(2 * pi() * sd * sd) + 1) AS aic FROM s UNION ALL SELECT column_name, 'expon', 4 + 2 * n * (ln(me - mi) + 1) FROM s UNION ALL SELECT column_name, 'uniform', 4 + 2 * n * ln(ma - mi) FROM s)
SELECT column_name, distribution, round(aic, 2) AS aic FROM a QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY aic, distribution) = 1""",
)
def best_per_column(spark, d):
    rows = stats.long_frame(table(spark, d, "lineitem"), _BEST_COLUMNS)
    found = FitResults(closed.closed_fits(rows, ("norm", "expon", "uniform"))).best_per_column(1, "aic")
    return rounded(spark.createDataFrame([(c, r.distribution, float(r.aic)) for c, (r,) in found.items()], "column_name string, distribution string, aic double"), 2)


@query("filtered_fits", f"{ALL} SELECT distribution FROM al WHERE sse < 0.001 AND ks_statistic < 0.3")
def filtered_fits(spark, d):
    return FitResults(fit_table(spark, d)).filter(sse_threshold=0.001, ks_threshold=0.3).df.select("distribution")


@query(
    "fit_summary",
    f"{ALL} SELECT round(min(sse), 9) AS min_sse, round(avg(sse), 9) AS mean_sse, round(max(sse), 9) AS max_sse, round(min(aic), 3) AS min_aic, round(max(aic), 3) AS max_aic, round(min(ks_statistic), 6) AS min_ks_statistic, round(avg(ks_statistic), 6) AS mean_ks_statistic, count(*) AS total_distributions FROM al",
)
def fit_summary(spark, d):
    s = FitResults(fit_table(spark, d).withColumn("pvalue", F.lit(None).cast("double"))).summary()
    return rounded(s.select("min_sse", "mean_sse", "max_sse", "min_aic", "max_aic", "min_ks_statistic", "mean_ks_statistic", "total_distributions"), 9, min_aic=3, max_aic=3, min_ks_statistic=6, mean_ks_statistic=6)


@query(
    "quality_report",
    f"""{ALL}, ok AS (SELECT CAST(count(*) FILTER (WHERE ks_statistic <= 0.1 AND ad_statistic <= 2.0) AS BIGINT) AS n_acceptable, count(*) AS total FROM al),
top AS (SELECT * FROM al ORDER BY ks_statistic, distribution LIMIT 1)
SELECT distribution AS best, n_acceptable, CAST(CAST(ks_statistic > 0.1 AS INTEGER) + CAST(ad_statistic > 2.0 AS INTEGER) + CAST(n_acceptable < 3 AS INTEGER) AS BIGINT) AS n_warnings, total AS total_distributions FROM top, ok""",
)
def quality_report(spark, d):
    """Closed-form fits have no p-values: all count as one half here."""
    report = FitResults(fit_table(spark, d).withColumn("pvalue", F.lit(0.5))).quality_report(3)
    row = (report["top"][0].distribution, report["n_acceptable"], len(report["warnings"]), report["summary"]["total_distributions"])
    return spark.createDataFrame([row], "best string, n_acceptable long, n_warnings long, total_distributions long")


@query("result_columns", "SELECT DISTINCT column_name FROM (SELECT 'value' AS column_name FROM events UNION ALL SELECT 'o_totalprice' FROM orders)")
def result_columns(spark, d):
    each = [closed.closed_fits(stats.long_frame(table(spark, d, t), [c]), ("norm", "expon")) for t, c in (("events", "value"), ("orders", "o_totalprice"))]
    found = FitResults(each[0].union(each[1]))
    held = [n for n in found.column_names if found.for_column(n).count() == 2]
    return spark.createDataFrame([(n,) for n in held], "column_name string")


@query(
    "fits_by_group",
    """WITH s AS (SELECT event_type, count(*) AS n, min(value) AS mi, avg(value) AS me, stddev_pop(value) AS sd FROM events GROUP BY 1)
SELECT event_type, 'norm' AS distribution, round(4 + n * (ln(2 * pi() * sd * sd) + 1), 3) AS aic FROM s UNION ALL SELECT event_type, 'expon', round(4 + 2 * n * (ln(me - mi) + 1), 3) FROM s""",
)
def fits_by_group(spark, d):
    rows = stats.long_frame(table(spark, d, "events"), ["value"], keep=["event_type"]).drop("column_name")
    some = ("norm", "expon")
    return rounded(closed.closed_fits(rows, some, ["event_type"]).select("event_type", "distribution", "aic"), 3)


#: The families that are candidates by default, and those of them that are right-skewed whatever their shapes.
_CANDIDATES = """
alpha anglit arcsine argus beta betaprime bradford burr burr12 cauchy chi chi2 cosine crystalball dgamma dweibull erlang expon exponnorm exponweib f fatiguelife fisk
foldcauchy foldnorm gamma genexpon genextreme gengamma genhalflogistic genlogistic gennorm genpareto gibrat gompertz gumbel_l gumbel_r halfcauchy halfgennorm halflogistic
halfnorm hypsecant invgamma invgauss invweibull irwinhall jf_skew_t johnsonsb johnsonsu kappa3 landau laplace laplace_asymmetric levy levy_l loggamma logistic loglaplace
lognorm loguniform lomax maxwell moyal nakagami norm norminvgauss pareto pearson3 powerlaw powerlognorm powernorm rayleigh rdist reciprocal rel_breitwigner rice
semicircular skewcauchy skewnorm t trapezoid triang truncexpon truncnorm truncpareto truncweibull_min uniform weibull_max weibull_min wrapcauchy
""".split()
_SKEWED = """
burr chi2 erlang expon fisk gamma halfcauchy halfgennorm halflogistic halfnorm invgamma invweibull lognorm pareto powerlognorm rayleigh rice wald
""".split()


@query(
    "prefilter_candidates",
    f"""WITH s AS (SELECT (avg(v * v * v) - 3 * avg(v) * avg(v * v) + 2 * pow(avg(v), 3)) / pow(stddev_pop(v), 3) AS sk, kurtosis_pop(v) AS ku FROM (SELECT -value AS v FROM events))
SELECT distribution FROM (SELECT unnest({_CANDIDATES}) AS distribution), s WHERE NOT (sk < -1 AND distribution IN ({", ".join(f"'{n}'" for n in _SKEWED)})) AND NOT (ku > 10 AND distribution = 'uniform')""",
)
def prefilter_candidates(spark, d):
    shape = stats.column_stats(stats.long_frame(table(spark, d, "events").select((-F.col("value")).alias("v")), ["v"])).first()
    names = fitting.prefiltered(registry.continuous_names(), shape.data_skewness, shape.data_kurtosis, "aggressive")
    return spark.createDataFrame([(n,) for n in names], "distribution string")


# ---- discrete


_Q = "SELECT CAST(l_quantity AS BIGINT) AS k, CAST(count(*) AS DOUBLE) AS c FROM lineitem GROUP BY 1"


_DISCRETE = f"""WITH v AS ({_Q}), s AS (SELECT sum(c) AS n, sum(k * c) / sum(c) AS m FROM v),
f AS (SELECT 'poisson' AS distribution, m AS p, n FROM s UNION ALL SELECT 'geom', 1 / m, n FROM s UNION ALL SELECT 'planck', ln(1 + 1 / m), n FROM s),
e AS (SELECT distribution, p, n, k, c, CASE distribution WHEN 'poisson' THEN k * ln(p) - p - lgamma(k + 1) WHEN 'geom' THEN (k - 1) * ln(1 - p) + ln(p) ELSE ln(1 - exp(-p)) - p * k END AS l FROM v, f),
g AS (SELECT *, sum(c) OVER (PARTITION BY distribution ORDER BY k) / n AS upto, CASE distribution WHEN 'geom' THEN 1 - pow(1 - p, k) WHEN 'planck' THEN 1 - exp(-p * (k + 1))
      ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(j * ln(p) - p - lgamma(j + 1)))) END AS cdf FROM e)"""


def discrete(spark, d):
    return fitting.DiscreteDistributionFitter(spark).fit(table(spark, d, "lineitem"), column="l_quantity", distributions=["poisson", "geom", "planck"]).df


@query("discrete_fits", f"{_DISCRETE} SELECT distribution, round(p, 6) AS parameter, round(2 - 2 * sum(c * l), 3) AS aic, round(ln(n) - 2 * sum(c * l), 3) AS bic, CAST(n AS BIGINT) AS data_count FROM g GROUP BY distribution, p, n")
def discrete_fits(spark, d):
    return rounded(discrete(spark, d).select("distribution", F.col("parameters")[0].alias("parameter"), "aic", "bic", "data_count"), 3, parameter=6)


@query("discrete_scores", f"{_DISCRETE} SELECT distribution, round(sum(pow(c / n - exp(l), 2)), 9) AS sse, round(max(abs(upto - cdf)), 6) AS ks_statistic FROM g GROUP BY distribution")
def discrete_scores(spark, d):
    return rounded(discrete(spark, d).select("distribution", "sse", "ks_statistic"), 9, ks_statistic=6)


# ---- truncated and censored


@query(
    "truncated_expon",
    """WITH x AS (SELECT CAST(i AS DOUBLE) * 5 AS x FROM range(0, 31) t(i)), p AS (SELECT avg(value) - min(value) AS sc FROM events)
SELECT x, round(CASE WHEN x < 10 THEN 0 WHEN x >= 100 THEN 1 ELSE (exp(-10 / sc) - exp(-x / sc)) / (exp(-10 / sc) - exp(-100 / sc)) END, 7) AS cdf,
 round(CASE WHEN x < 10 OR x > 100 THEN 0 ELSE exp(-x / sc) / sc / (exp(-10 / sc) - exp(-100 / sc)) END, 7) AS pdf,
 round(sc + (10 * exp(-10 / sc) - 100 * exp(-100 / sc)) / (exp(-10 / sc) - exp(-100 / sc)), 6) AS mean FROM x, p""",
)
def truncated_expon(spark, d):
    scale = table(spark, d, "events").agg((F.avg("value") - F.min("value")).alias("sc"))
    x, low, high = F.col("x"), F.lit(10.0), F.lit(100.0)
    p = [F.lit(0.0), F.col("sc")]
    rows = spark.range(31).select((F.col("id") * 5).cast("double").alias("x")).crossJoin(F.broadcast(scale))  # scale is one row
    return rounded(rows.select("x", lifetimes.truncated_cdf("expon", x, p, low, high).alias("cdf"), lifetimes.truncated_pdf("expon", x, p, low, high).alias("pdf"), lifetimes.truncated_expon_mean(F.col("sc"), low, high).alias("mean")), 7, mean=6)


@query(
    "censored_exponential",
    """SELECT event_type, count(*) AS n, CAST(count(*) FILTER (WHERE value <= 100) AS BIGINT) AS n_events, round(sum(least(value, 100)) / count(*) FILTER (WHERE value <= 100), 6) AS scale,
 round(1 - count(*) FILTER (WHERE value <= 100) / CAST(count(*) AS DOUBLE), 6) AS censored_share FROM events GROUP BY 1""",
)
def censored_exponential(spark, d):
    rows = table(spark, d, "events").select("event_type", F.least("value", F.lit(100.0)).alias("time"), (F.col("value") <= 100).alias("event"))
    return rounded(lifetimes.censored_exponential(rows, "time", "event", ["event_type"]).select("event_type", "n", "n_events", "scale", "censored_share"))


@query(
    "spacing_objective",
    f"""WITH {EV}, c AS (SELECT value, count(*) AS n FROM ev GROUP BY 1), f AS (SELECT value, n, 1 - exp(-value / 50) AS f FROM c),
g AS (SELECT n, f, f - coalesce(lag(f) OVER (ORDER BY value), 0) AS gap FROM f)
SELECT 'value' AS column_name, round((sum(ln(greatest(gap, 1e-10)) + (n - 1) * ln(1e-10)) + ln(greatest(1 - max(f), 1e-10))) / (sum(n) + 1), 6) AS mean_log_spacing FROM g""",
)
def spacing_objective(spark, d):
    return rounded(lifetimes.spacing_objective(stats.ecdf(events(spark, d)), lambda x: 1 - F.exp(-x / 50)))


# ---- several columns


_PAIR = ("l_quantity", "l_extendedprice", "l_discount")


def _pairs_sql(cell: str, name: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, {cell.format(a=a, b=b)} AS {name} FROM r" for a in _PAIR for b in _PAIR)


@query("pearson_matrix", f"WITH r AS (SELECT * FROM lineitem) {_pairs_sql('round(corr({a}, {b}), 6)', 'correlation')}")
def pearson_matrix(spark, d):
    return rounded(stats.correlation(table(spark, d, "lineitem"), _PAIR, "pearson"))


@query(
    "spearman_matrix",
    f"""WITH r AS (SELECT {", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _PAIR)} FROM lineitem) {_pairs_sql('round(corr({a}, {b}), 6)', 'correlation')}""",
)
def spearman_matrix(spark, d):
    return rounded(stats.correlation(table(spark, d, "lineitem"), _PAIR, "spearman"))


for _dd, _f in ((0, "covar_pop"), (1, "covar_samp")):

    @query(f"covariance_ddof{_dd}", f"WITH r AS (SELECT * FROM lineitem) {_pairs_sql(f'round({_f}({{a}}, {{b}}), 4)', 'covariance')}")
    def _cov(spark, d, ddof=_dd):
        return rounded(stats.covariance(table(spark, d, "lineitem"), _PAIR, ddof).drop("mean_a"), 4)


@query(
    "mvn_mahalanobis",
    """WITH s AS (SELECT avg(l_quantity) AS ma, avg(l_extendedprice) AS mb, var_samp(l_quantity) AS va, var_samp(l_extendedprice) AS vb, covar_samp(l_quantity, l_extendedprice) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round(sqrt((pow(l_quantity - ma, 2) * vb - 2 * (l_quantity - ma) * (l_extendedprice - mb) * c + pow(l_extendedprice - mb, 2) * va) / (va * vb - c * c)), 6) AS distance FROM lineitem, s""",
)
def mvn_mahalanobis(spark, d):
    rows = table(spark, d, "lineitem")
    model = multivariate.MultivariateNormal.fit(rows, ["l_quantity", "l_extendedprice"])
    return rounded(rows.select("l_orderkey", "l_linenumber", model.mahalanobis().alias("distance")))


@query(
    "gmm_predict",
    """WITH l AS (SELECT event_id, ln(0.4) - 0.5 * (pow((value - 20) / 15, 2) + 2 * ln(15) + ln(2 * pi())) AS a, ln(0.6) - 0.5 * (pow((value - 80) / 50, 2) + 2 * ln(50) + ln(2 * pi())) AS b FROM events)
SELECT event_id, CASE WHEN a >= b THEN 0 ELSE 1 END AS component, round(1 / (1 + exp(b - a)), 6) AS p0, round(greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b))), 6) AS logpdf FROM l""",
)
def gmm_predict(spark, d):
    import numpy as np

    model = multivariate.GaussianMixture(["value"], np.array([0.4, 0.6]), np.array([[20.0], [80.0]]), np.array([[[225.0]], [[2500.0]]]))
    rows = model.predict(model.with_responsibilities(table(spark, d, "events").select("event_id", "value")))
    return rounded(rows.select("event_id", "component", F.col("responsibilities")[0].alias("p0"), model.logpdf().alias("logpdf")))


# ---- diagnostics


_POS = """WITH c AS (SELECT value, count(*) AS n FROM events GROUP BY 1), e AS (SELECT value, n, CAST(sum(n) OVER (ORDER BY value) AS DOUBLE) AS up, CAST(sum(n) OVER () AS DOUBLE) AS nn FROM c),
p AS (SELECT (SELECT min(value) FROM events) AS loc, (SELECT avg(value) - min(value) FROM events) AS sc),
q AS (SELECT value, up, nn, ((2 * up - n + 1) / 2 - 0.375) / (nn + 0.25) AS pos, loc, sc FROM e, p)"""


def _expon(spark, d):
    """events and the exponential law fitted to them."""
    return table(spark, d, "events"), FitResult.of(closed.closed_fits(events(spark, d), ("expon",)).first())


@query("qq_expon", f"{_POS} SELECT value AS sample, round(loc - sc * ln(1 - pos), 5) AS theoretical FROM q")
def qq_expon(spark, d):
    rows, law = _expon(spark, d)
    return rounded(diagnostics.qq_data(rows, "value", law).select("sample", "theoretical"), 5)


@query("pp_expon", f"{_POS} SELECT round(pos, 7) AS empirical, round(1 - exp(-(value - loc) / sc), 7) AS theoretical FROM q")
def pp_expon(spark, d):
    rows, law = _expon(spark, d)
    return rounded(diagnostics.pp_data(rows, "value", law).select("empirical", "theoretical"), 7)


@query("cdf_comparison", f"{_POS} SELECT value, round(up / nn, 7) AS empirical, round(1 - exp(-(value - loc) / sc), 7) AS theoretical FROM q")
def cdf_comparison(spark, d):
    rows, law = _expon(spark, d)
    return rounded(diagnostics.cdf_data(rows, "value", law), 7)


@query(
    "residual_histogram",
    f"WITH {FITS}, {SSE} SELECT CAST(b AS INTEGER) AS bin_id, round((lo + hi) / 2, 6) AS centre, round(density - exp(-((lo + hi) / 2 - loc) / scale) / scale, 8) AS residual FROM gr, fits WHERE distribution = 'expon' AND density > 0",
)
def residual_histogram(spark, d):
    rows, law = _expon(spark, d)
    return rounded(diagnostics.residual_data(rows, "value", law), 6, residual=8)


@query(
    "discrete_plot",
    f"""WITH v AS ({_Q}), s AS (SELECT sum(c) AS n, sum(k * c) / sum(c) AS m FROM v), g AS (SELECT DISTINCT k + j AS value FROM v, (SELECT unnest([-2, -1, 0, 1, 2]) AS j) WHERE k + j >= 0)
SELECT CAST(g.value AS BIGINT) AS value, round(coalesce(c, 0) / n, 9) AS empirical, round(exp(g.value * ln(m) - m - lgamma(g.value + 1)), 9) AS theoretical FROM g CROSS JOIN s LEFT JOIN v ON v.k = g.value""",
)
def discrete_plot(spark, d):
    rows = table(spark, d, "lineitem")
    mean = rows.agg(F.avg("l_quantity")).first()[0]
    return rounded(diagnostics.discrete_data(rows, "l_quantity", FitResult("poisson", [mean])), 9)


# ---- the fitters, where SQL can say what they find: families with closed forms, on all rows


_FOUR_LAWS = ("norm", "expon", "uniform", "laplace")


@query(
    "fitter_closed_forms",
    f"""{ALL} SELECT al.distribution, round(loc, 6) AS loc, round(scale, 6) AS scale, round(sse, 9) AS sse, round(aic, 3) AS aic, round(bic, 3) AS bic, round(ks_statistic, 6) AS ks_statistic, round(ad_statistic, 3) AS ad_statistic,
 n AS data_count, round(sd, 6) AS data_stddev FROM al JOIN (SELECT sd FROM st) ON true WHERE distribution IN {_FOUR_LAWS}""",
)
def fitter_closed_forms(spark, d):
    """The fitter on all rows, none of which come to the driver to be fitted."""
    out = fitting.DistributionFitter(spark).fit(table(spark, d, "events"), column="value", distributions=list(_FOUR_LAWS), fitting_sample_size=1 << 40).df
    p = F.col("parameters")
    return rounded(out.select("distribution", p[0].alias("loc"), p[1].alias("scale"), "sse", "aic", "bic", "ks_statistic", "ad_statistic", "data_count", "data_stddev"), 6, sse=9, aic=3, bic=3, ad_statistic=3)


@query("fitter_above_threshold", f"SELECT unnest({list(_FOUR_LAWS)}) AS distribution, 0.0 AS off, (SELECT count(*) FROM events) AS data_count, (SELECT round(max(value), 6) FROM events) AS data_max")
def fitter_above_threshold(spark, d):
    """Above ``sample_threshold`` too SSE is that of all rows: nothing between it and the one that the plan gives for the same parameters."""
    out = fitting.DistributionFitter(spark).fit(table(spark, d, "events"), column="value", distributions=list(_FOUR_LAWS), sample_threshold=1000, max_sample_size=400, fitting_sample_size=300).df
    again = closed.sse(events(spark, d), out.select("column_name", "distribution", "parameters"), None, _FOUR_LAWS).withColumnRenamed("sse", "again")
    return rounded(out.join(again, ["column_name", "distribution"]).select("distribution", F.abs(F.col("sse") - F.col("again")).alias("off"), "data_count", "data_max"), 6, off=10)


@query("fitter_best_of_columns", """WITH v AS (SELECT 'l_quantity' AS column_name, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem),
s AS (SELECT column_name, count(*) AS n, min(x) AS mi, max(x) AS ma, avg(x) AS me, stddev_pop(x) AS sd FROM v GROUP BY 1),
a AS (SELECT column_name, n, 'norm' AS distribution, 4 + n * (ln(2 * pi() * sd * sd) + 1) AS aic FROM s UNION ALL SELECT column_name, n, 'expon', 4 + 2 * n * (ln(me - mi) + 1) FROM s UNION ALL SELECT column_name, n, 'uniform', 4 + 2 * n * ln(ma - mi) FROM s)
SELECT column_name, distribution, round(aic, 1) AS aic, n AS data_count FROM a QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY aic, distribution) <= 2""")
def fitter_best_of_columns(spark, d):
    found = fitting.DistributionFitter(spark).fit(table(spark, d, "lineitem"), columns=["l_quantity", "l_extendedprice"], distributions=["norm", "expon", "uniform"], fitting_sample_size=1 << 40)
    rows = [(c, r.distribution, float(r.aic), r.data["data_count"]) for c, two in found.best_per_column(2, "aic").items() for r in two]
    return rounded(spark.createDataFrame(rows, "column_name string, distribution string, aic double, data_count long"), 1)


@query("mvn_fit", f"WITH r AS (SELECT * FROM lineitem) {' UNION ALL '.join(f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(avg({a}), 4) AS mean_a, round(covar_samp({a}, {b}), 3) AS covariance FROM r" for a in _PAIR for b in _PAIR)}")
def mvn_fit(spark, d):
    m = multivariate.MultivariateNormal.fit(table(spark, d, "lineitem"), list(_PAIR))
    rows = [(a, b, float(m.mean[i]), float(m.covariance[i, j])) for i, a in enumerate(_PAIR) for j, b in enumerate(_PAIR)]
    return rounded(spark.createDataFrame(rows, "column_a string, column_b string, mean_a double, covariance double"), 4, covariance=3)


@query("approximate_quantiles", "SELECT event_type, true AS near FROM events GROUP BY 1")
def approximate_quantiles(spark, d):
    """Approximate quantiles have ranks within one in a thousand of the ones asked for."""
    rows = stats.long_frame(table(spark, d, "events"), ["value"], keep=["event_type"])
    at = (0.25, 0.5, 0.99)
    known = stats.quantiles(rows, at, ["event_type"])
    near = [F.abs(F.count_if(F.col("value") <= F.col(n)) / F.count("*") - p) <= 0.001 + 1 / F.count("*") for n, p in zip(("q25", "q50", "q99"), at, strict=True)]
    return rows.join(F.broadcast(known), "event_type").groupBy("event_type").agg((near[0] & near[1] & near[2]).alias("near"))


# ---- laws on a grid: what the fitting tasks evaluate


#: Family, shapes, density and (where it is elementary) distribution function in SQL, of z = x / 2.
_LAWS = [
    ("expon", (), "exp(-z)", "1 - exp(-z)"),
    ("weibull_min", (1.5,), "1.5 * sqrt(z) * exp(-pow(z, 1.5))", "1 - exp(-pow(z, 1.5))"),
    ("logistic", (), "exp(-z) / pow(1 + exp(-z), 2)", "1 / (1 + exp(-z))"),
    ("gumbel_r", (), "exp(-z - exp(-z))", "exp(-exp(-z))"),
    ("gumbel_l", (), "exp(z - exp(z))", "1 - exp(-exp(z))"),
    ("laplace", (), "exp(-z) / 2", "1 - exp(-z) / 2"),
    ("cauchy", (), "1 / (pi() * (1 + z * z))", "0.5 + atan(z) / pi()"),
    ("halfcauchy", (), "2 / (pi() * (1 + z * z))", "2 * atan(z) / pi()"),
    ("rayleigh", (), "z * exp(-z * z / 2)", "1 - exp(-z * z / 2)"),
    ("pareto", (2.5,), "CASE WHEN z < 1 THEN 0 ELSE 2.5 * pow(z, -3.5) END", "CASE WHEN z < 1 THEN 0 ELSE 1 - pow(z, -2.5) END"),
    ("lomax", (2.5,), "2.5 * pow(1 + z, -3.5)", "1 - pow(1 + z, -2.5)"),
    ("fisk", (2.0,), "2 * z / pow(1 + z * z, 2)", "1 / (1 + pow(z, -2))"),
    ("genpareto", (0.2,), "pow(1 + 0.2 * z, -6)", "1 - pow(1 + 0.2 * z, -5)"),
    ("maxwell", (), "sqrt(2 / pi()) * z * z * exp(-z * z / 2)", None),
    ("halfnorm", (), "sqrt(2 / pi()) * exp(-z * z / 2)", f"2 * {phi_sql('z')} - 1"),
    ("lognorm", (0.7,), "exp(-pow(ln(z) / 0.7, 2) / 2) / (0.7 * z * sqrt(2 * pi()))", phi_sql("(ln(z) / 0.7)")),
    ("gamma", (2.5,), "pow(z, 1.5) * exp(-z - lgamma(2.5))", None),
    ("chi2", (3.0,), "sqrt(z) * exp(-z / 2 - 1.5 * ln(2) - lgamma(1.5))", None),
    ("invgamma", (2.5,), "pow(z, -3.5) * exp(-1 / z - lgamma(2.5))", None),
    ("nakagami", (1.5,), "2 * pow(1.5, 1.5) * z * z * exp(-1.5 * z * z - lgamma(1.5))", None),
    ("t", (4.0,), "exp(lgamma(2.5) - lgamma(2)) / sqrt(4 * pi()) * pow(1 + z * z / 4, -2.5)", None),
    ("invgauss", (0.8,), "exp(-pow(z - 0.8, 2) / (2 * z * 0.64)) / sqrt(2 * pi() * pow(z, 3))", None),
]


def _law_sql(at: int, name: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{row[0]}' AS distribution, x, round({row[at]}{' / 2' if at == 2 else ''}, 7) AS {name} FROM g" for row in _LAWS if row[at])
    return f"WITH g AS (SELECT i / 4.0 AS x, i / 8.0 AS z FROM range(1, 61) t(i)) {each}"


def _on_grid(spark, at: int, name: str) -> DataFrame:
    x = [i / 4 for i in range(1, 61)]
    rows = []
    for row in _LAWS:
        if row[at]:
            law = FitResult(row[0], [*row[1], 0.0, 2.0])
            rows += [(row[0], u, float(v)) for u, v in zip(x, law.pdf(x) if at == 2 else law.cdf(x), strict=True)]
    return rounded(spark.createDataFrame(rows, f"distribution string, x double, {name} double"), 7)


@query("law_densities", _law_sql(2, "pdf"))
def law_densities(spark, d):
    return _on_grid(spark, 2, "pdf")


@query("law_distribution_functions", _law_sql(3, "cdf"))
def law_distribution_functions(spark, d):
    return _on_grid(spark, 3, "cdf")


@query(
    "law_masses",
    """WITH g AS (SELECT CAST(i AS BIGINT) AS k FROM range(0, 31) t(i))
SELECT 'poisson' AS distribution, k, round(exp(k * ln(4.5) - 4.5 - lgamma(k + 1)), 9) AS pmf FROM g
UNION ALL SELECT 'geom', k, round(CASE WHEN k < 1 THEN 0 ELSE 0.3 * pow(0.7, k - 1) END, 9) FROM g
UNION ALL SELECT 'binom', k, round(CASE WHEN k > 20 THEN 0 ELSE exp(lgamma(21) - lgamma(k + 1) - lgamma(greatest(21 - k, 1)) + k * ln(0.3) + (20 - k) * ln(0.7)) END, 9) FROM g
UNION ALL SELECT 'nbinom', k, round(exp(lgamma(k + 5) - lgamma(k + 1) - lgamma(5) + 5 * ln(0.4) + k * ln(0.6)), 9) FROM g
UNION ALL SELECT 'planck', k, round((1 - exp(-0.5)) * exp(-0.5 * k), 9) FROM g""",
)
def law_masses(spark, d):
    rows = []
    for name, p in (("poisson", [4.5]), ("geom", [0.3]), ("binom", [20.0, 0.3]), ("nbinom", [5.0, 0.4]), ("planck", [0.5])):
        rows += [(name, k, float(v)) for k, v in enumerate(FitResult(name, p).pmf(range(31)))]
    return rounded(spark.createDataFrame(rows, "distribution string, k long, pmf double"), 9)


@query(
    "saved_and_loaded",
    f"WITH {FITS} SELECT distribution, round(coalesce(s, -1), 6) AS shape, round(loc, 6) AS loc, round(scale, 6) AS scale, round(CASE WHEN {cdf_sql('60.0')} > {cdf_sql('20.0')} THEN ({cdf_sql('40.0')} - {cdf_sql('20.0')}) / ({cdf_sql('60.0')} - {cdf_sql('20.0')}) END, 6) AS cut_cdf FROM fits",
)
def saved_and_loaded(spark, d):
    """Fits that went through model files, and the middle of each law when it is cut to 20 and 60 (null where nothing of it lies there)."""
    rows = []
    with tempfile.TemporaryDirectory() as folder:  # the driver's own model files
        for i, r in enumerate(closed.closed_fits(events(spark, d), FAMILIES).collect()):
            path = f"{folder}/{i}.json"
            FitResult(r.distribution, list(r.parameters), "value", lower_bound=20.0, upper_bound=60.0).save(path)
            m = FitResult.load(path)
            middle = float(m.cdf([40.0])[0]) if m.frozen().mass > 0 else None
            rows.append((m.distribution, m.parameters[0] if len(m.parameters) == 3 else -1.0, m.parameters[-2], m.parameters[-1], middle))
    return rounded(spark.createDataFrame(rows, "distribution string, shape double, loc double, scale double, cut_cdf double"))


# ---- samples, drift, time




@query(
    "two_sample_ks",
    """WITH v AS (SELECT value, CAST(event_type = 'click' AS INTEGER) AS a FROM events WHERE event_type IN ('click', 'view')), s AS (SELECT sum(a) AS na, count(*) - sum(a) AS nb FROM v),
c AS (SELECT value, sum(a) AS x, count(*) - sum(a) AS y FROM v GROUP BY 1), r AS (SELECT sum(x) OVER (ORDER BY value) AS fx, sum(y) OVER (ORDER BY value) AS fy FROM c)
SELECT CAST(na AS BIGINT) AS n_first, CAST(nb AS BIGINT) AS n_second, round(max(abs(fx / CAST(na AS DOUBLE) - fy / CAST(nb AS DOUBLE))), 6) AS ks_statistic FROM r, s GROUP BY ALL""",
)
def two_sample_ks(spark, d):
    return rounded(stats.two_sample_ks(table(spark, d, "events"), "event_type", "click", "view"))


@query(
    "stratified_shares",
    """WITH q AS (SELECT quantile_cont(value, 0.2) AS a, quantile_cont(value, 0.4) AS b, quantile_cont(value, 0.6) AS c, quantile_cont(value, 0.8) AS e FROM events),
s AS (SELECT CAST(value > a AS INTEGER) + CAST(value > b AS INTEGER) + CAST(value > c AS INTEGER) + CAST(value > e AS INTEGER) AS stratum FROM events, q)
SELECT stratum, count(*) AS n, round(least(1.0, CASE WHEN stratum IN (0, 4) THEN greatest(0.1, 500.0 / count(*)) ELSE 0.1 END), 9) AS share FROM s GROUP BY 1""",
)
def stratified_shares(spark, d):
    cuts = stats.quantiles(events(spark, d), (0.2, 0.4, 0.6, 0.8), exact=True).first()
    stratum = sum(((F.col("value") > q).cast("int") for q in cuts[2:]), (F.col("value") > cuts[1]).cast("int"))
    sizes = {r.stratum: r.n for r in table(spark, d, "events").groupBy(stratum.alias("stratum")).agg(F.count("*").alias("n")).collect()}
    shares = fitting.stratum_shares(sizes, 0.1, 500)
    return rounded(spark.createDataFrame([(k, n, float(shares[k])) for k, n in sizes.items()], "stratum int, n long, share double"), 9)


@query(
    "ppf_grid",
    """WITH g AS (SELECT (i + 0.5) / 100 AS q FROM range(0, 100) t(i)) SELECT q, round(2 - 3 * ln(1 - q), 6) AS expon, round(1 + 4 * q, 6) AS uniform, round(2 * pow(-ln(1 - q), 1 / 1.5), 6) AS weibull_min,
 round(5 * pow(1 - q, -1 / 2.5), 6) AS pareto, round(1 + 2 * ln(q / (1 - q)), 6) AS logistic, round(3 - 2 * ln(-ln(q)), 6) AS gumbel_r, round(4 * sqrt(-2 * ln(1 - q)), 6) AS rayleigh FROM g""",
)
def ppf_grid(spark, d):
    q = F.col("q")
    lit = lambda *p: [F.lit(float(v)) for v in p]
    laws = {"expon": lit(2, 3), "uniform": lit(1, 4), "weibull_min": lit(1.5, 0, 2), "pareto": lit(2.5, 0, 5), "logistic": lit(1, 2), "gumbel_r": lit(3, 2), "rayleigh": lit(0, 4)}
    return rounded(spark.range(100).select(((F.col("id") + 0.5) / 100).alias("q")).select("q", *[C.ppf(n, q, p).alias(n) for n, p in laws.items()]))


@query(
    "synthetic_expon",
    "WITH u AS (SELECT event_id, (event_id + 7 + 0.5) * 0.6180339887498949 - floor((event_id + 7 + 0.5) * 0.6180339887498949) AS u FROM events), p AS (SELECT avg(value) AS m FROM events) SELECT event_id, round(-m * ln(1 - u), 4) AS sample FROM u, p",
)
def synthetic_expon(spark, d):
    t = table(spark, d, "events")
    rows = t.select("event_id").crossJoin(F.broadcast(t.agg(F.avg("value").alias("m"))))  # one row
    return rounded(rows.select("event_id", C.ppf("expon", golden(F.col("event_id"), 7), [F.lit(0.0), F.col("m")]).alias("sample")), 4)


@query(
    "daily_moments",
    "SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, min(value) AS min, max(value) AS max FROM events GROUP BY 1",
)
def daily_moments(spark, d):
    return rounded(windowed_moments(table(spark, d, "events"), "value", "ts"))


# ---- what SQL cannot say: rows are counted, unit tests hold the values


@query("fit_continuous")
def fit_continuous(spark, d):
    return fitting.DistributionFitter(spark).fit(table(spark, d, "events"), column="value", estimation_method="auto").df


@query("fit_multi_column")
def fit_multi_column(spark, d):
    return fitting.DistributionFitter(spark).fit(table(spark, d, "lineitem"), columns=["l_quantity", "l_extendedprice"], max_distributions=20, prefilter=True, bounded=True).df


@query("fit_discrete")
def fit_discrete(spark, d):
    return fitting.DiscreteDistributionFitter(spark).fit(table(spark, d, "part"), column="p_size").df


def _censored(spark, d):
    return table(spark, d, "events").select(F.least("value", F.lit(100.0)).alias("time"), (F.col("value") <= 100).alias("event"))


@query("fit_censored")
def fit_censored(spark, d):
    return fitting.DistributionFitter(spark).fit(_censored(spark, d), column="time", censoring_column="event", distributions=["expon", "weibull_min", "gamma", "lognorm"]).df


@query("fit_spacings")
def fit_spacings(spark, d):
    return fitting.DistributionFitter(spark).fit(table(spark, d, "events"), column="value", estimation_method="mse", distributions=["expon", "gamma", "lognorm", "pareto", "lomax"]).df


@query("lazy_shortlist")
def lazy_shortlist(spark, d):
    found = fitting.DistributionFitter(spark).fit(table(spark, d, "events"), column="value", lazy_metrics=True).shortlist(5)
    return spark.createDataFrame([(r.distribution, r.parameters, float(r.ks_statistic)) for r in found], "distribution string, parameters array<double>, ks_statistic double")


for _n in (5, 20, 50):

    @query(f"fit_{_n}_families")
    def _fit_some(spark, d, n=_n):
        """The first families on a small table (15,000 rows at sf0.1; the published times are of 10,000)."""
        return fitting.DistributionFitter(spark).fit(table(spark, d, "customer"), column="c_acctbal", max_distributions=n).df


@query("bootstrap_intervals")
def bootstrap_intervals(spark, d):
    got = FitResult("gamma", [1.0, 0.0, 50.0]).confidence_intervals(table(spark, d, "events"), "value", n_bootstrap=1000, max_samples=None)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in got.items()], "parameter string, low double, high double")


@query("copula_sample")
def copula_sample(spark, d):
    t = table(spark, d, "lineitem")
    results = fitting.DistributionFitter(spark).fit(t, columns=["l_quantity", "l_extendedprice"], distributions=["norm", "uniform", "expon", "gamma"])
    return multivariate.GaussianCopula.fit(results, t).sample_distributed(spark, 5000)


@query("mvn_sample")
def mvn_sample(spark, d):
    return multivariate.MultivariateNormal.fit(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]).sample_distributed(spark, 5000)


@query("gmm_fit")
def gmm_fit(spark, d):
    model = multivariate.GaussianMixture.fit(table(spark, d, "events"), ["value"], 2)
    rows = [(i, float(w), float(m[0]), float(c[0, 0]), bool(model.converged), int(model.iterations)) for i, (w, m, c) in enumerate(zip(model.weights, model.means, model.covariances, strict=True))]
    return spark.createDataFrame(rows, "component int, weight double, mean double, variance double, converged boolean, iterations int")


@query("univariate_sample")
def univariate_sample(spark, d):
    from lawfinder.operators.sampling import sample_distributed

    return sample_distributed(spark, "gamma", [2.0, 0.0, 3.0], 10_000)
