"""Fitting many families to many columns: one grid of (column, family) tasks over a bounded sample.

Counts, moments, extremes and histograms are taken over all rows, in two aggregates for all columns
together; the result's data_* columns, the prefilter, the heavy-tail rule and SSE are about these, whatever is sampled. The iterative
estimates and the other scores of continuous families read a sample of ``fitting_sample_size`` rows: those with the smallest hashes of the row's
values and of its place in the input's files (so that equal values do not share a fate); columns of a row stay together.
Where that size takes in all rows, nothing is thinned, and families with closed forms are fitted and scored in the plan, so
that the driver holds none of the rows for them.
Discrete families are fitted and scored on all rows, by the counts of their distinct values.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawfinder.config import FitterConfig
from lawfinder.functions import kernel, registry
from lawfinder.functions.laws import HEAVY, POSITIVE_SKEW, SLOW
from lawfinder.operators import closed
from lawfinder.operators.results import FitResults
from lawfinder.operators.stats import binned, check_columns, histogram, long_frame

#: Distinct values of a discrete column whose counts, 16 bytes each, go to all tasks.
MOST_VALUES = 1_000_000
#: Values of a column that a result carries as its sample, where it is fitted by counts or in the plan.
SHOWN = 10_000
#: Families for which the tasks' estimates are those of the plan.
IN_PLAN = ("norm", "expon", "uniform", "laplace", "halfnorm")

_DOUBLES = "sse aic bic ks_statistic pvalue ad_statistic ad_pvalue data_min data_max data_mean data_stddev".split()
RESULT_SCHEMA = T.StructType(
    [T.StructField("column_name", T.StringType()), T.StructField("distribution", T.StringType()), T.StructField("parameters", T.ArrayType(T.DoubleType()))]
    + [T.StructField(n, T.DoubleType()) for n in _DOUBLES]
    + [T.StructField("data_count", T.LongType())]
    + [T.StructField(n, T.DoubleType()) for n in ("data_kurtosis", "data_skewness", "lower_bound", "upper_bound")]
)


def resolve_bounds(config: FitterConfig, columns: Sequence[str], stats: dict[str, dict]) -> dict[str, tuple[float | None, float | None]]:
    """Each column's bounds; with ``bounded`` a side that is not given comes from the data."""
    if not config.bounded:
        return dict.fromkeys(columns, (None, None))
    for side in (config.lower_bound, config.upper_bound):
        if isinstance(side, dict) and set(side) - set(columns):
            raise ValueError(f"bounds for unknown columns: {sorted(set(side) - set(columns))}")
    out = {}
    for c in columns:
        pick = lambda side, d: d if side is None else side.get(c, d) if isinstance(side, dict) else side  # noqa: B023, E731
        low, high = pick(config.lower_bound, stats[c]["data_min"]), pick(config.upper_bound, stats[c]["data_max"])
        if low >= high:
            raise ValueError(f"column {c!r}: lower bound {low} is not below upper bound {high}")
        out[c] = (float(low), float(high))
    return out


def _mark(columns: Sequence[str], seed: int) -> Column:
    """A hash of 63 bits."""
    hashed = F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *[F.col(f"`{c}`") for c in columns])
    return hashed.bitwiseAND(F.lit((1 << 63) - 1))


def below(share: float) -> int:
    """The mark below which that share of all rows lies."""
    return min((1 << 63) - 1, int(share * (1 << 63)))


def sampled(df: DataFrame, columns: Sequence[str], n: int, size: int, seed: int, keep: Sequence[str] = ()) -> DataFrame:
    """``size`` of ``n`` rows (all if there are no more): those with the smallest hashes of their values and the seed."""
    if n <= size:
        return df.select(*[F.col(f"`{c}`") for c in [*columns, *keep]])
    # few more than are wanted reach the sort, whatever n is
    some = df.select(*[F.col(f"`{c}`") for c in [*columns, *keep]], _mark(columns, seed).alias("_mark"))
    return some.where(F.col("_mark") <= below((size + 8 * math.sqrt(size) + 20) / n)).orderBy("_mark").limit(size).drop("_mark")


def thinned(df: DataFrame, columns: Sequence[str], n: int, size: int, seed: int) -> DataFrame:
    """About ``size`` of ``n`` rows, wherever they lie."""
    return df if n <= size else df.where(_mark(columns, seed) <= below(size / n))


def stratified(df: DataFrame, column: str, n: int, size: int, strata: int, seed: int, tail: int = 500) -> DataFrame:
    """A sample by quantile strata, in which the outer strata have ``tail`` rows at least, where they have them."""
    cuts = sorted(set(df.where(F.col(f"`{column}`").isNotNull()).approxQuantile(column, [i / strata for i in range(1, strata)], 0.01)))
    if len(cuts) < 2:
        return thinned(df, [column], n, size, seed)
    at = F.lit(0)
    for c in cuts:
        at = at + (F.col(f"`{column}`") > c).cast("int")
    marked = df.withColumn("_stratum", F.coalesce(at, F.lit(0)))
    sizes = {r["_stratum"]: r["count"] for r in marked.groupBy("_stratum").count().collect()}
    most = F.lit(0).cast("long")
    for s, share in stratum_shares(sizes, size / n, tail).items():
        most = F.when(F.col("_stratum") == s, F.lit(below(share))).otherwise(most)
    return marked.where(_mark([column], seed) <= most).drop("_stratum")


def stratum_shares(sizes: dict[int, int], base: float, tail: int) -> dict[int, float]:
    """What share of each stratum is taken: ``base``, of the first and last one as much as gives ``tail`` rows."""
    ends = (min(sizes), max(sizes))
    return {s: min(1.0, max(base, tail / k) if s in ends else base) for s, k in sizes.items()}


def strategy(skewness: float, mild: float = 0.5, high: float = 2.0) -> tuple[str, int]:
    """How to sample: uniformly, or by 5 or 10 strata."""
    s = abs(skewness) if math.isfinite(skewness) else 0.0
    return ("uniform", 0) if s < mild else ("stratified", 10 if s >= high else 5)


def prefiltered(names: Sequence[str], skewness: float, kurtosis: float, mode: bool | str) -> list[str]:
    """Candidates that the data's shape does not rule out; all of them if none were left."""
    if not mode:
        return list(names)
    out = [n for n in names if not (skewness < -1 and n in POSITIVE_SKEW)]
    if mode == "aggressive" and kurtosis > 10:
        out = [n for n in out if n != "uniform"]
    return out or list(names)


def _samples(df: DataFrame, columns: Sequence[str], config: FitterConfig, n_rows: int, size: int) -> dict[str, dict]:
    """Each column's sample."""
    keep = [config.censoring_column] if config.censoring_column else []
    rows = sampled(df, columns, n_rows, size, config.random_seed, keep).toPandas()
    out = {}
    for c in columns:
        x = pd.to_numeric(rows[c], errors="coerce").to_numpy(float)
        good = np.isfinite(x)
        event = None
        if keep:
            good &= rows[keep[0]].notna().to_numpy()
            event = rows[keep[0]].fillna(False).astype(bool).to_numpy()[good]
        out[c] = {"x": x[good], "event": event}
    return out


def _counted(rows: DataFrame, columns: Sequence[str], config: FitterConfig, stats: dict[str, dict]) -> dict[str, dict]:
    """The distinct values of whole-number columns with their counts, over all rows.

    A column with more than MOST_VALUES of them gives those of a sample of ``fitting_sample_size`` rows instead.
    """
    count = rows.groupBy("column_name", "value").agg(F.count("*").cast("double").alias("n"))
    many = {r.column_name for r in count.groupBy("column_name").count().where(F.col("count") > MOST_VALUES).collect()}
    pdf = count.where(~F.col("column_name").isin(*many)).toPandas() if many else count.toPandas()
    for c in many:
        some = sampled(rows.where(F.col("column_name") == c), ["value"], stats[c]["n"], config.fitting_sample_size, config.random_seed, ["column_name"]).toPandas()
        pdf = pd.concat([pdf, some.groupby(["column_name", "value"], as_index=False).agg(n=("value", "size"))])
    out = {}
    for c in columns:
        mine = pdf[pdf.column_name == c].sort_values("value")
        values, counts = mine.value.to_numpy(float), mine.n.to_numpy(float)
        upto = np.cumsum(counts)
        size = int(min(SHOWN, upto[-1]))
        out[c] = {"values": values, "counts": counts, "x": values[np.searchsorted(upto, (np.arange(size) + 0.5) / size * upto[-1])], "event": None}
    return out


def _described(stats: dict) -> dict:
    """The result's data_* columns, of all rows."""
    real = lambda v: math.nan if v is None else float(v)
    return {"data_count": stats["n"]} | {f"data_{k}": real(stats[f"data_{k}"]) for k in ("min", "max", "mean", "stddev", "kurtosis", "skewness")}


def heavy_tailed(stats: dict, edges: np.ndarray, density: np.ndarray) -> bool:
    """By all rows: excess kurtosis above 6, or the largest value above 3 times a positive 99th percentile; under 10 values never.

    The percentile is read off the histogram, which lays a bin's values out evenly.
    """
    if stats["n"] < 10 or not stats["data_stddev"] or len(edges) < 2:
        return False
    p99 = float(np.interp(0.99, np.concatenate([[0.0], np.cumsum(density * np.diff(edges))]), edges))
    return (stats["data_kurtosis"] or 0.0) > 6 or (p99 > 0 and stats["data_max"] / p99 > 3)


def failed(column: str, name: str, base: dict) -> dict:
    return base | {"column_name": column, "distribution": name, "parameters": [math.nan], "sse": math.inf, "aic": math.inf, "bic": math.inf, "ks_statistic": math.inf, "pvalue": 0.0, "ad_statistic": math.inf, "ad_pvalue": None}


def fit_one(column: str, name: str, law, payload: dict, method: str, metrics: bool) -> dict:
    """One family on one column; whatever goes wrong gives the row that ranks last."""
    x, base = payload["x"], payload["moments"] | {"lower_bound": payload["low"], "upper_bound": payload["high"]}
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            if payload["discrete"]:
                values, counts = payload["values"], payload["counts"]
                p = kernel.fit_discrete(law, values, counts)
                out = kernel.score_discrete(law, p, values, counts, metrics, payload["low"], payload["high"])
            else:
                event = payload["event"]
                if event is not None:
                    p = kernel.fit_censored(law, x, event)
                elif method == "mse":
                    try:
                        p = kernel.fit_mse(law, x)
                    except Exception:
                        p = kernel.fit_mle(law, x)
                else:
                    p = kernel.fit_mle(law, x)
                out = kernel.score(law, p, x, payload["density"], payload["edges"], metrics, payload["low"], payload["high"], event)
        if not np.isfinite(p).all() or not math.isfinite(out["sse"]):
            return failed(column, name, base)
        blank = dict.fromkeys(("ks_statistic", "pvalue", "ad_statistic", "ad_pvalue"))
        return blank | base | out | {"column_name": column, "distribution": name, "parameters": [float(v) for v in p]}
    except Exception:
        return failed(column, name, base)


def fitted_in_plan(rows: DataFrame, tasks: Sequence[tuple[str, str]], payload: dict[str, dict]) -> list[dict]:
    """The result's rows of families with closed forms, of all rows: parameters, likelihoods and distances from the plan."""
    columns, families = sorted({c for c, _ in tasks}), tuple(n for n in IN_PLAN if any(n == t for _, t in tasks))
    if not families:
        return []
    mine = rows.where(F.col("column_name").isin(columns))
    fits = closed.closed_fits(mine, families)
    fits = rows.sparkSession.createDataFrame(fits.collect(), fits.schema)  # columns times families, worked out once
    keys = ["column_name", "distribution"]
    scored = fits.join(closed.distances(mine, fits.select(*keys, "parameters"), families), keys)
    asked, out = set(tasks), []
    for r in scored.collect():
        if (r.column_name, r.distribution) in asked:
            p, law = payload[r.column_name], registry.get_law(r.distribution)
            out.append(
                {"column_name": r.column_name, "distribution": r.distribution, "parameters": list(r.parameters), "lower_bound": None, "upper_bound": None, "aic": r.aic, "bic": r.bic, "ks_statistic": r.ks_statistic, "ad_statistic": r.ad_statistic}
                | {"sse": kernel.sse(lambda v: law.cdf(v, *r.parameters), p["density"], p["edges"]), "pvalue": kernel.ks_pvalue(r.n, r.ks_statistic), "ad_pvalue": kernel.ad_pvalue(r.distribution, r.ad_statistic, r.n)}  # noqa: B023
                | p["moments"]
            )
    return sorted(out, key=lambda r: tasks.index((r["column_name"], r["distribution"])))


class _Fitter:
    discrete = False

    def __init__(self, spark: SparkSession | None = None, excluded_distributions: Iterable[str] | None = None, random_seed: int = 42):
        self.spark = spark or SparkSession.getActiveSession()
        if self.spark is None:
            raise RuntimeError("there is no active Spark session")
        self.excluded, self.random_seed = excluded_distributions, random_seed

    def candidates(self, config: FitterConfig) -> list[str]:
        if self.discrete:
            return registry.discrete_names(self.excluded, config.max_distributions)
        return registry.continuous_names(self.excluded, config.support_at_zero, config.max_distributions)

    def fit(self, df: DataFrame, column: str | None = None, columns: Sequence[str] | None = None, config: FitterConfig | None = None, progress_callback: Callable | None = None, distributions: Sequence[str] | None = None, **settings) -> FitResults:
        """Fit all candidate families to the columns; the answer's rows are computed once and held in memory.

        distributions: names to try instead of the candidates. progress_callback: called with (done, total,
        percent) while the tasks run.
        """
        config = config or FitterConfig(random_seed=self.random_seed, **settings)
        names = check_columns(df, column, columns)
        if config.censoring_column:
            if self.discrete or len(names) > 1:
                raise ValueError("censoring takes one continuous column")
            kinds = dict(df.dtypes)
            if config.censoring_column not in kinds:
                raise ValueError(f"no column {config.censoring_column!r}")
            if kinds[config.censoring_column] not in ("boolean", "int", "bigint"):
                raise TypeError("the censoring column must be boolean or a whole number (1: the event was observed)")
        rows = long_frame(df, names, discrete=self.discrete)
        v = F.col("value")
        moments = [f(v).alias(f"data_{n}") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("stddev", F.stddev_pop), ("kurtosis", F.kurtosis), ("skewness", F.skewness))]
        stats = {r.column_name: r.asDict() for r in rows.groupBy("column_name").agg(F.count("*").alias("n"), *moments).collect()}
        if not stats:
            if df.limit(1).count() == 0:
                raise ValueError("the table is empty")
            return FitResults(self.spark.createDataFrame([], RESULT_SCHEMA), {}, self.discrete)
        present = [c for c in names if c in stats]
        bounds = resolve_bounds(config, present, stats)
        if self.discrete:
            payload = _counted(rows, present, config, stats)
        else:
            payload = {c: {"cells": {}} for c in present}
            if isinstance(config.bins, int):
                cells = binned(rows, {c: (s["data_min"], s["data_max"], self._bins(s, config)) for c, s in stats.items()})
            else:
                cells = histogram(rows, edges=config.bins).select("column_name", "bin_id", "n")
            for r in cells.collect():
                payload[r.column_name]["cells"][r.bin_id] = r.n
        for c, p in payload.items():
            self._complete(c, p, stats[c], bounds[c], config)
        tasks, planned = self._tasks(payload, config, distributions), []
        if not self.discrete:
            n_rows, size, some = max(s["n"] for s in stats.values()), config.fitting_sample_size, df
            if n_rows <= size:
                planned = self._planned(tasks, payload, stats, config, n_rows)
                if len(planned) == len(tasks):
                    size = SHOWN
            elif config.enable_sampling and n_rows > config.sample_threshold:
                some, n_rows = self._down(df, present, stats, config, n_rows)
            for c, p in _samples(some, present, config, n_rows, size).items():
                payload[c] |= p
        tasks = [t for t in tasks if t not in set(planned) and len(payload[t[0]]["x"])]
        out = self._run(tasks, payload, not config.lazy_metrics, config, progress_callback, rows, planned)
        return FitResults(out, {c: p["x"] for c, p in payload.items()}, self.discrete, payload if config.lazy_metrics else None)

    @staticmethod
    def _planned(tasks, payload, stats, config, n_rows):
        """The tasks of closed forms, where all rows are asked for and these are more than a sample that is held anyway."""
        if n_rows <= SHOWN or config.censoring_column or config.bounded or config.lazy_metrics:
            return []
        return [(c, n) for c, n in tasks if n in IN_PLAN and payload[c]["method"] == "mle" and stats[c]["data_stddev"] > 0]

    @staticmethod
    def _bins(stats: dict, config: FitterConfig) -> int:
        if stats["data_min"] == stats["data_max"]:
            return 1
        return max(2, math.ceil(round(stats["n"] ** (1 / 3), 9)) * 2) if config.use_rice_rule else max(2, config.bins)

    def _down(self, df, columns, stats, config, n_rows):
        """The rows from which the fitting sample is drawn, where there are very many: of a skewed column its strata."""
        target = max(1, round(n_rows * config.sample_fraction)) if config.sample_fraction else min(config.max_sample_size, round(0.35 * n_rows))
        worst = max(columns, key=lambda c: abs(stats[c]["data_skewness"] or 0))
        how, strata = strategy(stats[worst]["data_skewness"] or 0.0, config.skew_threshold_mild, config.skew_threshold_high)
        if how == "stratified" and config.adaptive_sampling:
            return stratified(df, worst, n_rows, target, strata, config.random_seed), target
        return thinned(df, columns, n_rows, target, config.random_seed), target

    def _complete(self, column, p, stats, bounds, config):
        p |= {"moments": _described(stats), "low": bounds[0], "high": bounds[1], "discrete": self.discrete, "method": config.estimation_method}
        if self.discrete:
            return
        if isinstance(config.bins, int):
            edges = np.linspace(stats["data_min"], stats["data_max"], self._bins(stats, config) + 1)
        else:
            edges = np.array(config.bins, float)
        cells = p.pop("cells")
        density = np.array([cells.get(i, 0) for i in range(len(edges) - 1)], float)
        density /= max(density.sum(), 1) * np.where(np.diff(edges) > 0, np.diff(edges), 1)
        if stats["data_min"] == stats["data_max"]:
            edges, density = np.array([stats["data_min"]]), np.array([1.0])
        p |= {"density": density, "edges": edges}
        if heavy_tailed(stats, edges, density):
            if config.estimation_method == "auto":
                p["method"] = "mse"
            elif config.estimation_method == "mle":
                warnings.warn(f"column {column!r} looks heavy-tailed; estimation_method='mse' is more robust for {', '.join(sorted(HEAVY)[:4])} and their like", UserWarning, stacklevel=4)
        if p["method"] == "auto":
            p["method"] = "mle"

    def _tasks(self, payload, config, distributions):
        names = list(distributions) if distributions is not None else self.candidates(config)
        for n in names:
            registry.get_law(n)
        out = []
        for c, p in payload.items():
            m = p["moments"]
            mine = names if self.discrete else prefiltered(names, m["data_skewness"], m["data_kurtosis"], config.prefilter)
            out += [(c, n) for n in registry.interleaved(mine)]
        return out

    def _run(self, tasks, payload, metrics, config, progress_callback, all_rows, planned):
        from lawfinder.progress import tracked

        spark = self.spark
        with tracked(spark, len(tasks) + len(planned), progress_callback):
            held = fitted_in_plan(all_rows, planned, payload) + (self._fitted(tasks, payload, metrics, config) if tasks else [])
        rows = []
        for r in held:
            rows.append(tuple(list(r[k]) if k == "parameters" else None if k in ("ks_statistic", "pvalue", "ad_statistic", "ad_pvalue", "lower_bound", "upper_bound") and pd.isna(r[k]) else r[k] for k in RESULT_SCHEMA.names))
        return spark.createDataFrame(rows, RESULT_SCHEMA)

    def _fitted(self, tasks, payload, metrics, config):
        spark = self.spark
        custom = {n: x for n, x in registry.get_custom_distributions().items() if any(n == t for _, t in tasks)}
        sent = spark.sparkContext.broadcast(payload)
        cores = spark.sparkContext.defaultParallelism
        parts = config.num_partitions or registry.task_count(len(tasks), sum(n in SLOW for _, n in tasks), cores)
        # dealt like cards, so that slow families do not share a task
        grid = spark.createDataFrame(spark.sparkContext.parallelize([t for i in range(parts) for t in tasks[i::parts]], parts), "column_name string, distribution string")

        def run(batches):
            data = sent.value
            for pdf in batches:
                rows = [fit_one(c, n, custom.get(n) or registry.get_law(n), data[c], data[c]["method"], metrics) for c, n in zip(pdf.column_name, pdf.distribution, strict=True)]
                yield pd.DataFrame(rows, columns=RESULT_SCHEMA.names).astype({"data_count": "int64"})

        return grid.mapInPandas(run, RESULT_SCHEMA).where(F.col("sse") < float("inf")).toPandas().to_dict("records")


class DistributionFitter(_Fitter):
    """Fits continuous families."""

    register_distribution = staticmethod(registry.register_distribution)
    unregister_distribution = staticmethod(registry.unregister_distribution)
    get_custom_distributions = staticmethod(registry.get_custom_distributions)


class DiscreteDistributionFitter(_Fitter):
    """Fits families of whole numbers; other values are cut towards zero first. Rank by AIC."""

    discrete = True
