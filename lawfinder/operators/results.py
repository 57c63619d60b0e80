"""What a fit returns: a table of families and columns to rank and filter, and single fitted laws."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lawfinder.functions import kernel, registry

METRICS = ("sse", "aic", "bic", "ks_statistic", "ad_statistic")
PVALUE, KS, AD = 0.05, 0.10, 2.0


@dataclass
class FitResult:
    """One fitted law."""

    distribution: str
    parameters: list[float]
    column_name: str | None = None
    sse: float = math.inf
    aic: float | None = None
    bic: float | None = None
    ks_statistic: float | None = None
    pvalue: float | None = None
    ad_statistic: float | None = None
    ad_pvalue: float | None = None
    data: dict[str, Any] = field(default_factory=dict)
    lower_bound: float | None = None
    upper_bound: float | None = None
    sample: np.ndarray | None = None

    @classmethod
    def of(cls, row, sample=None) -> FitResult:
        d = row.asDict()
        own = {k: d.get(k) for k in ("distribution", "column_name", *METRICS, "pvalue", "ad_pvalue", "lower_bound", "upper_bound")}
        return cls(parameters=list(d["parameters"]), data={k: v for k, v in d.items() if k.startswith("data_")}, sample=sample, **own)

    @property
    def law(self):
        return registry.get_law(self.distribution)

    def frozen(self):
        """The law with its parameters, cut to the bounds if there are any (discrete laws have no densities)."""
        if hasattr(self.law, "pmf"):
            return None
        return kernel.Truncated(self.law, self.parameters, self.lower_bound, self.upper_bound)

    def get_param_names(self) -> list[str]:
        return list(self.law.names)

    def pdf(self, x):
        if hasattr(self.law, "pmf"):
            return self.pmf(x)
        return self.frozen().pdf(np.asarray(x, float))

    def pmf(self, x):
        p, (a, b) = self.law.pmf(np.asarray(x, float), *self.parameters), self._ends()
        x = np.asarray(x, float)
        inside = (x >= (self.lower_bound if self.lower_bound is not None else -math.inf)) & (x <= (self.upper_bound if self.upper_bound is not None else math.inf))
        return np.where(inside, p / (b - a), 0.0)

    def _ends(self):
        a = float(self.law.cdf(np.array([self.lower_bound - 1.0]), *self.parameters)[0]) if self.lower_bound is not None else 0.0
        b = float(self.law.cdf(np.array([float(self.upper_bound)]), *self.parameters)[0]) if self.upper_bound is not None else 1.0
        return a, b

    def cdf(self, x):
        if hasattr(self.law, "pmf"):
            a, b = self._ends()
            return np.clip((self.law.cdf(np.asarray(x, float), *self.parameters) - a) / (b - a), 0, 1)
        return self.frozen().cdf(np.asarray(x, float))

    def ppf(self, q):
        if hasattr(self.law, "pmf"):
            a, b = self._ends()
            return self.law.ppf(a + np.asarray(q, float) * (b - a), *self.parameters)
        return self.frozen().ppf(np.asarray(q, float))

    def sample_values(self, size: int = 1000, random_state: int | None = None):
        return self.ppf(np.random.default_rng(random_state).random(size))

    def to_dict(self) -> dict:
        return {k: getattr(self, k) for k in ("column_name", "distribution", "parameters", *METRICS, "pvalue", "ad_pvalue", "lower_bound", "upper_bound")} | self.data

    def pdf_range(self) -> tuple[float, float]:
        """The 1 and 99 percent quantiles, or the data's range where they are not finite."""
        a, b = (float(v) for v in self.ppf(np.array([0.01, 0.99])))
        return (a, b) if math.isfinite(a) and math.isfinite(b) and a < b else (self.data.get("data_min"), self.data.get("data_max"))

    def confidence_intervals(self, df: DataFrame, column: str, alpha: float = 0.05, n_bootstrap: int = 200, max_samples: int | None = 10_000, random_seed: int | None = 42) -> dict[str, tuple[float, float]]:
        from lawfinder.operators.bootstrap import intervals

        return intervals(self, df, column, alpha, n_bootstrap, max_samples, random_seed)

    def save(self, path: str) -> None:
        from lawfinder.sources.models import save

        save(self, path)

    @classmethod
    def load(cls, path: str) -> FitResult:
        from lawfinder.sources.models import load

        return load(path)


class FitResults:
    """The fitted families of one or more columns, as a DataFrame with helpers.

    Where metrics were left for later (``lazy``), K-S and A-D are computed for the rows that are asked for.
    """

    def __init__(self, df: DataFrame, samples: dict[str, np.ndarray] | None = None, discrete: bool = False, lazy: dict | None = None):
        self._df, self.samples, self.discrete, self.lazy = df, samples or {}, discrete, lazy

    @property
    def df(self) -> DataFrame:
        return self._df

    @property
    def is_lazy(self) -> bool:
        return self.lazy is not None

    def _like(self, df: DataFrame) -> FitResults:
        return FitResults(df, self.samples, self.discrete, self.lazy)

    def filter(self, **limits: float) -> FitResults:
        """Rows under each threshold (``sse_threshold=...``, also aic, bic, ks, ad), and above ``pvalue_threshold``."""
        df = self.materialize()._df if self.is_lazy and {"ks_threshold", "ad_threshold", "pvalue_threshold"} & set(limits) else self._df
        columns = {"sse": "sse", "aic": "aic", "bic": "bic", "ks": "ks_statistic", "ad": "ad_statistic"}
        for key, limit in limits.items():
            if limit is None:
                continue
            name = key.removesuffix("_threshold")
            df = df.where(F.col("pvalue") > limit) if name == "pvalue" else df.where(F.col(columns[name]) < limit)
        return self._like(df)

    def for_column(self, name: str) -> FitResults:
        return self._like(self._df.where(F.col("column_name") == name))

    @property
    def column_names(self) -> list[str]:
        return sorted(r[0] for r in self._df.where("column_name IS NOT NULL").select("column_name").distinct().collect())

    def best(self, n: int = 1, metric: str = "ks_statistic", warn_if_poor: bool = False, pvalue_threshold: float = PVALUE) -> list[FitResult]:
        """The ``n`` rows with the smallest metric over all columns, nulls last."""
        if n <= 0 or metric not in METRICS:
            raise ValueError(f"n must be positive and metric one of {', '.join(METRICS)}")
        held = self.materialize() if self.is_lazy and metric in ("ks_statistic", "ad_statistic") else self
        rows = held._df.orderBy(F.col(metric).asc_nulls_last(), "distribution").limit(n).collect()
        found = [FitResult.of(r, self.samples.get(r.column_name)) for r in rows]
        if warn_if_poor and found and found[0].pvalue is not None and found[0].pvalue < pvalue_threshold:
            warnings.warn(f"the best fit, {found[0].distribution}, has a p-value of {found[0].pvalue:.3g}", UserWarning, stacklevel=2)
        return found

    def best_per_column(self, n: int = 1, metric: str = "ks_statistic") -> dict[str, list[FitResult]]:
        """The ``n`` best rows of each column, in one plan."""
        held = self.materialize() if self.is_lazy and metric in ("ks_statistic", "ad_statistic") else self
        w = Window.partitionBy("column_name").orderBy(F.col(metric).asc_nulls_last(), "distribution")
        out: dict[str, list[FitResult]] = {}
        for r in held._df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).orderBy("column_name", "_rank").collect():
            out.setdefault(r.column_name, []).append(FitResult.of(r, self.samples.get(r.column_name)))
        return out

    def shortlist(self, n: int, metric: str = "ks_statistic") -> list[FitResult]:
        """Like ``best`` on lazy results, but only each column's 3 n + 5 best rows by AIC get their metrics (ties by name, nulls last)."""
        w = Window.partitionBy("column_name").orderBy(F.col("aic").asc_nulls_last(), "distribution")
        few = self._df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= 3 * n + 5).drop("_rank")
        return self._like(few).best(n, metric)

    def materialize(self) -> FitResults:
        """All metrics computed, by tasks over the rows."""
        if not self.is_lazy:
            return self
        import pandas as pd

        spark, schema = self._df.sparkSession, self._df.schema
        sent, custom = spark.sparkContext.broadcast(self.lazy), registry.get_custom_distributions()

        def run(batches):
            data = sent.value
            for pdf in batches:
                for i, r in pdf.iterrows():
                    p, law = data[r.column_name], custom.get(r.distribution) or registry.get_law(r.distribution)
                    low, high = p["low"], p["high"]
                    if p["discrete"]:
                        s = kernel.score_discrete(law, r.parameters, p["values"], p["counts"], True, low, high)
                    else:
                        s = kernel.score(law, list(r.parameters), p["x"], p["density"], p["edges"], True, low, high, p["event"])
                    for k in ("ks_statistic", "pvalue", "ad_statistic", "ad_pvalue"):
                        pdf.loc[i, k] = s.get(k)
                yield pdf.astype({k: "float64" for k in ("ks_statistic", "pvalue", "ad_statistic", "ad_pvalue")})

        held = self._df.repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, schema).toPandas()
        rows = [tuple(list(v) if k == "parameters" else None if not isinstance(v, str) and pd.isna(v) else v for k, v in r.items()) for r in held.to_dict("records")]
        return FitResults(spark.createDataFrame(rows, schema), self.samples, self.discrete)

    def summary(self) -> DataFrame:
        """Least, mean and largest value of each metric, and the number of rows."""
        each = [f(c).alias(f"{n}_{c}") for c in ("sse", "aic", "ks_statistic", "pvalue", "ad_statistic") for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
        return self._df.agg(*each, F.count("*").alias("total_distributions"))

    def acceptable(self) -> DataFrame:
        return self._df.where((F.col("pvalue") >= PVALUE) & (F.col("ks_statistic") <= KS) & (F.col("ad_statistic").isNull() | (F.col("ad_statistic") <= AD)))

    def quality_report(self, n: int = 5) -> dict:
        held = self.materialize()
        top, good = held.best(n), held.acceptable().count()
        notes = []
        if top:
            if top[0].pvalue is not None and top[0].pvalue < PVALUE:
                notes.append(f"the best fit has a low p-value ({top[0].pvalue:.3g})")
            if top[0].ks_statistic is not None and top[0].ks_statistic > KS:
                notes.append(f"the best fit has a high K-S statistic ({top[0].ks_statistic:.3g})")
            if top[0].ad_statistic is not None and top[0].ad_statistic > AD:
                notes.append(f"the best fit has a high A-D statistic ({top[0].ad_statistic:.3g})")
        if good == 0:
            notes.append("no family is acceptable")
        elif good < 3:
            notes.append(f"only {good} families are acceptable")
        return {"top": top, "summary": held.summary().first().asDict(), "n_acceptable": good, "warnings": notes}

    def count(self) -> int:
        return self._df.count()

    def __len__(self) -> int:
        return self.count()

    def unpersist(self, blocking: bool = False) -> FitResults:
        self._df.unpersist(blocking)
        return self
