"""Gaussian copula, multivariate normal and Gaussian mixture: fitted by aggregates, drawn and evaluated as plans."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lawfinder.functions import columns as C
from lawfinder.functions import registry
from lawfinder.operators.sampling import quantile, uniform
from lawfinder.operators.stats import correlation, covariance

RIDGE = 1e-10


def cholesky(m: np.ndarray) -> np.ndarray:
    """With a growing ridge where the matrix is not quite positive definite."""
    ridge = 0.0
    for _ in range(12):
        try:
            return np.linalg.cholesky(m + ridge * np.eye(len(m)))
        except np.linalg.LinAlgError:
            ridge = max(RIDGE, ridge * 10)
    raise ValueError("the matrix is not positive definite")


def correlated_normals(spark: SparkSession, n: int, low: np.ndarray, seed: int, parts: int | None) -> tuple[DataFrame, list[Column]]:
    """A frame with independent normals z0, z1, ... and the columns that the factor ``low`` makes of them."""
    d = len(low)
    rows = spark.range(0, n, 1, parts or spark.sparkContext.defaultParallelism)
    rows = rows.select("id", *[C.normal_quantile(uniform(seed, F.col("id"), i)).alias(f"z{i}") for i in range(d)])
    mixed = [sum((F.col(f"z{j}") * float(low[i, j]) for j in range(i + 1) if low[i, j]), F.lit(0.0)) for i in range(d)]
    return rows, mixed


@dataclass
class GaussianCopula:
    column_names: list[str]
    marginals: dict[str, tuple[str, list[float]]]
    correlation: np.ndarray
    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    @classmethod
    def fit(cls, results, df: DataFrame, columns: Sequence[str] | None = None, metric: str = "ks_statistic", convert: bool = False) -> GaussianCopula:
        """Best marginal of each column and the Spearman matrix of the data.

        convert: turn rank correlations into those of the normals by 2 sin(pi r / 6) instead of using them as such.
        """
        names = list(columns or results.column_names)
        if len(names) < 2:
            raise ValueError("a copula takes two columns at least")
        best = results.best_per_column(1, metric)
        if missing := [c for c in names if c not in best]:
            raise ValueError(f"no fit for {missing}")
        m = np.eye(len(names))
        for r in correlation(df, names).collect():
            m[names.index(r.column_a), names.index(r.column_b)] = r.correlation
        if convert:
            m = 2 * np.sin(np.pi * m / 6)
            np.fill_diagonal(m, 1.0)
        return cls(names, {c: (best[c][0].distribution, best[c][0].parameters) for c in names}, m, {c: (best[c][0].lower_bound, best[c][0].upper_bound) for c in names})

    def sample(self, n: int, random_state: int | None = None, return_uniform: bool = False) -> dict[str, np.ndarray]:
        from lawfinder.functions.kernel import Truncated
        from lawfinder.functions.special import ndtr

        z = np.random.default_rng(random_state).standard_normal((n, len(self.column_names))) @ cholesky(self.correlation).T
        u = np.clip(ndtr(z), 1e-15, 1 - 1e-15)
        if return_uniform:
            return {c: u[:, i] for i, c in enumerate(self.column_names)}
        out = {}
        for i, c in enumerate(self.column_names):
            name, p = self.marginals[c]
            law, (a, b) = registry.get_law(name), self.bounds.get(c, (None, None))
            out[c] = law.ppf(u[:, i], *p) if (a is None and b is None) or hasattr(law, "pmf") else Truncated(law, p, a, b).ppf(u[:, i])
        return out

    def sample_distributed(self, spark: SparkSession, n: int, num_partitions: int | None = None, random_seed: int = 42, return_uniform: bool = False) -> DataFrame:
        rows, mixed = correlated_normals(spark, n, cholesky(self.correlation), random_seed, num_partitions)
        rows = rows.select(*[m.alias(f"y{i}") for i, m in enumerate(mixed)])
        rows = rows.select(*[F.least(F.greatest(C.phi(F.col(f"y{i}")), F.lit(1e-12)), F.lit(1 - 1e-12)).alias(c) for i, c in enumerate(self.column_names)])
        if return_uniform:
            return rows
        out = []
        for c in self.column_names:
            name, p = self.marginals[c]
            a, b = self.bounds.get(c, (None, None))
            u = F.col(f"`{c}`")
            if (a is not None or b is not None) and not hasattr(registry.get_law(name), "pmf"):
                law = registry.get_law(name)
                fa = float(law.cdf(np.array([a]), *p)[0]) if a is not None else 0.0
                fb = float(law.cdf(np.array([b]), *p)[0]) if b is not None else 1.0
                u = fa + u * (fb - fa)
            out.append(quantile(name, p, u).alias(c))
        return rows.select(*out)


@dataclass
class MultivariateNormal:
    column_names: list[str]
    mean: np.ndarray
    covariance: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], ddof: int = 1) -> MultivariateNormal:
        """Means and covariances in one aggregate; rows with a null in any column are left out."""
        names = list(columns)
        if len(names) < 2:
            raise ValueError("give two columns at least")
        mean, cov = np.zeros(len(names)), np.zeros((len(names),) * 2)
        for r in covariance(df, names, ddof).collect():
            if r.covariance is None:
                raise ValueError("there are too few rows")
            cov[names.index(r.column_a), names.index(r.column_b)] = r.covariance
            mean[names.index(r.column_a)] = r.mean_a
        if np.linalg.cond(cov) > 1e10:
            warnings.warn("the covariance matrix is nearly singular", UserWarning, stacklevel=2)
        return cls(names, mean, cov)

    def _inverse(self) -> np.ndarray:
        low = cholesky(self.covariance)
        half = np.linalg.inv(low)
        return half.T @ half

    def mahalanobis_squared(self, columns: Sequence[str] | None = None) -> Column:
        inv, off = self._inverse(), [F.col(f"`{c}`") - float(m) for c, m in zip(columns or self.column_names, self.mean, strict=True)]
        terms = [off[i] * off[j] * float(inv[i, j] * (1 if i == j else 2)) for i in range(len(off)) for j in range(i, len(off))]
        return sum(terms[1:], terms[0])

    def mahalanobis(self, columns: Sequence[str] | None = None) -> Column:
        return F.sqrt(F.greatest(self.mahalanobis_squared(columns), F.lit(0.0)))

    def logpdf(self, columns: Sequence[str] | None = None) -> Column:
        _, logdet = np.linalg.slogdet(self.covariance)
        return -0.5 * (self.mahalanobis_squared(columns) + float(logdet + len(self.mean) * math.log(2 * math.pi)))

    def pdf(self, columns: Sequence[str] | None = None) -> Column:
        return F.exp(self.logpdf(columns))

    def correlation_matrix(self) -> np.ndarray:
        sd = np.sqrt(np.diag(self.covariance))
        return self.covariance / np.outer(sd, sd)

    def sample(self, n: int, random_state: int | None = None) -> np.ndarray:
        return self.mean + np.random.default_rng(random_state).standard_normal((n, len(self.mean))) @ cholesky(self.covariance).T

    def sample_distributed(self, spark: SparkSession, n: int, num_partitions: int | None = None, random_seed: int = 42) -> DataFrame:
        rows, mixed = correlated_normals(spark, n, cholesky(self.covariance), random_seed, num_partitions)
        return rows.select(*[(m + float(mu)).alias(c) for m, mu, c in zip(mixed, self.mean, self.column_names, strict=True)])


@dataclass
class GaussianMixture:
    """Full-covariance mixture. Each EM round is one aggregate of responsibilities' sums over all rows."""

    column_names: list[str]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = -math.inf
    n: int = 0
    iterations: int = 0
    converged: bool = False

    def _parts(self, columns: Sequence[str] | None = None) -> list[Column]:
        names = columns or self.column_names
        return [F.lit(math.log(max(w, 1e-300))) + MultivariateNormal(list(names), m, c).logpdf(names) for w, m, c in zip(self.weights, self.means, self.covariances, strict=True)]

    def logpdf(self) -> Column:
        parts = self._parts()
        top = F.greatest(*parts) if len(parts) > 1 else parts[0]
        return top + F.ln(sum((F.exp(p - top) for p in parts[1:]), F.exp(parts[0] - top)))

    def pdf(self) -> Column:
        return F.exp(self.logpdf())

    def with_responsibilities(self, df: DataFrame, name: str = "responsibilities") -> DataFrame:
        parts = df.select("*", F.array(*self._parts()).alias("_l"))
        top = F.array_max("_l")
        parts = parts.withColumn("_e", F.transform("_l", lambda x: F.exp(x - top))).withColumn("_s", F.aggregate("_e", F.lit(0.0), lambda a, x: a + x))
        return parts.withColumn(name, F.transform("_e", lambda x: x / F.col("_s"))).drop("_l", "_e", "_s")

    def predict(self, df: DataFrame, name: str = "component") -> DataFrame:
        return df.select("*", (F.array_position(F.array(*self._parts()), F.array_max(F.array(*self._parts()))) - 1).cast("int").alias(name))

    predict_proba = with_responsibilities

    @property
    def n_parameters(self) -> int:
        k, d = self.means.shape
        return k - 1 + k * d + k * d * (d + 1) // 2

    def aic(self) -> float:
        return 2 * self.n_parameters - 2 * self.log_likelihood

    def bic(self) -> float:
        return self.n_parameters * math.log(self.n) - 2 * self.log_likelihood

    def sample(self, n: int, random_state: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(random_state)
        k = r.choice(len(self.weights), n, p=self.weights / self.weights.sum())
        z = r.standard_normal((n, self.means.shape[1]))
        factors = np.stack([cholesky(c) for c in self.covariances])
        return self.means[k] + np.einsum("nij,nj->ni", factors[k], z), k

    def sample_distributed(self, spark: SparkSession, n: int, num_partitions: int | None = None, random_seed: int = 42) -> DataFrame:
        d = self.means.shape[1]
        rows, _ = correlated_normals(spark, n, np.eye(d), random_seed, num_partitions)
        u, k, below = uniform(random_seed, F.col("id"), 97), F.lit(len(self.weights) - 1), 1.0
        for i in range(len(self.weights) - 1, 0, -1):
            below -= float(self.weights[i] / self.weights.sum())
            k = F.when(u < below, i - 1).otherwise(k)
        rows = rows.withColumn("component", k)
        out = []
        for i, c in enumerate(self.column_names):
            value = F.lit(None).cast("double")
            for j, (m, cov) in enumerate(zip(self.means, self.covariances, strict=True)):
                low = cholesky(cov)
                value = F.when(F.col("component") == j, float(m[i]) + sum((F.col(f"z{a}") * float(low[i, a]) for a in range(i + 1)), F.lit(0.0))).otherwise(value)
            out.append(value.alias(c))
        return rows.select(*out, "component")

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], n_components: int = 2, max_iter: int = 100, tol: float = 1e-4, n_init: int = 1, init: str = "kmeans++", ridge: float = 1e-6, random_state: int = 0, init_rows: int = 2000) -> GaussianMixture:
        """EM from ``n_init`` starts on a sample of ``init_rows`` rows; the best likelihood stays.

        A round ends when the mean log-likelihood moves by less than ``tol``, up or down; the one reported is that of
        the parameters returned.
        """
        names = list(columns)
        if n_components < 1:
            raise ValueError("n_components must be positive")
        rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna().persist()
        try:
            n = rows.count()
            if n < n_components:
                raise ValueError("there are fewer rows than components")
            few = rows.orderBy(F.xxhash64(F.lit(random_state), *rows.columns)).limit(init_rows).toPandas().to_numpy()
            best = None
            for start in range(n_init):
                r = np.random.default_rng([random_state, start])
                found = cls._em(rows, names, n, cls._start(few, n_components, init, r), max_iter, tol, ridge)
                if best is None or found.log_likelihood > best.log_likelihood:
                    best = found
        finally:
            rows.unpersist()
        best.column_names = names
        return best

    @staticmethod
    def _start(x: np.ndarray, k: int, init: str, r):
        if init not in ("kmeans++", "random"):
            raise ValueError("init must be kmeans++ or random")
        centres = [x[r.integers(len(x))]]
        while len(centres) < k:
            d = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
            centres.append(x[r.choice(len(x), p=d / d.sum())] if init == "kmeans++" and d.sum() > 0 else x[r.integers(len(x))])
        means = np.array(centres)
        for _ in range(10 if init == "kmeans++" else 0):
            near = ((x[:, None] - means) ** 2).sum(axis=2).argmin(axis=1)
            means = np.array([x[near == j].mean(axis=0) if (near == j).any() else means[j] for j in range(k)])
        cov = np.atleast_2d(np.cov(x.T)) + 1e-6 * np.eye(x.shape[1])
        return np.full(k, 1 / k), means, np.stack([cov / (1 if k == 1 else k)] * k)

    @classmethod
    def _em(cls, rows, names, n, start, max_iter, tol, ridge):
        d = len(names)
        xs = [f"x{i}" for i in range(d)]
        model, was, pairs = cls(xs, *start, n=n), -math.inf, [(i, j) for i in range(d) for j in range(i, d)]
        for it in range(max_iter + 1):
            k = len(model.weights)
            marked = model.with_responsibilities(rows, "_r").withColumn("_ll", model.logpdf())
            sums = [F.sum("_ll").alias("ll")]
            for c in range(k):
                r = F.col("_r")[c]
                sums += [F.sum(r).alias(f"s{c}"), *[F.sum(r * F.col(x)).alias(f"m{c}_{i}") for i, x in enumerate(xs)]]
                sums += [F.sum(r * F.col(xs[i]) * F.col(xs[j])).alias(f"c{c}_{i}_{j}") for i, j in pairs]
            got = marked.agg(*sums).first()
            model.log_likelihood, model.iterations = got["ll"], it
            model.converged = abs(got["ll"] - was) / n < tol
            if model.converged or it == max_iter:
                break
            was = got["ll"]
            w = np.array([max(got[f"s{c}"], 1e-10) for c in range(k)])
            means = np.array([[got[f"m{c}_{i}"] for i in range(d)] for c in range(k)]) / w[:, None]
            cov = np.zeros((k, d, d))
            for c in range(k):
                for i, j in pairs:
                    cov[c, i, j] = cov[c, j, i] = got[f"c{c}_{i}_{j}"] / w[c] - means[c, i] * means[c, j]
                cov[c] += ridge * np.eye(d)
            model = cls(xs, w / w.sum(), means, cov, n=n)
        return model
