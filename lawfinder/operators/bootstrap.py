"""Bootstrap confidence intervals: resamples are refitted by tasks, one seed each."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lawfinder.functions import kernel, registry
from lawfinder.operators.fitting import sampled
from lawfinder.operators.stats import long_frame


def intervals(result, df: DataFrame, column: str, alpha: float = 0.05, n_bootstrap: int = 200, max_samples: int | None = 10_000, seed: int | None = 42) -> dict[str, tuple[float, float]]:
    """Percentile intervals of each parameter, from resamples of ``max_samples`` values; None: of as many as there are.

    All values are drawn as multinomial counts of the distinct ones, which are what is sent to the tasks; the refits
    weigh the values by these counts, so that a resample is as large as the distinct values, not as the table.

    Refits that fail, and those outside three interquartile ranges in any parameter, are left out; fewer than
    ten left is an error.
    """
    spark, law = df.sparkSession, registry.get_law(result.distribution)
    discrete = hasattr(law, "pmf")
    rows = long_frame(df, [column], discrete=discrete).select("value")
    if max_samples is None:
        pdf = rows.groupBy("value").count().toPandas().sort_values("value")
        values, counts = pdf.value.to_numpy(float), pdf["count"].to_numpy(np.int64)
    else:
        n = rows.count()
        values, counts = np.sort(sampled(rows, ["value"], n, max_samples, seed or 0).toPandas().value.to_numpy(float)), None
    sent = spark.sparkContext.broadcast((values, counts))
    custom = registry.get_custom_distributions().get(result.distribution)
    base, name = 0 if seed is None else seed, result.distribution

    def run(batches):
        (x, counts), law = sent.value, custom or registry.get_law(name)

        def drawn(r):
            """Values, and how often each of them was drawn (None: once)."""
            if counts is None:
                return r.choice(x, len(x)), None
            c = r.multinomial(counts.sum(), counts / counts.sum())
            return x[c > 0], c[c > 0]

        for pdf in batches:
            out = []
            for b in pdf.id:
                r = np.random.default_rng([base, int(b)])
                try:
                    v, c = drawn(r)
                    if discrete:
                        v, c = (v, c) if c is not None else np.unique(v, return_counts=True)
                        p = kernel.fit_discrete(law, v, c.astype(float))
                    else:
                        p = kernel.fit_mle(law, v, c)
                    out.append([float(v) for v in p])
                except Exception:
                    out.append([float("nan")])
            yield pd.DataFrame({"id": pdf.id, "p": out})

    got = spark.range(n_bootstrap).repartition(spark.sparkContext.defaultParallelism).mapInPandas(run, "id long, p array<double>").toPandas()
    good = np.array([p for p in got.sort_values("id").p if len(p) == len(law.names) and np.isfinite(p).all()])
    if len(good):
        q1, q3 = np.quantile(good, [0.25, 0.75], axis=0)
        far = 3 * (q3 - q1) + 1e-12
        good = good[((good >= q1 - far) & (good <= q3 + far)).all(axis=1)]
    if len(good) < 10:
        raise ValueError(f"only {len(good)} of {n_bootstrap} resamples could be fitted")
    low, high = np.quantile(good, [alpha / 2, 1 - alpha / 2], axis=0)
    return {k: (float(a), float(b)) for k, a, b in zip(law.names, low, high, strict=True)}
