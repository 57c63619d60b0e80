"""Synthetic rows: uniform numbers by row from a hash of seed and row number, so partitions do not matter."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawfinder.functions import columns as C
from lawfinder.functions import registry


def uniform(seed: int, row: Column, stream: int = 0) -> Column:
    """A number in (0, 1) that follows from seed, stream and row alone."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(stream), row), 11).cast("double") + 0.5) / float(1 << 53)


def golden(row: Column, seed: int = 0) -> Column:
    """The additive golden-ratio sequence: an even, deterministic cover of (0, 1), expressible in any SQL."""
    return F.pmod((row + seed + 0.5) * 0.6180339887498949, F.lit(1.0))


def sample_distributed(spark: SparkSession, distribution: str, parameters: Sequence[float], n: int, num_partitions: int | None = None, random_seed: int = 42, column_name: str = "sample") -> DataFrame:
    """``n`` draws; the quantile function is a column expression where there is one, an Arrow function elsewhere."""
    if n <= 0:
        raise ValueError("n must be positive")
    rows = spark.range(0, n, 1, num_partitions or spark.sparkContext.defaultParallelism).select(uniform(random_seed, F.col("id")).alias("u"))
    return rows.select(quantile(distribution, parameters, F.col("u")).alias(column_name))


def quantile(distribution: str, parameters: Sequence[float], u: Column) -> Column:
    p = [float(v) for v in parameters]
    try:
        return C.ppf(distribution, u, [F.lit(v) for v in p])
    except KeyError:
        law = registry.get_law(distribution)

        @F.pandas_udf("double")
        def ppf(q: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(law.ppf(q.to_numpy(), *p), float))

        return ppf(u)


def generate_samples(spark: SparkSession, n: int, generator: Callable[[int, int, int], np.ndarray], column_names: Sequence[str], num_partitions: int | None = None, random_seed: int = 42) -> DataFrame:
    """Rows of a custom generator(size, partition, seed); seeds of partitions and of runs never meet."""
    parts = num_partitions or spark.sparkContext.defaultParallelism
    sizes = [(i, n // parts + (i < n % parts)) for i in range(parts)]
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in column_names])
    names = list(column_names)

    def run(batches):
        for pdf in batches:
            for i, size in zip(pdf.part, pdf["size"], strict=True):
                if size:
                    seed = int(np.random.SeedSequence([random_seed, int(i)]).generate_state(1)[0])
                    yield pd.DataFrame(np.asarray(generator(int(size), int(i), seed), float).reshape(int(size), -1), columns=names)

    return spark.createDataFrame(spark.sparkContext.parallelize(sizes, parts), "part int, size long").mapInPandas(run, schema)
