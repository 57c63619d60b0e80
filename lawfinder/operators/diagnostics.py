"""What the usual diagnostic plots show, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawfinder.operators.stats import ecdf, histogram, long_frame, pmf

POINTS = 1000


def _apply(fn, kind: str = "double"):
    @F.pandas_udf(kind)
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(fn(x.to_numpy(float)), float))

    return run


def distribution_data(df: DataFrame, column: str, results: Sequence, bins: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The histogram, and each result's density at POINTS places between its 1 and 99 percent quantiles."""
    spark = df.sparkSession
    rows = []
    for r in results:
        a, b = r.pdf_range()
        x = np.linspace(a, b, POINTS)
        rows += [(r.distribution, float(u), float(v)) for u, v in zip(x, np.nan_to_num(r.pdf(x), posinf=0.0), strict=True)]
    return histogram(long_frame(df, [column]), bins), spark.createDataFrame(rows, "distribution string, x double, pdf double")


def qq_data(df: DataFrame, column: str, result) -> DataFrame:
    """(p, theoretical, sample): Blom positions (i - 3/8) / (n + 1/4) of the distinct values, at the middle of ties."""
    e = ecdf(long_frame(df, [column]))
    p = ((F.col("before") + F.col("upto") + 1) / 2 - 0.375) / (F.col("total") + 0.25)
    return e.select(p.alias("p"), _apply(result.ppf)(p).alias("theoretical"), F.col("value").alias("sample"), "n")


def pp_data(df: DataFrame, column: str, result) -> DataFrame:
    """(empirical, theoretical): Blom positions against the law's distribution function."""
    e = ecdf(long_frame(df, [column]))
    p = ((F.col("before") + F.col("upto") + 1) / 2 - 0.375) / (F.col("total") + 0.25)
    return e.select(p.alias("empirical"), _apply(result.cdf)(F.col("value")).alias("theoretical"), "n")


def residual_data(df: DataFrame, column: str, result, bins: int | None = None) -> DataFrame:
    """(centre, residual): density less the law's density at each bin's centre."""
    h = histogram(long_frame(df, [column]), bins)
    centre = (F.col("lo") + F.col("hi")) / 2
    return h.select("bin_id", centre.alias("centre"), (F.col("density") - _apply(result.pdf)(centre)).alias("residual"))


def cdf_data(df: DataFrame, column: str, result) -> DataFrame:
    """(value, empirical, theoretical) at each distinct value."""
    e = ecdf(long_frame(df, [column]))
    return e.select("value", (F.col("upto") / F.col("total")).alias("empirical"), _apply(result.cdf)(F.col("value")).alias("theoretical"))


def discrete_data(df: DataFrame, column: str, result) -> DataFrame:
    """(value, empirical, theoretical) of the values that occur and the two whole numbers below and above each, from zero on (or the least value less two, if that is more).

    So there are no rows for the empty stretch before a far value, and five at most for each distinct one.
    """
    count = pmf(long_frame(df, [column], discrete=True)).select("value", "pmf")
    grid = count.select(F.explode(F.array(*[F.col("value") + k for k in range(-2, 3)])).alias("value")).distinct().where("value >= 0")
    grid = grid.unionByName(count.where("value < 0").select("value")).distinct()
    return grid.join(count, "value", "left").select("value", F.coalesce("pmf", F.lit(0.0)).alias("empirical"), _apply(result.pmf)(F.col("value").cast("double")).alias("theoretical"))


def diagnostics(df: DataFrame, column: str, result) -> dict[str, DataFrame]:
    return {"qq": qq_data(df, column, result), "pp": pp_data(df, column, result), "residuals": residual_data(df, column, result), "cdf": cdf_data(df, column, result)}
