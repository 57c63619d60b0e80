"""Truncated laws and right-censored data where the answers are formulas over one aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawfinder.functions import columns as C
from lawfinder.operators.stats import with_previous


def truncated_cdf(name: str, x: Column, p: list[Column], low: Column, high: Column) -> Column:
    a, b = C.cdf(name, low, p), C.cdf(name, high, p)
    return F.when(x < low, 0.0).when(x >= high, 1.0).otherwise((C.cdf(name, x, p) - a) / (b - a))


def truncated_pdf(name: str, x: Column, p: list[Column], low: Column, high: Column) -> Column:
    mass = C.cdf(name, high, p) - C.cdf(name, low, p)
    return F.when((x < low) | (x > high) | (mass <= 0), 0.0).otherwise(C.pdf(name, x, p) / mass)


def truncated_expon_mean(scale: Column, low: Column, high: Column) -> Column:
    """Mean of an exponential law (location 0) cut to [low, high]."""
    a, b = F.exp(-low / scale), F.exp(-high / scale)
    return scale + (low * a - high * b) / (a - b)


def censored_exponential(df: DataFrame, time: str, event: str, by: list[str] | None = None) -> DataFrame:
    """scale = total time / events, with the log-likelihood of events and censored rows; no event: null."""
    e = F.sum(F.col(event).cast("int")).cast("long")
    rows = df.where(F.col(time).isNotNull() & F.col(event).isNotNull())
    out = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), e.alias("n_events"), F.sum(time).alias("total_time"))
    scale = F.when(F.col("n_events") > 0, F.col("total_time") / F.col("n_events"))
    return out.withColumn("scale", scale).withColumn("loglik", -F.col("n_events") * (F.ln("scale") + 1)).withColumn("censored_share", 1 - F.col("n_events") / F.col("n"))


def spacing_objective(ranked: DataFrame, cdf: Callable[[Column], Column]) -> DataFrame:
    """Mean log-spacing of a law over the distinct values of each column: ``ranked`` has column_name, value and n."""
    rows = with_previous(ranked.select("column_name", "value", "n"))
    rows = rows.withColumn("_f", cdf(F.col("value"))).withColumn("_gap", F.col("_f") - F.coalesce(cdf(F.col("previous")), F.lit(0.0)))
    floor = lambda x: F.ln(F.greatest(x, F.lit(1e-10)))
    total = F.sum(floor(F.col("_gap")) + (F.col("n") - 1) * F.ln(F.lit(1e-10))) + floor(1 - F.max("_f"))
    return rows.groupBy("column_name").agg((total / (F.sum("n") + 1)).alias("mean_log_spacing"))
