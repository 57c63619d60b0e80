"""Reading input tables and making small frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark_session(spark: SparkSession | None = None) -> SparkSession:
    """The given or the active session; none is ever created."""
    found = spark or SparkSession.getActiveSession()
    if found is None:
        raise RuntimeError("there is no active Spark session")
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def create_dataframe(spark: SparkSession, data, columns) -> DataFrame:
    if hasattr(data, "columns"):
        return spark.createDataFrame(data)
    return spark.createDataFrame([tuple(v.item() if hasattr(v, "item") else v for v in (r if isinstance(r, (list, tuple)) else (r,))) for r in data], list(columns))


def column_range(df: DataFrame, column: str) -> dict:
    """Least and largest value and their number; nulls and NaN do not count."""
    c = F.col(f"`{column}`").cast("double")
    good = F.when(~F.isnan(c), c)
    r = df.agg(F.min(good).alias("min"), F.max(good).alias("max"), F.count(good).alias("count")).first()
    return {"min": float("nan") if r["min"] is None else r["min"], "max": float("nan") if r["max"] is None else r["max"], "count": r["count"]}
