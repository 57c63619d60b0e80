"""Fits and drift on streams: windowed moments with a watermark, and a monitor for each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lawfinder.operators.stats import long_frame, two_sample_ks


def windowed_moments(stream: DataFrame, column: str, ts: str, window: str = "1 day", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Count, mean, population deviation and extremes in each time window; works on streams and on tables."""
    v = F.col(f"`{column}`").cast("double")
    span = F.window(ts, window, slide) if slide else F.window(ts, window)
    rows = stream.withWatermark(ts, watermark) if stream.isStreaming else stream
    out = rows.groupBy(span.alias("w")).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("stddev"), F.min(v).alias("min"), F.max(v).alias("max"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean", "stddev", "min", "max")


class DriftMonitor:
    """For ``writeStream.foreachBatch``: each batch against a reference column by the two-sample K-S distance.

    on_drift(batch id, row) is called where the distance exceeds ``threshold`` times the usual scale
    sqrt((n + m) / (n m)); 1.358 is the 5 percent level.
    """

    def __init__(self, reference: DataFrame, column: str, threshold: float = 1.358, on_drift: Callable | None = None):
        self.reference = long_frame(reference, [column]).select("value", F.lit("reference").alias("_group")).persist()
        self.column, self.threshold, self.on_drift, self.history = column, threshold, on_drift, []

    def compare(self, batch: DataFrame) -> DataFrame:
        both = self.reference.unionByName(long_frame(batch, [self.column]).select("value", F.lit("batch").alias("_group")))
        d = two_sample_ks(both, "_group", "reference", "batch")
        n, m = F.col("n_first").cast("double"), F.col("n_second").cast("double")
        limit = self.threshold * F.sqrt((n + m) / (n * m))
        return d.select("n_first", "n_second", "ks_statistic", limit.alias("limit"), (F.col("ks_statistic") > limit).alias("drift"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        row = self.compare(batch).first()
        if row is None:
            return
        self.history.append((batch_id, row))
        if row.drift and self.on_drift:
            self.on_drift(batch_id, row)

    def start(self, stream: DataFrame, checkpoint: str | None = None):
        writer = stream.writeStream.foreachBatch(self)
        return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
