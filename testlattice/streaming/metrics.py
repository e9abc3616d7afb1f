"""An extension: metrics and run totals kept up to date as reports arrive. The batch operators are used as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.coverage import merge_metrics
from ..operators.merge import run_summary


def live_metrics(counters: DataFrame) -> DataFrame:
    """A3 over a stream of class counters; least and most are kept for each class (update or complete mode)."""
    return merge_metrics(counters)


def live_summary(metric: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A16 by window of event time ``ts``; windows close when the watermark has passed."""
    timed = metric.withWatermark("ts", late).withColumn("w", F.window("ts", window))
    return run_summary(timed, "w").withColumn("start", F.col("w.start")).drop("w")
