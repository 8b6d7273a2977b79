"""Per-frame aggregates over a stream of detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_window(stream: DataFrame, time: str = "ts", value: str = "area", window: str = "5 minutes", late: str = "10 minutes", by: Sequence[str] = ()) -> DataFrame:
    """by, window_start, n, total, mean per event-time window; rows later than `late` are left out.

    The same plan serves a batch relation, where no row is late.
    """
    clean = stream.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value)))
    marked = clean.withWatermark(time, late)
    return (
        marked.groupBy(*by, F.window(time, window))
        .agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
        .select(*by, F.col("window.start").alias("window_start"), "n", "total", "mean")
    )
