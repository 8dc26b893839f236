"""Running statistics over streams of observations: windowed aggregates with a
watermark, so state is bounded by the lateness that is allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.operators.stats import circular_mean


def windowed_statistics(stream: DataFrame, value: str, time: str = "time", by: list[str] | None = None, window: str = "10 minutes", slide: str | None = None, late: str = "10 minutes", direction: str | None = None) -> DataFrame:
    """Per window and group: count, mean, population deviation, least and largest."""
    shown = [F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("minimum"), F.max(value).alias("maximum")]
    if direction:
        shown.append(circular_mean(direction).alias("direction"))
    out = stream.withWatermark(time, late).groupBy(F.window(time, window, slide or window), *(by or [])).agg(*shown)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *(by or []), *[c for c in out.columns if c != "window" and c not in (by or [])])
