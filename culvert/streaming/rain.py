"""Rain-gauge streams: peak intensities by window, with late readings bounded by a watermark.

Not part of steady analysis: its windows give the intensities that analyze_rational takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intensities(readings: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(gauge, start, end, depth_in, intensity) of readings (gauge, at, depth_in), batch or stream."""
    minutes = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    summed = readings.withWatermark("at", late).groupBy("gauge", F.window("at", window).alias("w")).agg(F.sum("depth_in").alias("depth_in"))
    return summed.select("gauge", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "depth_in", (F.col("depth_in") * 3600.0 / minutes).alias("intensity"))
