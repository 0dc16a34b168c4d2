"""NOAA Atlas 14 depth-duration CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from culvert.sources.text import files, lines, number

_HEADER = "by duration for"
_DURATION = r"^\s*([0-9.]+)\s*-?\s*(min|hr|hour|day)"


def read_atlas14(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(depths, errors): (network_id, duration_min, rp_years, depth_in) of the first block of each
    file, and (network_id, error)."""
    return parse_atlas14(files(spark, path))


def parse_atlas14(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    row = lines(found).withColumn("cells", F.transform(F.split("line", ","), lambda x: F.trim(x)))
    is_header = F.lower("line").contains(_HEADER)
    first = row.filter(is_header).groupBy("network_id").agg(F.min_by(F.struct("line_no", "cells"), "line_no").alias("h"))
    periods = F.transform(F.filter("h.cells", lambda x: number(x).isNotNull()), lambda x: F.round(number(x)).cast("int"))
    head = first.select("network_id", F.col("h.line_no").alias("head"), periods.alias("periods"))
    minutes = F.when(F.regexp_extract("label", _DURATION, 2) == "min", 1.0).when(F.regexp_extract("label", _DURATION, 2) == "day", 1440.0).otherwise(60.0)
    below = row.join(head, "network_id").filter("line_no > head").withColumn("label", F.lower(F.col("cells")[0]))
    below = below.withColumn("duration_min", F.regexp_extract("label", _DURATION, 1).try_cast("double") * minutes)
    # The block ends at the first line without a duration after one with a duration.
    order = W.partitionBy("network_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    begun = F.max(F.when(F.col("duration_min").isNotNull(), 1).otherwise(0)).over(order)
    ended = F.max(F.when((F.col("begun") == 1) & F.col("duration_min").isNull(), 1).otherwise(0)).over(order)
    block = below.withColumn("begun", begun).withColumn("ended", ended).filter("ended = 0 and duration_min is not null")
    depth = block.select("network_id", "duration_min", F.posexplode("periods").alias("k", "rp_years"), "cells")
    depth = depth.select("network_id", "duration_min", "rp_years", number(F.get("cells", F.col("k") + 1)).alias("depth_in"))
    known = found.select("network_id").distinct()
    counts = depth.groupBy("network_id").agg(F.count_distinct("duration_min").alias("n"), F.count_if(F.col("depth_in").isNull()).alias("bad"))
    state = known.join(head, "network_id", "left").join(counts, "network_id", "left")
    error = (
        F.when(F.col("head").isNull(), "no header of return periods")
        .when(F.size("periods") == 0, "no return periods in the header")
        .when(F.col("bad") > 0, "a duration row has a missing or non-numeric depth")
        .when(F.coalesce("n", F.lit(0)) < 3, "fewer than three duration rows")
    )
    errors = state.select("network_id", error.alias("error")).filter("error is not null")
    return depth.join(errors, "network_id", "left_anti"), errors
