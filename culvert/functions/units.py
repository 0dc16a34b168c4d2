"""US customary and SI units. The engine computes in US units; documents carry either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.functions.hydraulics import col
from culvert.schema import CATALOG_MM

M_PER_FT, HA_PER_AC, MM_PER_IN = 0.3048, 0.404686, 25.4


def to_feet(value, units) -> Column:
    return F.when(col(units) == "si", col(value) / M_PER_FT).otherwise(col(value))


def to_acres(value, units) -> Column:
    return F.when(col(units) == "si", col(value) / HA_PER_AC).otherwise(col(value))


def to_inches_per_hour(value, units) -> Column:
    """Intensities, and the coefficient `a` of IDF curves."""
    return F.when(col(units) == "si", col(value) / MM_PER_IN).otherwise(col(value))


def inches_to_feet(value) -> Column:
    return col(value) / 12.0


def nearest_metric_mm(metres) -> Column:
    """The nominal metric diameter nearest to a size, the smaller one on ties."""
    mm = col(metres) * 1000.0
    sizes = F.array(*[F.struct(F.abs(mm - float(d)).alias("off"), F.lit(d).alias("mm")) for d in CATALOG_MM])
    return F.array_min(sizes)["mm"]


_LENGTHS = {"nodes": ("invert", "rim", "x", "y"), "pipes": ("length", "rise", "span")}


def nodes_to(nodes: DataFrame, units: str) -> DataFrame:
    """Nodes in SI from US units, or back."""
    f, a = (M_PER_FT, HA_PER_AC) if units == "si" else (1 / M_PER_FT, 1 / HA_PER_AC)
    return nodes.withColumns({c: F.col(c) * f for c in _LENGTHS["nodes"]} | {"area_ac": F.col("area_ac") * a})


def pipes_to(pipes: DataFrame, units: str) -> DataFrame:
    """Pipes in SI with nominal metric diameters, or in US units with diameters of whole inches."""
    if units == "si":
        diameter = nearest_metric_mm(F.col("diameter") * M_PER_FT) / 1000.0
        return pipes.withColumns({c: F.col(c) * M_PER_FT for c in _LENGTHS["pipes"]} | {"diameter": diameter})
    diameter = F.round(F.col("diameter") / M_PER_FT * 12.0) / 12.0
    return pipes.withColumns({c: F.col(c) / M_PER_FT for c in _LENGTHS["pipes"]} | {"diameter": diameter})


def label(units) -> Column:
    return F.when(col(units) == "si", "SI").otherwise("US customary")
