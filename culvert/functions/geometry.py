"""Plane geometry as Column expressions. Polygons are array<struct<x, y>>, open or closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.functions.hydraulics import col, positive

SQFT_PER_ACRE = 43_560.0


def _edges(vertices) -> Column:
    """struct(p, q) of each side, the closing one too."""
    v = col(vertices)
    n = F.size(v)
    return F.transform(v, lambda p, i: F.struct(p.alias("p"), F.when(i + 1 < n, F.get(v, i + 1)).otherwise(v[0]).alias("q")))


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + f(e["p"], e["q"]))


def _cross(p, q) -> Column:
    return p["x"] * q["y"] - q["x"] * p["y"]


def shoelace_area(vertices) -> Column:
    """Area of a polygon in square units; 0 with fewer than three vertices."""
    return positive(F.size(col(vertices)) >= 3, F.abs(_sum(_edges(vertices), _cross)) / 2.0)


def centroid(vertices) -> Column:
    """struct(x, y): the area centroid; of degenerate polygons the mean vertex; NULL if empty."""
    v, e = col(vertices), _edges(vertices)
    twice = _sum(e, _cross)
    n = F.size(v).cast("double")
    mean = lambda k: F.aggregate(v, F.lit(0.0), lambda acc, p: acc + p[k]) / n
    area = lambda k: _sum(e, lambda p, q: (p[k] + q[k]) * _cross(p, q)) / (3.0 * twice)
    flat = (F.size(v) < 3) | (F.abs(twice) < 1e-12)
    at = lambda k: F.when(flat, mean(k)).otherwise(area(k)).alias(k)
    return F.when(F.size(v) > 0, F.struct(at("x"), at("y")))


def acres(square_feet) -> Column:
    return col(square_feet) / SQFT_PER_ACRE


def distance(ax, ay, bx, by) -> Column:
    dx, dy = col(ax) - col(bx), col(ay) - col(by)
    return F.sqrt(dx * dx + dy * dy)


def point_in_polygon(x, y, vertices, sides: bool = True) -> Column:
    """Even-odd rule: an odd number of sides is crossed to the right of the point. Without `sides`, a
    point on a side or corner lies outside."""
    x, y = col(x), col(y)

    def crossed(p, q):
        meets = p["x"] + (y - p["y"]) / (q["y"] - p["y"]) * (q["x"] - p["x"])
        spans = (p["y"] > y) != (q["y"] > y)
        found = F.when(spans, F.when(x < meets, 1.0).otherwise(0.0)).otherwise(0.0)
        if sides:
            return found
        level = (q["x"] - p["x"]) * (y - p["y"]) == (q["y"] - p["y"]) * (x - p["x"])
        held = x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
        # A small share makes the sum of a point on a side no whole number; one sum is evaluated once, after the filter of boxes.
        return found + F.when(level & held, 2.0**-20).otherwise(0.0)

    return (F.size(col(vertices)) >= 3) & (_sum(_edges(vertices), crossed) % 2 == 1)


def segment_projection(px, py, ax, ay, bx, by) -> Column:
    """struct(x, y, t, distance): the nearest point of a segment."""
    px, py, ax, ay, bx, by = map(col, (px, py, ax, ay, bx, by))
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = positive(size > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / size)))
    x, y = ax + t * dx, ay + t * dy
    return F.struct(x.alias("x"), y.alias("y"), t.alias("t"), distance(px, py, x, y).alias("distance"))


def snap(value, grid) -> Column:
    """To the nearest multiple of grid, halves away from zero; unchanged without a grid."""
    v, g = col(value), col(grid)
    return F.when(g > 0, F.round(v / g) * g).otherwise(v)


def tick_step(span, ticks: int = 8) -> Column:
    """A step of 1, 2 or 5 times a power of ten that gives about `ticks` marks over a span."""
    rough = col(span) / F.lit(float(max(ticks, 1)))
    base = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    part = rough / base
    return positive(rough > 0, F.when(part <= 1.0, base).when(part <= 2.0, 2.0 * base).when(part <= 5.0, 5.0 * base).otherwise(10.0 * base), 1.0)


def total_areas(catchments: DataFrame) -> DataFrame:
    """(network_id, acres, n): the area of each network's catchments; fewer than three vertices have none."""
    return catchments.groupBy("network_id").agg(F.sum(acres(shoelace_area("vertices"))).alias("acres"), F.count("*").alias("n"))
