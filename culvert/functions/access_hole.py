"""HEC-22 access-hole loss as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from culvert.functions.hydraulics import col, positive
from culvert.schema import G_US

#: Depth to outlet diameter from which the hole counts as submerged.
SUBMERGED = 3.2


def depth_factor(depth, d_out) -> Column:
    depth, d = col(depth), col(d_out)
    ratio = depth / d
    rising = F.least(F.lit(1.0), 0.5 * F.pow(F.greatest(ratio, F.lit(0.0)), F.lit(0.6)))
    return F.when(d <= 0, 1.0).when(ratio >= SUBMERGED, 1.0).otherwise(rising)


def diameter_factor(depth, d_out, d_in) -> Column:
    depth, d, i = col(depth), col(d_out), col(d_in)
    return F.when((d > 0) & (i > 0), F.when(depth / d >= SUBMERGED, F.pow(d / i, F.lit(3.0))).otherwise(1.0)).otherwise(1.0)


def base_factor(access_diam, d_out, cos) -> Column:
    d, c = col(d_out), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), col(cos)))
    sine, r = F.sqrt(1.0 - c * c), col(access_diam) / d
    return positive(d > 0, 0.1 * r * (1.0 - sine) + 1.4 * F.pow(r, F.lit(0.15)) * sine)


def plunge_factor(plunge, depth, d_out) -> Column:
    h, depth, d = col(plunge), col(depth), col(d_out)
    return F.when((d > 0) & (h > depth), 1.0 + 0.2 * (h / d) * ((h - depth) / d)).otherwise(1.0)


def loss_coefficient(access_diam, d_out, cos, depth, d_in, bench=1.0, plunge=0.0) -> Column:
    b = col(bench)
    k = base_factor(access_diam, d_out, cos) * diameter_factor(depth, d_out, d_in) * depth_factor(depth, d_out) * plunge_factor(plunge, depth, d_out)
    return F.greatest(k * F.when(b > 0, b).otherwise(1.0), F.lit(0.0))


def head_loss(velocity, access_diam, d_out, cos, depth, d_in, bench=1.0, plunge=0.0, g: float = G_US) -> Column:
    return loss_coefficient(access_diam, d_out, cos, depth, d_in, bench, plunge) * col(velocity) * col(velocity) / (2.0 * g)


def deflection_cos(ax, ay, jx, jy, bx, by) -> Column:
    """Cosine of the turn at j on the way from a to b; 1 where a leg has no length."""
    ax, ay, jx, jy, bx, by = map(col, (ax, ay, jx, jy, bx, by))
    px, py, qx, qy = jx - ax, jy - ay, bx - jx, by - jy
    size = F.sqrt(px * px + py * py) * F.sqrt(qx * qx + qy * qy)
    return F.when(size > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (px * qx + py * qy) / size))).otherwise(1.0)


def bend_coefficient(coeff, cos) -> Column:
    return col(coeff) * (1.0 - col(cos)) / 2.0
