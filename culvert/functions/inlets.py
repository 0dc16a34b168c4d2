"""HEC-22 gutter and inlet relations as Column expressions.

Geometry comes from columns named as the fields of schema.InletGeometry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.functions.hydraulics import col, positive
from culvert.schema import G_US, InletGeometry

#: Spellings of inlet kinds, trimmed and in lower case.
KINDS = {
    "grate_on_grade": ("grate", "grate_on_grade", "grate on grade", "on_grade"),
    "curb_opening": ("curb", "curb_opening", "curb opening"),
    "combination": ("combo", "combination"),
    "sag_grate": ("sag", "sag_grate", "sag grate"),
    "sag_curb": ("sag_curb", "sag curb"),
}
LABELS = {"grate_on_grade": "Grate (on grade)", "curb_opening": "Curb opening", "combination": "Combination", "sag_grate": "Sag grate", "sag_curb": "Sag curb"}


def inlet_kind(text) -> Column:
    """The kind that a spelling stands for; NULL for others."""
    given = F.lower(F.trim(col(text)))
    return F.coalesce(*[F.when(given.isin(*names), kind) for kind, names in KINDS.items()])


def inlet_label(kind) -> Column:
    return F.coalesce(*[F.when(col(kind) == k, label) for k, label in LABELS.items()])


def is_sag(kind) -> Column:
    return col(kind).isin("sag_grate", "sag_curb")


def gutter_spread(q, n, cross_slope, slope) -> Column:
    q, n, sx, sl = map(col, (q, n, cross_slope, slope))
    ok = (q > 0) & (n > 0) & (sx > 0) & (sl > 0)
    return positive(ok, F.pow(q * n / (0.56 * F.pow(sx, F.lit(1.67)) * F.sqrt(sl)), F.lit(1.0 / 2.67)))


def gutter_velocity(q, cross_slope, spread) -> Column:
    area = 0.5 * col(cross_slope) * col(spread) * col(spread)
    return positive(area > 0, col(q) / area)


def _spread(q) -> Column:
    return gutter_spread(q, "gutter_n", "cross_slope", "gutter_slope")


def grate_efficiency(q) -> Column:
    """Frontal and side flow that a grate takes, as a share of q."""
    t, w, length, sx = _spread(q), F.col("grate_width_ft"), F.col("grate_length_ft"), F.col("cross_slope")
    v = gutter_velocity(q, sx, t)
    frontal = F.when(w >= t, 1.0).otherwise(1.0 - F.pow(1.0 - w / t, F.lit(2.67)))
    taken = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - 0.09 * (v - F.col("splash_over_velocity_fps"))))
    side = positive((sx > 0) & (length > 0), 1.0 / (1.0 + 0.15 * F.pow(v, F.lit(1.8)) / (sx * F.pow(length, F.lit(2.3)))))
    return positive(t > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), taken * frontal + side * (1.0 - frontal))))


def curb_full_length(q) -> Column:
    """Curb opening that takes all of q."""
    q, n, sx, sl = col(q), F.col("gutter_n"), F.col("cross_slope"), F.col("gutter_slope")
    ok = (q > 0) & (n > 0) & (sx > 0) & (sl > 0)
    return positive(ok, 0.6 * F.pow(q, F.lit(0.42)) * F.pow(sl, F.lit(0.3)) * F.pow(1.0 / (n * sx), F.lit(0.6)))


def curb_efficiency(q) -> Column:
    need, has = curb_full_length(q), F.col("curb_opening_length_ft")
    part = 1.0 - F.pow(1.0 - has / need, F.lit(1.8))
    return F.when(need <= 0, 0.0).when(has >= need, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), part)))


def on_grade_efficiency(q) -> Column:
    return F.when(F.col("kind") == "curb_opening", curb_efficiency(q)).otherwise(grate_efficiency(q))


def sag_grate_capacity() -> Column:
    """The lesser of weir and orifice flow; one side of the grate lies at the curb."""
    d, length, w = F.col("sag_ponding_depth_ft"), F.col("grate_length_ft"), F.col("grate_width_ft")
    clear = 1.0 - F.greatest(F.lit(0.0), F.least(F.lit(0.95), F.col("clogging_fraction")))
    weir = 3.0 * (length + 2.0 * w) * clear * F.pow(d, F.lit(1.5))
    orifice = 0.67 * length * w * clear * F.sqrt(2.0 * G_US * d)
    return positive((d > 0) & (length > 0) & (w > 0), F.least(weir, orifice))


def sag_curb_capacity() -> Column:
    """Weir flow; orifice flow limits it where the opening is drowned."""
    d, length = F.col("sag_ponding_depth_ft"), F.col("curb_opening_length_ft")
    h = F.greatest(F.col("curb_opening_height_ft"), F.lit(1e-3))
    weir = 2.3 * (length + 1.8 * F.col("grate_width_ft")) * F.pow(d, F.lit(1.5))
    orifice = 0.67 * h * length * F.sqrt(2.0 * G_US * F.greatest(d - h / 2.0, F.lit(0.0)))
    return positive((d > 0) & (length > 0), F.when(d <= h, weir).otherwise(F.least(weir, orifice)))


def check_inlets(flows: DataFrame, defaults: InletGeometry = InletGeometry()) -> DataFrame:
    """Capacity of inlets at their flow design_q: capacity_cfs, efficiency, spread_ft, bypass_cfs, ok.

    Columns named as fields of InletGeometry override the defaults where not null. On grade an
    inlet passes by its spread, in a sag by its capacity.
    """
    names = set(flows.columns)
    given = flows.withColumns({k: F.coalesce(F.col(k), v) if k in names else v for k, v in defaults.columns().items()})
    q, sag = F.col("design_q"), is_sag("kind")
    made = given.withColumns(
        {
            "efficiency": F.when(sag, 1.0).otherwise(on_grade_efficiency("design_q")),
            "spread_ft": F.when(sag, 0.0).otherwise(_spread("design_q")),
        }
    )
    capacity = F.when(F.col("kind") == "sag_curb", sag_curb_capacity()).when(sag, sag_grate_capacity()).otherwise(F.col("efficiency") * q)
    made = made.withColumn("capacity_cfs", capacity).withColumn("bypass_cfs", F.greatest(q - F.col("capacity_cfs"), F.lit(0.0)))
    ok = F.when(sag, F.col("capacity_cfs") >= q).otherwise(F.col("spread_ft") <= F.col("allowable_spread_ft"))
    return made.withColumn("ok", ok)


def check_grates(flows: DataFrame, length: str, slope: str) -> DataFrame:
    """check_inlets of plain grates on grade, with their length and gutter slope from columns."""
    return check_inlets(flows.withColumns({"kind": F.lit("grate_on_grade"), "grate_length_ft": F.col(length), "gutter_slope": F.col(slope)}))


def with_overrides(inlets: DataFrame, defaults: InletGeometry = InletGeometry()) -> DataFrame:
    """Geometry of nodes with inlet_length_ft, inlet_slope and inlet_sag, where positive or true."""
    long, steep = F.col("inlet_length_ft") > 0, F.col("inlet_slope") > 0
    return inlets.withColumns(
        defaults.columns()
        | {
            "grate_length_ft": F.when(long, F.col("inlet_length_ft")).otherwise(defaults.grate_length_ft),
            "curb_opening_length_ft": F.when(long, F.col("inlet_length_ft")).otherwise(defaults.curb_opening_length_ft),
            "gutter_slope": F.when(steep, F.col("inlet_slope")).otherwise(defaults.gutter_slope),
            "kind": F.when(F.col("inlet_sag"), "sag_grate").otherwise(defaults.kind),
        }
    )


def ponded(defaults: InletGeometry, depth_ft: float) -> InletGeometry:
    """The geometry with a ponding depth of at least 0.1 ft."""
    from dataclasses import replace

    return replace(defaults, sag_ponding_depth_ft=max(depth_ft, 0.1))


def node_inlets(nodes: DataFrame, pipes: DataFrame, results: DataFrame, defaults: InletGeometry = InletGeometry()) -> DataFrame:
    """Inlet checks by node: local flow is C A times the largest intensity of the node's outgoing reaches."""
    keys = ["network_id", "rp_years"]
    out = results.groupBy(*keys, F.col("from").alias("id")).agg(F.max("intensity").alias("intensity"))
    own = nodes.filter("kind = 'inlet'").drop("kind")
    for name, kind in (("inlet_length_ft", "double"), ("inlet_slope", "double"), ("inlet_sag", "boolean")):
        if name not in own.columns:
            own = own.withColumn(name, F.lit(None).cast(kind))
    flows = own.join(out, ["network_id", "id"]).withColumn("design_q", F.least(F.col("c"), F.lit(1.0)) * F.col("area_ac") * F.col("intensity"))
    return check_inlets(with_overrides(flows, defaults), defaults)
