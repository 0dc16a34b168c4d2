import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from culvert.functions import access_hole as ah
from culvert.functions import geometry as ge
from culvert.functions import hydraulics as hy
from culvert.functions import hydrology as hd
from culvert.functions import inlets as il
from culvert.functions import registry, solvers
from culvert.functions import units as un
from culvert.schema import InletGeometry


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


L = F.lit


def test_full_flow_and_peak(spark):
    assert value(spark, hy.full_flow_capacity(L(0.013), L(0.005), L(2.0))) == pytest.approx(16.04, abs=0.02)
    full, half, most = (value(spark, x) for x in (hy.full_flow_capacity(L(0.013), L(0.005), L(2.0)), hy.circular_q(L(0.013), L(0.005), L(2.0), L(1.0)), hy.max_capacity(L(0.013), L(0.005), L(2.0))))
    assert half == pytest.approx(full / 2, abs=1e-6)
    assert most / full == pytest.approx(1.076, abs=0.01)
    assert value(spark, hy.manning_q(L(0.0), L(0.1), L(1.0), L(1.0))) == 0
    assert value(spark, hy.manning_q(L(0.013), L(-0.1), L(1.0), L(1.0))) == 0


def test_depths(spark):
    assert value(spark, hy.normal_depth(L(0.525), L(0.013), L(0.0033), L(8 / 12))) == pytest.approx(0.433, abs=0.002)
    assert value(spark, hy.normal_depth(L(999.0), L(0.013), L(0.0033), L(8 / 12))) is None
    assert value(spark, hy.normal_depth(L(0.0), L(0.013), L(0.0033), L(1.0))) == 0
    y = value(spark, hy.critical_depth(L(10.0), L(2.0)))
    g = value(spark, hy.circular_geometry(L(y), L(2.0)))
    assert 10 / g.area / math.sqrt(32.2 * g.area / g.top) == pytest.approx(1, abs=1e-3)
    assert value(spark, hy.critical_depth(L(50.0), L(4.0), L("rectangular"), L(4.0))) == pytest.approx(1.693, abs=2e-3)
    assert value(spark, hy.max_capacity_depth(L(0.013), L(0.01), L(2.0))) == pytest.approx(1.876)


def test_sections(spark):
    box = value(spark, hy.section_geometry(L(2.0), L("rectangular"), L(3.0), L(4.0)))
    assert tuple(box) == (8.0, 8.0, 1.0, 4.0)
    arch = value(spark, hy.section_area_full(L("arch"), L(3.0), L(4.0)))
    assert arch == pytest.approx(4 + 2 * math.pi)
    assert value(spark, hy.section_full_capacity(L(0.013), L(0.01), L("elliptical"), L(2.0), L(2.0))) == pytest.approx(value(spark, hy.full_flow_capacity(L(0.013), L(0.01), L(2.0))), abs=1e-3)
    assert value(spark, hy.section_max_capacity(L(0.013), L(0.01), L("rectangular"), L(3.0), L(4.0))) > value(spark, hy.section_full_capacity(L(0.013), L(0.01), L("rectangular"), L(3.0), L(4.0)))
    assert value(spark, hy.equal_area_diameter(L("rectangular"), L(2.0), L(3.0))) == pytest.approx(math.sqrt(24 / math.pi))


@settings(max_examples=25, deadline=None)
@given(st.sampled_from([solvers.ELLIPTICAL, solvers.ARCH, solvers.CIRCULAR]), st.floats(0.6, 2.5), st.floats(0.5, 8.0))
def test_peak_index_is_that_of_the_grid(shape, ratio, rise):
    span = rise if shape == solvers.CIRCULAR else rise * ratio
    grid = solvers.Sections(np.full(2000, shape), np.full(2000, rise), np.full(2000, span))
    q = solvers.manning_q(np.full(2000, 0.013), np.full(2000, 0.01), grid, rise * np.arange(1, 2001) / 2000)
    most, _ = solvers.max_capacity(np.array([0.013]), np.array([0.01]), solvers.Sections([shape], [rise], [span]))
    assert most[0] == pytest.approx(q.max(), rel=1e-9)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 3), st.floats(0.5, 6.0), st.floats(0.5, 2.0), st.floats(0.01, 0.99), st.floats(0.0005, 0.05))
def test_normal_depth_round_trip(shape, rise, ratio, share, slope):
    s = solvers.Sections([shape], [rise], [rise * (1 if shape == 0 else ratio)])
    n, sl = np.array([0.013]), np.array([slope])
    most, _ = solvers.max_capacity(n, sl, s)
    y = solvers.normal_depth(share * most, n, sl, s)
    assert solvers.manning_q(n, sl, s, y)[0] == pytest.approx(share * most[0], rel=1e-3, abs=1e-5)


def test_rainfall(spark):
    assert value(spark, hd.idf_intensity(L(15.0), L(120.0), L(10.0), L(0.8))) == pytest.approx(9.14, abs=0.05)
    assert value(spark, hd.idf_intensity(L(-5.0), L(120.0), L(10.0), L(0.8))) == pytest.approx(120 / 10**0.8)
    assert value(spark, hd.kirpich_minutes(L(500.0), L(0.01))) == pytest.approx(5.50, abs=0.02)
    assert value(spark, hd.kirpich_minutes(L(1000.0), L(0.01))) == pytest.approx(9.38, abs=0.02)
    assert value(spark, hd.sheet_flow_minutes(L(200.0), L(0.01), L(0.011), L(2.5))) == pytest.approx(3.15, abs=0.03)
    assert value(spark, hd.faa_minutes(L(300.0), L(0.01), L(0.7))) == pytest.approx(12.47, abs=0.05)
    assert value(spark, hd.rational_peak(L(0.85), L(5.1), L(35400 / 43560))) == pytest.approx(3.52, abs=0.01)
    assert [value(spark, hd.frequency_factor(L(x))) for x in (2, 10, 11, 25, 50, 100)] == [1.0, 1.0, 1.1, 1.1, 1.2, 1.25]
    assert value(spark, hd.kirpich_minutes(L(0.0), L(0.01))) == 0
    assert value(spark, hd.segment_minutes(L("channel"), L(400.0), L(0.005), L(0.035), L(False), L(0.0), L(0.0))) == pytest.approx(400 / (1.49 / 0.035 * math.sqrt(0.005)) / 60)


def test_idf_sets(spark):
    curves = spark.createDataFrame([(1, 10, 60.0, 10.0, 0.8)], "network_id bigint, rp_years int, a double, b double, c double")
    got = {r.rp_years: r.a for r in hd.synthetic_set(curves).collect()}
    assert got == {2: 45.0, 5: pytest.approx(52.8), 10: 60.0, 25: pytest.approx(69.0), 50: pytest.approx(76.8), 100: pytest.approx(84.0)}
    full = hd.synthetic_set(curves)
    assert hd.design_curve(full, 25).first().a == pytest.approx(69.0)
    assert hd.design_curve(full, 7).first().rp_years == 2
    assert hd.nearest_period(full, 17.5).first().rp_years == 10
    assert [r.intensity for r in hd.intensities_at(curves, 15.0).collect()] == [pytest.approx(60 / 25**0.8)]
    points = [(1, 10, float(t), 96 / (t + 12) ** 0.82) for t in (5, 10, 15, 30, 60, 120, 180)]
    fitted = hd.fit_idf_curves(spark.createDataFrame(points, "network_id bigint, rp_years int, duration_min double, intensity double"), ["network_id", "rp_years"]).first()
    assert (fitted.a, fitted.b, fitted.c) == (pytest.approx(96, rel=0.02), pytest.approx(12, abs=0.5), pytest.approx(0.82, abs=0.02))


def test_inlets(spark):
    assert value(spark, il.gutter_spread(L(3.0), L(0.016), L(0.02), L(0.01))) == pytest.approx(10.94, abs=0.3)
    assert value(spark, il.gutter_spread(L(0.0), L(0.016), L(0.02), L(0.01))) == 0
    assert [value(spark, il.inlet_kind(L(x))) for x in (" Curb ", "COMBO", "sag", "what")] == ["curb_opening", "combination", "sag_grate", None]
    flows = spark.createDataFrame([(k, 3.0) for k in ("grate_on_grade", "curb_opening", "combination", "sag_grate", "sag_curb")], "kind string, design_q double")
    got = {r.kind: r for r in il.check_inlets(flows).collect()}
    assert got["combination"].efficiency == got["grate_on_grade"].efficiency and not got["grate_on_grade"].ok
    assert got["grate_on_grade"].capacity_cfs + got["grate_on_grade"].bypass_cfs == pytest.approx(3.0)
    assert got["sag_grate"].capacity_cfs == pytest.approx(min(3 * 5 * 0.3**1.5, 0.67 * 3 * math.sqrt(64.4 * 0.3)))
    assert got["sag_curb"].capacity_cfs == pytest.approx(2.3 * (4 + 2.7) * 0.3**1.5) and got["sag_curb"].efficiency == 1
    deep = il.check_inlets(flows.filter("kind = 'sag_curb'"), InletGeometry(sag_ponding_depth_ft=2.0)).first()
    assert deep.capacity_cfs == pytest.approx(0.67 * 0.5 * 4 * math.sqrt(64.4 * 1.75)) and deep.ok


def test_access_hole(spark):
    assert value(spark, ah.base_factor(L(4.0), L(1.0), L(1.0))) == pytest.approx(0.4)
    assert value(spark, ah.base_factor(L(4.0), L(1.0), L(0.0))) == pytest.approx(1.4 * 4**0.15)
    assert value(spark, ah.depth_factor(L(1.5), L(1.5))) == pytest.approx(0.5) and value(spark, ah.depth_factor(L(6.0), L(1.5))) == 1
    assert value(spark, ah.diameter_factor(L(6.0), L(1.5), L(1.0))) == pytest.approx(1.5**3) and value(spark, ah.diameter_factor(L(1.0), L(1.5), L(1.0))) == 1
    assert value(spark, ah.plunge_factor(L(3.0), L(1.0), L(1.0))) == pytest.approx(1 + 0.2 * 3 * 2)
    args = (5.0, 1.5, 4.0, 0.3, 2.0, 1.2, 1.0)
    one = solvers.access_hole_loss(*[np.array([x]) for x in args])[0]
    assert value(spark, ah.head_loss(L(5.0), L(4.0), L(1.5), L(0.3), L(2.0), L(1.2))) == pytest.approx(one)
    assert value(spark, ah.deflection_cos(*map(L, (0.0, 1.0, 0.0, 0.0, 1.0, 0.0)))) == pytest.approx(0, abs=1e-12)
    assert value(spark, ah.deflection_cos(*map(L, (0.0, 0.0, 0.0, 0.0, 1.0, 0.0)))) == 1


def polygon(*points):
    return F.array(*[F.struct(L(float(x)).alias("x"), L(float(y)).alias("y")) for x, y in points])


def test_geometry_and_units(spark):
    square = polygon((0, 0), (10, 0), (10, 10), (0, 10))
    assert value(spark, ge.shoelace_area(square)) == 100 and value(spark, ge.shoelace_area(polygon((0, 0), (1, 1)))) == 0
    assert tuple(value(spark, ge.centroid(square))) == (5.0, 5.0) and tuple(value(spark, ge.centroid(polygon((0, 0), (2, 4))))) == (1.0, 2.0)
    assert value(spark, ge.point_in_polygon(L(5.0), L(5.0), square)) and not value(spark, ge.point_in_polygon(L(15.0), L(5.0), square))
    p = value(spark, ge.segment_projection(*map(L, (5.0, 3.0, 0.0, 0.0, 10.0, 0.0))))
    assert (p.x, p.y, p.t, p.distance) == (5.0, 0.0, 0.5, 3.0)
    assert [value(spark, ge.snap(L(x), L(5.0))) for x in (2.5, -2.5, 7.4)] == [5.0, -5.0, 5.0]
    assert [value(spark, un.nearest_metric_mm(L(x))) for x in (0.61, 0.31, 0.92, 1.79)] == [600, 300, 900, 1800]
    assert value(spark, un.to_feet(L(0.3048), L("si"))) == 1 and value(spark, un.to_acres(L(1.0), L("us_customary"))) == 1


def test_sql_functions(spark):
    names = registry.register(spark)
    assert len(names) == 7
    row = spark.sql("SELECT manning_full_flow_circular(0.013D, 0.005D, 2D) q, normal_depth_circular(0.525D, 0.013D, 0.0033D, 8D/12D) y, critical_depth_circular(10D, 2D) c, kirpich_tc(500D, 0.01D) k, rational_peak(0.85D, 5.1D, 2D) r, tr55_sheet_flow(200D, 0.01D, 0.011D, 2.5D) t").first()
    assert row.q == pytest.approx(16.04, abs=0.02) and row.y == pytest.approx(0.433, abs=0.002) and row.k == pytest.approx(5.5, abs=0.02) and row.t == pytest.approx(3.15, abs=0.03)
