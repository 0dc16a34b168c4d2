"""Manning and section geometry as Column expressions; closed forms stay in whole-stage code generation.

Arguments are Columns or column names. Sections are (shape, rise, span); any other shape than
rectangular, elliptical and arch is circular with diameter `rise`.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from culvert.functions import solvers
from culvert.schema import G_US, K_US


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def positive(condition: Column, value: Column, other=0.0) -> Column:
    """The value where the condition holds; ANSI mode divides only there."""
    return F.when(condition, value).otherwise(F.lit(other))


def circular_angle(y, d) -> Column:
    """Central angle of the wetted arc; depth is held between 0 and the diameter."""
    y, d = col(y), col(d)
    inside = F.least(F.greatest(y, F.lit(0.0)), d)
    return positive(d > 0, 2.0 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1.0 - 2.0 * inside / d))))


def circular_geometry(y, d) -> Column:
    """struct(area, perimeter, radius, top)."""
    d, t = col(d), circular_angle(y, d)
    area, perimeter = d * d / 8.0 * (t - F.sin(t)), d * t / 2.0
    return F.struct(area.alias("area"), perimeter.alias("perimeter"), positive(perimeter > 0, area / perimeter).alias("radius"), (d * F.sin(t / 2.0)).alias("top"))


def full_area(d) -> Column:
    return F.lit(math.pi) * col(d) * col(d) / 4.0


def manning_q(n, s, area, radius, k: float = K_US) -> Column:
    """k/n A R^(2/3) S^(1/2); a negative slope counts as 0, n <= 0 gives 0."""
    n = col(n)
    return positive(n > 0, F.lit(k) / n * col(area) * F.pow(col(radius), F.lit(2.0 / 3.0)) * F.sqrt(F.greatest(col(s), F.lit(0.0))))


def conveyance(n, area, radius, k: float = K_US) -> Column:
    n = col(n)
    return positive(n > 0, F.lit(k) / n * col(area) * F.pow(col(radius), F.lit(2.0 / 3.0)))


def full_flow_capacity(n, s, d, k: float = K_US) -> Column:
    return manning_q(n, s, full_area(d), col(d) / 4.0, k)


def circular_q(n, s, d, y, k: float = K_US) -> Column:
    g = circular_geometry(y, d)
    return manning_q(n, s, g["area"], g["radius"], k)


def max_capacity(n, s, d, k: float = K_US) -> Column:
    """Largest open-channel flow of a circular pipe: at the 1876th of 2000 depths, for any diameter."""
    return circular_q(n, s, d, col(d) * solvers.CIRCLE_PEAK / solvers.GRID, k)


def max_capacity_depth(n, s, d) -> Column:
    return positive((col(n) > 0) & (col(s) > 0), col(d) * solvers.CIRCLE_PEAK / solvers.GRID)


def slope_of(invert_up, invert_dn, length) -> Column:
    length = col(length)
    return positive(length > 0, (col(invert_up) - col(invert_dn)) / length)


def manning_slope(slope, min_slope=0.001) -> Column:
    """The slope, or min_slope for a reach that is flat to 1e-6."""
    return F.when(F.abs(col(slope)) < 1e-6, col(min_slope)).otherwise(col(slope))


def velocity_full(capacity, area) -> Column:
    return positive(col(area) > 0, col(capacity) / col(area))


def pct_full(q, capacity) -> Column:
    return positive(col(capacity) > 0, col(q) / col(capacity))


def regime(normal_depth, critical_depth) -> Column:
    """pressurized without a normal depth; subcritical, critical or supercritical by a band of 2 %."""
    yn, yc = col(normal_depth), col(critical_depth)
    return (
        F.when(yn.isNull(), "pressurized")
        .when(yc <= 0, "subcritical")
        .when(yn > yc * 1.02, "subcritical")
        .when(yn < yc * 0.98, "supercritical")
        .otherwise("critical")
    )


def capacity_unavailable(slope) -> Column:
    """Adverse reaches have no Manning capacity."""
    return col(slope) < -1e-6


def report_surcharged(surcharged, slope) -> Column:
    return col(surcharged) & ~capacity_unavailable(slope)


def capacity_label(surcharged, slope) -> Column:
    return F.when(capacity_unavailable(slope), "N/A").when(col(surcharged), "SURCHARGED").otherwise("ok")


def section_area_full(shape, rise, span) -> Column:
    shape, rise, span = col(shape), col(rise), col(span)
    wall = F.greatest(rise - span / 2.0, F.lit(0.0))
    return (
        F.when(shape == "rectangular", rise * span)
        .when(shape == "elliptical", F.lit(math.pi) * span * rise / 4.0)
        .when(shape == "arch", span * wall + F.lit(math.pi) * span * span / 8.0)
        .otherwise(full_area(rise))
    )


def ellipse_perimeter(rise, span) -> Column:
    """Perimeter of an ellipse by its series in ((span - rise) / (span + rise))^2, 40 terms."""
    rise, span = col(rise), col(span)
    factors = [1.0]
    for k in range(1, 40):
        factors.append(factors[-1] * ((2 * k - 3) / (2 * k)) ** 2)
    h = F.pow((span - rise) / (span + rise), F.lit(2.0))
    series = F.lit(factors[-1])
    for c in reversed(factors[:-1]):
        series = series * h + c
    return positive(span + rise > 0, F.lit(math.pi) * (span + rise) / 2.0 * series)


def section_perimeter_full(shape, rise, span) -> Column:
    shape, rise, span = col(shape), col(rise), col(span)
    wall = F.greatest(rise - span / 2.0, F.lit(0.0))
    return (
        F.when(shape == "rectangular", 2.0 * (rise + span))
        .when(shape == "elliptical", ellipse_perimeter(rise, span))
        .when(shape == "arch", span + 2.0 * wall + F.lit(math.pi) * span / 2.0)
        .otherwise(F.lit(math.pi) * rise)
    )


def equal_area_diameter(shape, rise, span) -> Column:
    """Diameter of the circle with the section's full area."""
    return F.sqrt(4.0 * section_area_full(shape, rise, span) / F.lit(math.pi))


# The kernels below iterate over sections of mixed shapes; they run on Arrow batches with NumPy.


def _udf(f):
    return F.pandas_udf(f, T.DoubleType())


@_udf
def _normal(q: pd.Series, n: pd.Series, s: pd.Series, shape: pd.Series, rise: pd.Series, span: pd.Series) -> pd.Series:
    return pd.Series(solvers.normal_depth(q.to_numpy(float), n.to_numpy(float), s.to_numpy(float), solvers.Sections.of(shape, rise, span)))


@_udf
def _critical(q: pd.Series, shape: pd.Series, rise: pd.Series, span: pd.Series) -> pd.Series:
    return pd.Series(solvers.critical_depth(q.to_numpy(float), solvers.Sections.of(shape, rise, span)))


@_udf
def _max_capacity(n: pd.Series, s: pd.Series, shape: pd.Series, rise: pd.Series, span: pd.Series) -> pd.Series:
    return pd.Series(solvers.max_capacity(n.to_numpy(float), s.to_numpy(float), solvers.Sections.of(shape, rise, span))[0])


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("area", "perimeter", "radius", "top")]))
def _geometry(y: pd.Series, shape: pd.Series, rise: pd.Series, span: pd.Series) -> pd.DataFrame:
    a, p, r, t = solvers.Sections.of(shape, rise, span).geometry(y.to_numpy(float))
    return pd.DataFrame({"area": a, "perimeter": p, "radius": r, "top": t})


def _section(shape, rise, span):
    return (F.coalesce(col(shape), F.lit("circular")), col(rise), F.coalesce(col(span), col(rise)))


def _steps(width: Column) -> Column:
    """How often a bracket is halved until it is narrower than the tolerance."""
    return F.least(F.lit(200), F.greatest(F.lit(1), (F.floor(F.log2(width / solvers.TOLERANCE)) + 1).cast("int")))


def _above(value: Column) -> Column:
    """A divisor: ANSI mode fails on 0."""
    return F.greatest(value, F.lit(1e-300))


def _tabled(x: Column, table: solvers.DepthTable) -> Column:
    """The table's polynomial at x (0 to 1 of its range): lookups and products, compiled with the rest."""
    count = len(table.pieces)
    place = F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * float(count)
    piece = F.least(F.floor(place).cast("int"), F.lit(count - 1))
    z = 2.0 * (place - piece) - 1.0
    total = F.lit(0.0)
    for power in reversed(table.pieces.T):
        total = total * z + F.get(F.array(*[F.lit(float(c)) for c in power]), piece)
    return total


def _latticed(y: Column, lo: Column, hi: Column) -> Column:
    """The middle of the cell of y, of the cells that halving [lo, hi] ends in."""
    cells = F.pow(F.lit(2.0), _steps(hi - lo))
    width = (hi - lo) / cells
    cell = F.least(F.greatest(F.floor((y - lo) / _above(width)).cast("double"), F.lit(0.0)), cells - 1.0)
    return lo + (cell + 0.5) * width


def _normal_circle(q: Column, n: Column, s: Column, d: Column) -> Column:
    table = solvers.normal_table()
    share = q * n / _above(K_US * table.unit * F.sqrt(F.greatest(s, F.lit(0.0))) * F.pow(d, F.lit(8.0 / 3.0)))
    x = F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.pow(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(3.0 / 13.0))))
    depth = _latticed(d * _tabled(x, table), F.lit(0.0), d * solvers.CIRCLE_PEAK / solvers.GRID)
    # A factor, not a branch around the depth: only what every row needs is computed once.
    return depth * F.when(q <= 0, 0.0).when(q <= max_capacity(n, s, d), 1.0)


def _critical_circle(q: Column, d: Column, g: float) -> Column:
    table = solvers.critical_table()
    v = F.pow(q * q / _above(g * F.pow(d, F.lit(5.0))), F.lit(0.125))
    depth = _latticed(d * _tabled(v / (1.0 + v) / table.top, table), 1e-6 * d, 0.999 * d)
    return depth * F.when(q <= 0, 0.0).when(q.isNotNull(), 1.0)


def _halved(lo: Column, hi: Column, given: dict[str, Column], goes_up) -> Column:
    """The middle of [lo, hi] halved until narrower than the tolerance, about 25 steps in the JVM.
    `goes_up(mid, given)` keeps the upper half; what is given is computed once a row."""
    steps = _steps(hi - lo)
    bracket = lambda lo, hi, given: F.struct(lo.alias("lo"), hi.alias("hi"), given.alias("given"))

    def halve(acc, _):
        mid = 0.5 * (acc["lo"] + acc["hi"])
        return F.when(goes_up(mid, acc["given"]), bracket(mid, acc["hi"], acc["given"])).otherwise(bracket(acc["lo"], mid, acc["given"]))

    start = bracket(lo, hi, F.struct(*[c.cast("double").alias(k) for k, c in given.items()]))
    return F.aggregate(F.sequence(F.lit(1), steps), start, halve, lambda acc: 0.5 * (acc["lo"] + acc["hi"]))


def _box(y: Column, span: Column) -> tuple[Column, Column, Column]:
    """Area, perimeter and top width of a box at a depth inside of it."""
    return span * y, span + 2.0 * y, span


#: Shapes whose depths Catalyst expressions find; the others' run in NumPy.
_CLOSED = ("circular", "rectangular")


def normal_depth(q, n, s, rise, shape="circular", span=None) -> Column:
    """Depth of uniform flow; 0 without flow, NULL where the flow exceeds the largest open-channel flow
    or anything is missing.

    `shape` is a Column, or the name of a shape for all rows. Named circles (a table of polynomials in
    one dimensionless flow) and boxes (halving) need no Python worker; shapes by row run in NumPy.
    """
    if not (isinstance(shape, str) and shape in _CLOSED):
        shape = F.lit(shape) if isinstance(shape, str) else shape
        found = _normal(col(q), col(n), col(s), *_section(shape, rise, rise if span is None else span))
        return F.when(~F.isnan(found), found)
    q, n, s, rise = (col(c).cast("double") for c in (q, n, s, rise))
    if shape == "circular":
        return _normal_circle(q, n, s, rise)
    span = rise if span is None else col(span).cast("double")
    area, perimeter, _ = _box(rise, span)
    q_max = manning_q(n, s, area, positive(perimeter > 0, area / perimeter))
    # K/n A^(5/3) P^(-2/3) S^(1/2) > Q, cubed: no fractional power in the loop.
    unit = K_US * F.sqrt(s)
    given = {"cube": F.pow(positive(unit > 0, q * n / unit), F.lit(3.0)), "span": span}

    def goes_up(mid, g):
        area, perimeter, _ = _box(mid, g["span"])
        return F.pow(area, F.lit(5.0)) <= g["cube"] * F.pow(perimeter, F.lit(2.0))

    whole = q.isNotNull() & n.isNotNull() & s.isNotNull() & rise.isNotNull() & span.isNotNull()
    return F.when(whole & (q <= 0), F.lit(0.0)).when(whole & (q <= q_max), _halved(F.lit(0.0), rise, given, goes_up))


def critical_depth(q, rise, shape="circular", span=None, g: float = G_US) -> Column:
    """Depth at which Q^2 T = g A^3; 0 without flow. Named circles and boxes need no Python worker."""
    if not (isinstance(shape, str) and shape in _CLOSED):
        shape = F.lit(shape) if isinstance(shape, str) else shape
        return _critical(col(q) * F.lit(math.sqrt(G_US / g)), *_section(shape, rise, rise if span is None else span))
    q, rise = col(q).cast("double"), col(rise).cast("double")
    if shape == "circular":
        return _critical_circle(q, rise, g)
    span = rise if span is None else col(span).cast("double")
    given = {"share": q * q / g, "span": span}

    def goes_up(mid, v):
        area, _, top = _box(mid, v["span"])
        return v["share"] * top > F.pow(area, F.lit(3.0))

    whole = q.isNotNull() & rise.isNotNull() & span.isNotNull()
    return F.when(whole & (q <= 0), F.lit(0.0)).when(whole, _halved(1e-6 * rise, 0.999 * rise, given, goes_up))


def section_geometry(y, shape, rise, span) -> Column:
    """struct(area, perimeter, radius, top) of any section at a depth."""
    return _geometry(col(y), *_section(shape, rise, span))


def section_full_capacity(n, s, shape, rise, span) -> Column:
    shape, rise, span = _section(shape, rise, span)
    area, perimeter = section_area_full(shape, rise, span), section_perimeter_full(shape, rise, span)
    n = col(n)
    radius = positive(perimeter > 0, area / perimeter)
    return positive(n > 0, K_US / n * area * F.pow(radius, F.lit(2.0 / 3.0)) * F.sqrt(F.greatest(col(s), F.lit(0.0))))


def section_max_capacity(n, s, shape, rise, span) -> Column:
    return _max_capacity(col(n), col(s), *_section(shape, rise, span))
