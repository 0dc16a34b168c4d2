"""The registered queries: each runs an operator over a whole view; SQL says the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.functions import access_hole as ah
from culvert.functions import geometry as ge
from culvert.functions import hydraulics as hy
from culvert.functions import hydrology as hd
from culvert.functions import inlets as il
from culvert.functions import units as un
from culvert.operators import design, graph, network, validation
from culvert.plans import views
from culvert.schema import InletGeometry, Options

QUERIES: dict = {}
SQL: dict[str, str] = {}
_K = "network_id", "ord"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(value: Column | str, name: str, digits: int = 6) -> Column:
    return F.round(hy.col(value), digits).alias(name)


# --- SQL pieces -------------------------------------------------------------------------------

_PI = "pi()"


def _theta(y: str, d: str) -> str:
    return f"(2.0::DOUBLE * acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - 2.0::DOUBLE * ({y}) / ({d})))))"


def _circle_q(y: str, d: str, n: str, s: str) -> str:
    """Manning flow of a circle at depth y, from area and perimeter of the wetted arc."""
    t = _theta(y, d)
    area = f"(({d}) * ({d}) / 8.0::DOUBLE * ({t} - sin({t})))"
    perimeter = f"(({d}) * {t} / 2.0::DOUBLE)"
    return f"(1.49::DOUBLE / ({n}) * {area} * pow(CASE WHEN {perimeter} > 0 THEN {area} / {perimeter} ELSE 0.0::DOUBLE END, 2.0::DOUBLE / 3.0::DOUBLE) * sqrt(greatest({s}, 0.0::DOUBLE)))"


def _bisected(lo: str, hi: str, up: str) -> str:
    """Midpoint after halving a bracket until it is narrower than 1e-7; `up` says whether m keeps the upper half."""
    step = (
        "CASE WHEN a.stop THEN a ELSE "
        "CASE WHEN " + up.replace("@m", "(0.5::DOUBLE * (a.lo + a.hi))") + " THEN "
        "{'lo': 0.5::DOUBLE * (a.lo + a.hi), 'hi': a.hi, 'stop': a.hi - 0.5::DOUBLE * (a.lo + a.hi) < 1e-7} ELSE "
        "{'lo': a.lo, 'hi': 0.5::DOUBLE * (a.lo + a.hi), 'stop': 0.5::DOUBLE * (a.lo + a.hi) - a.lo < 1e-7} END END"
    )
    start = f"{{'lo': CAST({lo} AS DOUBLE), 'hi': CAST({hi} AS DOUBLE), 'stop': false}}"
    found = f"list_reduce(list_transform(range(40), lambda i: {start}), lambda a, i: {step})"
    return f"(0.5::DOUBLE * (({found}).lo + ({found}).hi))"


_FULL = "(1.49::DOUBLE / n * (pi() * diameter * diameter / 4.0::DOUBLE) * pow(diameter / 4.0::DOUBLE, 2.0::DOUBLE / 3.0::DOUBLE) * sqrt(slope))"
_QMAX = _circle_q("diameter * 1876 / 2000", "diameter", "n", "slope")
_FLOW = "(60.0::DOUBLE / pow(greatest(tc_inlet, 10.0::DOUBLE) + 10.0::DOUBLE, 0.8::DOUBLE) * least(c, 1.0::DOUBLE) * area_ac)"
_YN = _bisected("0", "diameter * 1876 / 2000", f"{_circle_q('@m', 'diameter', 'n', 'slope')} <= q")
_FLOWS = f"SELECT *, {_FLOW} AS q, {_FULL} AS capacity, {_QMAX} AS q_max FROM ({views.REACH})"


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.reach(spark, sf_dir)
    i = hd.idf_intensity(F.greatest("tc_inlet", F.lit(10.0)), F.lit(60.0), F.lit(10.0), F.lit(0.8))
    return r.withColumns({"q": i * hd.effective_ca("c", "area_ac"), "capacity": hy.full_flow_capacity("n", "slope", "diameter"), "q_max": hy.max_capacity("n", "slope", "diameter")})


# --- Reaches ----------------------------------------------------------------------------------


@query(f"""SELECT network_id, ord, round(q, 6) AS q, round(capacity, 6) AS capacity, round(q_max, 6) AS q_max, round(q / capacity, 6) AS pct_full,
       q > q_max AS surcharged, CASE WHEN q > q_max THEN 'SURCHARGED' ELSE 'ok' END AS status FROM ({_FLOWS})""")
def reach_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    over = F.col("q") > F.col("q_max")
    return _flows(spark, sf_dir).select(*_K, r6("q", "q"), r6("capacity", "capacity"), r6("q_max", "q_max"), r6(hy.pct_full("q", "capacity"), "pct_full"), over.alias("surcharged"), hy.capacity_label(over, "slope").alias("status"))


_Y = "0.3::DOUBLE * diameter"


@query(f"""SELECT network_id, ord, round({_theta(_Y, 'diameter')}, 6) AS theta, round(diameter * diameter / 8.0::DOUBLE * ({_theta(_Y, 'diameter')} - sin({_theta(_Y, 'diameter')})), 6) AS area,
       round(diameter * {_theta(_Y, 'diameter')} / 2.0::DOUBLE, 6) AS perimeter, round(diameter * sin({_theta(_Y, 'diameter')} / 2.0::DOUBLE), 6) AS top,
       round({_circle_q(_Y, 'diameter', 'n', 'slope')}, 6) AS q FROM ({views.REACH})""")
def circular_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = 0.3 * F.col("diameter")
    g = hy.circular_geometry(y, "diameter")
    return views.reach(spark, sf_dir).select(*_K, r6(hy.circular_angle(y, "diameter"), "theta"), r6(g["area"], "area"), r6(g["perimeter"], "perimeter"), r6(g["top"], "top"), r6(hy.circular_q("n", "slope", "diameter", y), "q"))


@query(f"SELECT network_id, ord, CASE WHEN q <= q_max THEN round({_YN}, 4) END AS normal_depth FROM ({_FLOWS})")
def normal_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flows(spark, sf_dir).select(*_K, r6(hy.normal_depth("q", "n", "slope", "diameter"), "normal_depth", 4))


def _area_at(y: str) -> str:
    return f"(diameter * diameter / 8.0::DOUBLE * ({_theta(y, 'diameter')} - sin({_theta(y, 'diameter')})))"


_YC = _bisected("1e-6 * diameter", "0.999 * diameter", f"q * q * diameter * sin({_theta('@m', 'diameter')} / 2.0::DOUBLE) - 32.2::DOUBLE * pow({_area_at('@m')}, 3) > 0")


@query(f"SELECT network_id, ord, round({_YC}, 4) AS critical_depth FROM ({_FLOWS})")
def critical_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flows(spark, sf_dir).select(*_K, r6(hy.critical_depth("q", "diameter"), "critical_depth", 4))


@query(f"""SELECT network_id, ord, CASE WHEN q > q_max THEN 'pressurized' WHEN yc <= 0 THEN 'subcritical' WHEN yn > 1.02 * yc THEN 'subcritical' WHEN yn < 0.98 * yc THEN 'supercritical' ELSE 'critical' END AS regime
       FROM (SELECT *, {_YN} AS yn, {_YC} AS yc FROM ({_FLOWS}))""")
def flow_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flows(spark, sf_dir).withColumns({"yn": hy.normal_depth("q", "n", "slope", "diameter"), "yc": hy.critical_depth("q", "diameter")})
    return f.select(*_K, hy.regime("yn", "yc").alias("regime"))


_SHAPED = f"SELECT *, ['circular', 'rectangular', 'elliptical', 'arch'][1 + ord % 4] AS shape, diameter AS rise, 1.5::DOUBLE * diameter AS span FROM ({views.REACH})"
_ELL = """(2.0::DOUBLE * pi() / 256.0::DOUBLE / 3.0::DOUBLE * list_sum(list_transform(range(257), lambda i:
    CASE WHEN i = 0 OR i = 256 THEN 1.0::DOUBLE WHEN i % 2 = 1 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END
    * sqrt(pow(0.75::DOUBLE * rise * cos(i * pi() / 256.0::DOUBLE), 2) + pow(rise / 2.0::DOUBLE * sin(i * pi() / 256.0::DOUBLE), 2)))))"""


@query(f"""SELECT network_id, ord, shape, round(1.49::DOUBLE / n * area * pow(area / perimeter, 2.0::DOUBLE / 3.0::DOUBLE) * sqrt(slope), 6) AS capacity, round(area, 6) AS area, round(sqrt(4.0::DOUBLE * area / pi()), 6) AS equal_area_diameter
       FROM (SELECT *, CASE shape WHEN 'rectangular' THEN rise * span WHEN 'elliptical' THEN pi() * rise * span / 4.0::DOUBLE
                       WHEN 'arch' THEN span * greatest(rise - span / 2.0::DOUBLE, 0.0::DOUBLE) + pi() * span * span / 8.0::DOUBLE ELSE pi() * rise * rise / 4.0::DOUBLE END AS area,
                    CASE shape WHEN 'rectangular' THEN 2.0::DOUBLE * (rise + span) WHEN 'elliptical' THEN {_ELL}
                       WHEN 'arch' THEN span + 2.0::DOUBLE * greatest(rise - span / 2.0::DOUBLE, 0.0::DOUBLE) + pi() * span / 2.0::DOUBLE ELSE pi() * rise END AS perimeter
             FROM ({_SHAPED}))""")
def section_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.get(F.array(*map(F.lit, ("circular", "rectangular", "elliptical", "arch"))), F.col("ord") % 4)
    r = views.reach(spark, sf_dir).withColumns({"shape": shape, "rise": F.col("diameter"), "span": 1.5 * F.col("diameter")})
    r = r.withColumn("capacity", hy.section_full_capacity("n", "slope", "shape", "rise", "span"))
    return r.select(*_K, "shape", r6("capacity", "capacity"), r6(hy.section_area_full("shape", "rise", "span"), "area"), r6(hy.equal_area_diameter("shape", "rise", "span"), "equal_area_diameter"))


# --- Rainfall and time ------------------------------------------------------------------------


@query(f"""SELECT network_id, ord, round(60.0::DOUBLE / pow(tc_inlet + 10.0::DOUBLE, 0.8::DOUBLE), 6) AS intensity,
       round(0.0078::DOUBLE * pow(length, 0.77::DOUBLE) * pow(slope, -0.385::DOUBLE), 6) AS kirpich,
       round(0.42::DOUBLE * pow(0.011::DOUBLE * length, 0.8::DOUBLE) / (sqrt(3.0::DOUBLE) * pow(slope, 0.4::DOUBLE)), 6) AS sheet,
       round(1.8::DOUBLE * (1.1::DOUBLE - c) * sqrt(length) / cbrt(100.0::DOUBLE * slope), 6) AS faa,
       CASE WHEN ord * 9 <= 10 THEN 1.0::DOUBLE WHEN ord * 9 <= 25 THEN 1.1::DOUBLE WHEN ord * 9 <= 50 THEN 1.2::DOUBLE ELSE 1.25::DOUBLE END AS cf,
       round(c * 4.0::DOUBLE * area_ac, 6) AS rational FROM ({views.REACH})""")
def times_and_intensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reach(spark, sf_dir).select(
        *_K, r6(hd.idf_intensity("tc_inlet", F.lit(60.0), F.lit(10.0), F.lit(0.8)), "intensity"), r6(hd.tc_minutes("kirpich", "length", "slope"), "kirpich"),
        r6(hd.tc_minutes("tr55", "length", "slope"), "sheet"), r6(hd.tc_minutes("faa", "length", "slope", "c"), "faa"), hd.frequency_factor(F.col("ord") * 9).alias("cf"), r6(hd.rational_peak("c", F.lit(4.0), "area_ac"), "rational"),
    )


_SEGMENT = """CASE ord % 3 WHEN 0 THEN 0.42::DOUBLE * pow(0.02::DOUBLE * length, 0.8::DOUBLE) / (sqrt(3.0::DOUBLE) * pow(slope, 0.4::DOUBLE))
    WHEN 1 THEN length / (CASE WHEN ord % 2 = 0 THEN 20.33::DOUBLE ELSE 16.1346::DOUBLE END * sqrt(slope)) / 60.0::DOUBLE
    ELSE length / (1.49::DOUBLE / 0.02::DOUBLE * pow(diameter / 4.0::DOUBLE, 2.0::DOUBLE / 3.0::DOUBLE) * sqrt(slope)) / 60.0::DOUBLE END"""


@query(f"""SELECT network_id, ord, round(minutes, 6) AS minutes, round(sum(minutes) OVER (PARTITION BY network_id ORDER BY ord), 6) AS running_minutes
       FROM (SELECT *, {_SEGMENT} AS minutes FROM ({views.REACH}))""")
def tr55_worksheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hd.worksheet(_segments(spark, sf_dir)).select("network_id", F.col("seq").alias("ord"), r6("minutes", "minutes"), r6("running_minutes", "running_minutes"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ("sheet", "shallow", "channel"))), F.col("ord") % 3)
    return views.reach(spark, sf_dir).select(
        "network_id", F.lit("N").alias("node_id"), F.col("ord").alias("seq"), kind.alias("kind"), F.col("length").alias("length_ft"), "slope", F.lit(0.02).alias("n"),
        (F.col("ord") % 2 == 0).alias("paved"), F.lit(3.0).alias("p2_in"), (F.col("diameter") / 4.0).alias("hydraulic_radius_ft"),
    )


@query(f"SELECT network_id, round(sum({_SEGMENT}), 6) AS tc_minutes FROM ({views.REACH}) GROUP BY network_id")
def tr55_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hd.worksheet_tc(_segments(spark, sf_dir)).select("network_id", r6("tc_minutes", "tc_minutes"))


_PERIODS = {2: 0.75, 10: 1.0, 25: 1.15, 50: 1.28, 100: 1.40}


def flows_of_curves(reaches: DataFrame, curves: DataFrame) -> DataFrame:
    """Design flows of reaches (network_id, id, tc_inlet, ca) in six periods, by the curve of their
    own network (network_id, rp_years, a, b, c; one row a network)."""
    each = reaches.join(hd.synthetic_set(curves), "network_id")
    return each.withColumn("design_q", hd.idf_intensity(F.greatest("tc_inlet", F.lit(10.0)), "a", "b", "c") * F.col("ca"))


@query(
    "SELECT network_id, id, "
    + ", ".join(f'round(max(CASE WHEN rp = {rp} THEN q END), 6) AS "{rp}"' for rp in (2, 5, 10, 25, 50, 100))
    + f""" FROM (SELECT network_id, 'P' || ord AS id, rp, f * {_FLOW} AS q FROM ({views.REACH}),
        (VALUES (2, 0.75::DOUBLE), (5, 0.88::DOUBLE), (10, 1.0::DOUBLE), (25, 1.15::DOUBLE), (50, 1.28::DOUBLE), (100, 1.40::DOUBLE)) t(rp, f)) GROUP BY network_id, id"""
)
def peak_flows_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    curves = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("network_id"), F.lit(10).alias("rp_years"), F.lit(60.0).alias("a"), F.lit(10.0).alias("b"), F.lit(0.8).alias("c")).distinct()
    r = views.reach(spark, sf_dir).select("network_id", F.concat(F.lit("P"), F.col("ord").cast("string")).alias("id"), "tc_inlet", hd.effective_ca("c", "area_ac").alias("ca"))
    periods = [2, 5, 10, 25, 50, 100]
    flows = flows_of_curves(r, curves)
    return network.peak_flow_pivot(flows, periods).select("network_id", "id", *[F.round(f"`{p}`", 6).alias(str(p)) for p in periods])


# --- Inlets and access holes ------------------------------------------------------------------

_T = "pow(q * 0.016::DOUBLE / (0.56::DOUBLE * pow(0.02::DOUBLE, 1.67::DOUBLE) * sqrt(slope)), 1.0::DOUBLE / 2.67::DOUBLE)"
_SPREADS = f"SELECT *, {_T} AS t, q / (0.5::DOUBLE * 0.02::DOUBLE * pow({_T}, 2)) AS v FROM ({_FLOWS})"


@query(f"""SELECT network_id, ord, round(t, 6) AS spread_ft, round(e, 6) AS efficiency, round(e * q, 6) AS capacity_cfs, round(greatest(q - e * q, 0.0::DOUBLE), 6) AS bypass_cfs, t <= 10.0::DOUBLE AS ok
       FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, rf * eo + (1.0::DOUBLE / (1.0::DOUBLE + 0.15::DOUBLE * pow(v, 1.8::DOUBLE) / (0.02::DOUBLE * pow(2.0::DOUBLE, 2.3::DOUBLE)))) * (1.0::DOUBLE - eo))) AS e
             FROM (SELECT *, CASE WHEN 1.5::DOUBLE >= t THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - pow(1.0::DOUBLE - 1.5::DOUBLE / t, 2.67::DOUBLE) END AS eo,
                          greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - 0.09::DOUBLE * (v - 5.0::DOUBLE))) AS rf FROM ({_SPREADS})))""")
def grate_inlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flows(spark, sf_dir).withColumns({"design_q": F.col("q"), "gutter_slope": F.col("slope")})
    return il.check_inlets(f).select(*_K, *[r6(c, c) for c in ("spread_ft", "efficiency", "capacity_cfs", "bypass_cfs")], "ok")


@query(f"""SELECT network_id, ord, round(lt, 6) AS full_length, round(CASE WHEN 4.0::DOUBLE >= lt THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - pow(1.0::DOUBLE - 4.0::DOUBLE / lt, 1.8::DOUBLE) END, 6) AS efficiency
       FROM (SELECT *, 0.6::DOUBLE * pow(q, 0.42::DOUBLE) * pow(slope, 0.3::DOUBLE) * pow(1.0::DOUBLE / (0.016::DOUBLE * 0.02::DOUBLE), 0.6::DOUBLE) AS lt FROM ({_FLOWS}))""")
def curb_inlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flows(spark, sf_dir).withColumns({**InletGeometry(kind="curb_opening").columns(), "gutter_slope": F.col("slope")})
    return f.select(*_K, r6(il.curb_full_length("q"), "full_length"), r6(il.on_grade_efficiency("q"), "efficiency"))


@query(f"""SELECT network_id, ord, kind, round(cap, 6) AS capacity_cfs, round(greatest(q - cap, 0.0::DOUBLE), 6) AS bypass_cfs, cap >= q AS ok
       FROM (SELECT *, CASE WHEN kind = 'sag_curb' THEN CASE WHEN d <= 0.5::DOUBLE THEN 2.3::DOUBLE * (4.0::DOUBLE + 1.8::DOUBLE * 1.5::DOUBLE) * pow(d, 1.5::DOUBLE)
                    ELSE least(2.3::DOUBLE * (4.0::DOUBLE + 1.8::DOUBLE * 1.5::DOUBLE) * pow(d, 1.5::DOUBLE), 0.67::DOUBLE * 0.5::DOUBLE * 4.0::DOUBLE * sqrt(64.4::DOUBLE * (d - 0.25::DOUBLE))) END
                ELSE least(3.0::DOUBLE * 5.0::DOUBLE * 0.75::DOUBLE * pow(d, 1.5::DOUBLE), 0.67::DOUBLE * 3.0::DOUBLE * 0.75::DOUBLE * sqrt(64.4::DOUBLE * d)) END AS cap
             FROM (SELECT *, CASE WHEN ord % 2 = 0 THEN 'sag_grate' ELSE 'sag_curb' END AS kind, c AS d FROM ({_FLOWS})))""")
def sag_inlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _flows(spark, sf_dir).withColumns({"design_q": F.col("q"), "kind": F.when(F.col("ord") % 2 == 0, "sag_grate").otherwise("sag_curb"), "sag_ponding_depth_ft": F.col("c"), "clogging_fraction": F.lit(0.25)})
    return il.check_inlets(f).select(*_K, "kind", r6("capacity_cfs", "capacity_cfs"), r6("bypass_cfs", "bypass_cfs"), "ok")


@query(f"""SELECT network_id, ord, round(k, 6) AS k, round(k * pow(q / (pi() * diameter * diameter / 4.0::DOUBLE), 2) / 64.4::DOUBLE, 6) AS loss
       FROM (SELECT *, (0.1::DOUBLE * (4.0::DOUBLE / diameter) * (1.0::DOUBLE - sn) + 1.4::DOUBLE * pow(4.0::DOUBLE / diameter, 0.15::DOUBLE) * sn)
               * CASE WHEN tc_inlet / diameter >= 3.2::DOUBLE THEN pow(diameter / (diameter + 0.5::DOUBLE), 3) ELSE least(1.0::DOUBLE, 0.5::DOUBLE * pow(tc_inlet / diameter, 0.6::DOUBLE)) END AS k
             FROM (SELECT *, sqrt(1.0::DOUBLE - c * c) AS sn FROM ({_FLOWS})))""")
def access_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = ah.loss_coefficient(F.lit(4.0), "diameter", "c", "tc_inlet", F.col("diameter") + 0.5)
    v = F.col("q") / hy.full_area("diameter")
    return _flows(spark, sf_dir).select(*_K, r6(k, "k"), r6(ah.head_loss(v, F.lit(4.0), "diameter", "c", "tc_inlet", F.col("diameter") + 0.5), "loss"))


# --- Networks ---------------------------------------------------------------------------------

_CHAIN_Q = f"""WITH RECURSIVE r AS MATERIALIZED ({views.REACH}),
    step(network_id, ord, total_ca, tc, q, travel) AS (
      SELECT network_id, ord, ca, tc, q, CASE WHEN v > 0 THEN length / (v * 60.0::DOUBLE) ELSE 0.0::DOUBLE END FROM (@first)
      UNION ALL
      SELECT network_id, ord, ca, tc, q, CASE WHEN v > 0 THEN length / (v * 60.0::DOUBLE) ELSE 0.0::DOUBLE END FROM (@next))
    SELECT network_id, ord, round(total_ca, 6) AS total_ca, round(tc, 4) AS tc, round(q, 4) AS design_q, round(travel, 4) AS travel_time FROM step"""


def _chain_sql() -> str:
    flow = "60.0::DOUBLE / pow(tc + 10.0::DOUBLE, 0.8::DOUBLE) * ca"
    yn = f"(CASE WHEN q > {_QMAX} THEN diameter ELSE {_YN} END)"
    speed = lambda source: f"SELECT *, q / {_area_at('yn')} AS v FROM (SELECT *, {yn} AS yn FROM (SELECT *, {flow} AS q FROM ({source})))"
    first = "SELECT r.*, least(c, 1.0::DOUBLE) * area_ac AS ca, greatest(tc_inlet, 10.0::DOUBLE) AS tc FROM r WHERE ord = 1"
    following = "SELECT r.*, s.total_ca + least(c, 1.0::DOUBLE) * area_ac AS ca, greatest(r.tc_inlet, 10.0::DOUBLE, s.tc + s.travel) AS tc FROM r JOIN step s ON r.network_id = s.network_id AND r.ord = s.ord + 1"
    return _CHAIN_Q.replace("@first", speed(first)).replace("@next", speed(following))


def _idf(nodes: DataFrame, *periods: int) -> DataFrame:
    curve = lambda rp: F.struct(F.lit(rp).alias("rp_years"), F.lit(60.0 * _PERIODS[rp]).alias("a"), F.lit(10.0).alias("b"), F.lit(0.8).alias("c"))
    return nodes.select("network_id").distinct().select("network_id", F.inline(F.array(*map(curve, periods))))


def _analyzed(spark: SparkSession, sf_dir: str, options: Options = Options()) -> tuple[DataFrame, DataFrame, network.Analysis]:
    nodes, pipes = views.chain(spark, sf_dir)
    return nodes, pipes, network.analyze(nodes, pipes, _idf(nodes.filter("kind = 'outfall'"), 10), options)


@query(_chain_sql())
def chain_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analyzed(spark, sf_dir)[2]
    return a.pipes.select("network_id", F.col("ord").cast("bigint").alias("ord"), r6("total_ca", "total_ca"), r6("tc", "tc", 4), r6("design_q", "design_q", 4), r6("travel_time", "travel_time", 4))


@query()
def chain_grade_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analyzed(spark, sf_dir, Options(tailwater=101.0))[2]
    return network.with_hydraulics(a).select("network_id", "id", r6("hgl_up", "hgl_up", 3), r6("hgl_dn", "hgl_dn", 3), "regime", "report_surcharged", "status")


@query()
def chain_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _analyzed(spark, sf_dir, Options(hec22=True, bend_loss_coeff=0.5))[2]
    return a.nodes.select("network_id", "id", r6("tc", "tc", 4), r6("hgl", "hgl", 3), "surcharge_to_surface")


@query()
def chain_all_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pipes = views.chain(spark, sf_dir)
    a = network.analyze_all_periods(nodes, pipes, _idf(nodes.filter("kind = 'outfall'"), 2, 10, 25, 50, 100))
    return a.pipes.select("network_id", "rp_years", "id", r6("design_q", "design_q", 4), "surcharged")


@query()
def chain_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pipes, a = _analyzed(spark, sf_dir)
    return design.review_analysis(nodes, pipes, a)


@query()
def chain_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pipes, a = _analyzed(spark, sf_dir)
    return design.size_network(pipes, a.pipes).select("network_id", "id", "outcome", r6("recommended_diameter", "recommended_diameter"), r6("velocity", "velocity", 4), r6("pct_full", "pct_full"), "surcharged")


@query(f"""SELECT a.network_id, 'P' || a.ord AS up_id, 'P' || b.ord AS id FROM ({views.REACH}) a JOIN ({views.REACH}) b ON a.network_id = b.network_id AND b.ord = a.ord + 1 WHERE b.diameter + 1e-9 < a.diameter""")
def size_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipes = views.chain(spark, sf_dir)[1]
    up = pipes.select("network_id", F.col("id").alias("up_id"), F.col("to").alias("node"), F.col("diameter").alias("up_d"))
    down = pipes.select("network_id", "id", F.col("from").alias("node"), "diameter")
    return up.join(down, ["network_id", "node"]).filter(F.col("diameter") + 1e-9 < F.col("up_d")).select("network_id", "up_id", "id")


_TRIALS = "[8, 10, 12, 15, 18, 21, 24, 27, 30, 33, 36, 42, 48, 54, 60, 66, 72]"


@query(f"""SELECT network_id, ord, round(coalesce(min(trial), 72) / 12.0::DOUBLE, 6) AS diameter, min(trial) IS NOT NULL AS found FROM (
         SELECT network_id, ord, CASE WHEN q <= {_circle_q('diameter * 1876 / 2000', 'diameter', 'n', 'slope')} + 1e-9 AND q / {_FULL} <= 0.85::DOUBLE + 1e-9 THEN size END AS trial
         FROM (SELECT network_id, ord, q, n, slope, size, size / 12.0::DOUBLE AS diameter FROM (SELECT *, unnest({_TRIALS}) AS size FROM ({_FLOWS}))))
       GROUP BY network_id, ord""")
def smallest_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from culvert.schema import DesignCriteria

    f = _flows(spark, sf_dir).withColumns({"design_q": F.col("q"), "diameter": F.lit(0.0)})  # no pipe yet
    sized = design.size_pipes(f, DesignCriteria(max_velocity=1000.0))
    return sized.select(*_K, r6("recommended_diameter", "diameter"), (F.col("outcome") != "no_solution").alias("found"))


_COSTS = "[12, 15, 18, 21, 24, 27, 30, 33, 36, 42, 48, 54, 60, 66, 72]", "[85.0, 95.0, 110.0, 125.0, 140.0, 160.0, 180.0, 200.0, 225.0, 275.0, 330.0, 390.0, 460.0, 540.0, 625.0]"


@query(f"""SELECT r.network_id, count(*) AS n_pipes, round(sum(length * CASE WHEN d <= 12 THEN 85.0::DOUBLE WHEN d >= 72 THEN 625.0::DOUBLE ELSE lo + (d - a) / (b - a) * (hi - lo) END), 4) AS total_cost
       FROM (SELECT *, diameter * 12.0::DOUBLE + 1.0::DOUBLE AS d FROM ({views.REACH})) r
       LEFT JOIN (SELECT a, lead(a) OVER (ORDER BY a) AS b, lo, lead(lo) OVER (ORDER BY a) AS hi FROM (SELECT unnest({_COSTS[0]})::DOUBLE AS a, unnest({_COSTS[1]})::DOUBLE AS lo)) t ON d > a AND d <= b
       GROUP BY r.network_id""")
def network_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pipes = views.reach(spark, sf_dir, ordered=False).withColumn("diameter", F.col("diameter") + 1.0 / 12.0)
    return design.network_costs(pipes).select("network_id", "n_pipes", r6("total_cost", "total_cost", 4))


# --- Validation -------------------------------------------------------------------------------


@query(f"""WITH l AS ({views.LOOSE}), n AS (SELECT DISTINCT network_id, line FROM l)
       SELECT network_id, 'no_outfall' AS rule, 'error' AS severity, 'network' AS id FROM (SELECT DISTINCT network_id FROM l)
       UNION ALL SELECT network_id, 'duplicate_id', 'error', CAST(line AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY network_id, line ORDER BY ord) AS k FROM l) WHERE k > 1
       UNION ALL SELECT network_id, 'dangling_to', 'error', 'P' || ord FROM l WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.network_id = l.network_id AND n.line = l.line + 1)""")
def validate_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pipes = views.loose(spark, sf_dir)
    return validation.validate(nodes.select("network_id"), nodes, pipes).select("network_id", "rule", "severity", "id")


@query(f"""WITH l AS ({views.LOOSE}), n AS (SELECT DISTINCT network_id, line FROM l)
       SELECT network_id, 'no_outfall' AS rule, 'error' AS severity, 'network' AS id FROM (SELECT DISTINCT network_id FROM l)
       UNION ALL SELECT network_id, 'duplicate_id', 'error', CAST(line AS VARCHAR) FROM (SELECT *, row_number() OVER (PARTITION BY network_id, line ORDER BY ord) AS k FROM l) WHERE k > 1
       UNION ALL SELECT network_id, 'dangling_to', 'error', 'P' || ord FROM l WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.network_id = l.network_id AND n.line = l.line + 1)
       UNION ALL SELECT network_id, 'duplicate_pipe', 'warning', 'P' || ord FROM (SELECT *, row_number() OVER (PARTITION BY network_id, line ORDER BY ord) AS k FROM l) WHERE k > 1
       UNION ALL SELECT network_id, 'no_area', 'warning', CAST(line AS VARCHAR) FROM l WHERE area_ac <= 0""")
def diagnose_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, pipes = views.loose(spark, sf_dir)
    return validation.diagnose(nodes.select("network_id"), nodes, pipes).select("network_id", "rule", "severity", "id")


# --- Graphs -----------------------------------------------------------------------------------

_TREE_CA = """WITH o AS (SELECT o_orderkey, o_custkey, least(0.5::DOUBLE + 0.05::DOUBLE * (o_orderkey % 8), 1.0::DOUBLE) * (0.02::DOUBLE * CAST(o_totalprice AS DOUBLE) / 500000.0::DOUBLE) AS ca FROM orders),
    c AS (SELECT c_custkey, c_nationkey, coalesce(sum(ca), 0) AS ca FROM customer LEFT JOIN o ON o_custkey = c_custkey GROUP BY ALL),
    n AS (SELECT n_nationkey, n_regionkey, coalesce(sum(ca), 0) AS ca FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY ALL),
    r AS (SELECT r_regionkey, coalesce(sum(ca), 0) AS ca FROM region LEFT JOIN n ON n_regionkey = r_regionkey GROUP BY ALL)"""
_TREE_ALL = """SELECT 'o' || o_orderkey AS id, ca FROM o UNION ALL SELECT 'c' || c_custkey, ca FROM c UNION ALL SELECT 'n' || n_nationkey, ca FROM n
    UNION ALL SELECT 'r' || r_regionkey, ca FROM r UNION ALL SELECT 'OUT', sum(ca) FROM r"""


@query(f"{_TREE_CA} SELECT id, round(ca, 6) AS total_ca FROM ({_TREE_ALL})")
def tree_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.accumulate_ca(*views.tree(spark, sf_dir)).select("id", r6("total_ca", "total_ca"))


@query(
    """WITH o AS (SELECT 'o' || o_orderkey AS id, 0 AS level FROM orders), c AS (SELECT c_nationkey, 'c' || c_custkey AS id, max(CASE WHEN o_custkey IS NULL THEN 0 ELSE 1 END) AS level FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
    n AS (SELECT n_regionkey, 'n' || n_nationkey AS id, coalesce(max(level) + 1, 0) AS level FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY ALL), r AS (SELECT 'r' || r_regionkey AS id, coalesce(max(level) + 1, 0) AS level FROM region LEFT JOIN n ON n_regionkey = r_regionkey GROUP BY ALL)
    SELECT id, level FROM o UNION ALL SELECT id, level FROM c UNION ALL SELECT id, level FROM n UNION ALL SELECT id, level FROM r UNION ALL SELECT 'OUT', max(level) + 1 FROM r"""
)
def tree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.levels(*views.tree(spark, sf_dir)).select("id", "level")


@query("SELECT 'o' || o_orderkey AS id FROM orders UNION ALL SELECT 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region UNION ALL SELECT 'OUT'")
def tree_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reaches_outfall(*views.tree(spark, sf_dir)).select("id")


@query(f"""{_TREE_CA}, r1 AS (SELECT r_regionkey FROM r ORDER BY ca DESC, r_regionkey DESC LIMIT 1), n1 AS (SELECT n_nationkey FROM n JOIN r1 ON n_regionkey = r_regionkey ORDER BY ca DESC, n_nationkey DESC LIMIT 1),
    c1 AS (SELECT c_custkey FROM c JOIN n1 ON c_nationkey = n_nationkey ORDER BY ca DESC, c_custkey DESC LIMIT 1), o1 AS (SELECT o_orderkey FROM o JOIN c1 ON o_custkey = c_custkey ORDER BY ca DESC, o_orderkey DESC LIMIT 1)
    SELECT 0 AS pos, 'o' || o_orderkey AS id FROM o1 UNION ALL SELECT 1, 'c' || c_custkey FROM c1 UNION ALL SELECT 2, 'n' || n_nationkey FROM n1 UNION ALL SELECT 3, 'r' || r_regionkey FROM r1 UNION ALL SELECT 4, 'OUT'""")
def tree_main_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.main_stem(*views.tree(spark, sf_dir)).select("pos", "id")


#: One network of all orders in a row: as deep as there are orders.
_TRUNK = "SELECT row_number() OVER (ORDER BY o_orderkey) AS k, count(*) OVER () AS n, floor(CAST(o_totalprice AS DOUBLE) / 1000.0::DOUBLE) / 100.0::DOUBLE AS area FROM orders"


@query(f"SELECT CAST(k AS VARCHAR) AS id, CAST(k - 1 AS INTEGER) AS level, round(0.5::DOUBLE * sum(area) OVER (ORDER BY k), 6) AS total_ca, true AS reaches, CAST(k - 1 AS BIGINT) AS pos FROM ({_TRUNK}) UNION ALL SELECT 'OUT', CAST(any_value(n) AS INTEGER), round(0.5::DOUBLE * sum(area), 6), true, any_value(n) FROM ({_TRUNK})")
def trunk_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels, areas, outfall and main stem of one network that is as deep as there are orders."""
    nodes, pipes = views.trunk(spark, sf_dir)
    keys = ["network_id", "id"]
    total = graph.accumulate_ca(nodes, pipes)
    found = graph.levels(nodes, pipes).join(total, keys).join(graph.main_stem(nodes, pipes, total), keys, "left")
    reached = graph.reaches_outfall(nodes, pipes).withColumn("reaches", F.lit(True))
    return found.join(reached, keys, "left").select("id", "level", r6("total_ca", "total_ca"), F.coalesce("reaches", F.lit(False)).alias("reaches"), F.col("pos").cast("bigint").alias("pos"))


def _shallow(nodes: DataFrame, pipes: DataFrame, recursive, doubling) -> DataFrame:
    return (recursive if graph.is_shallow(nodes, pipes) else doubling)(nodes, pipes)


@query()
def tree_areas_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_areas by one recursive statement, as the tree is measured to be shallow."""
    return _shallow(*views.tree(spark, sf_dir), graph.accumulate_ca_recursive, graph.accumulate_ca).select("id", r6("total_ca", "total_ca"))


@query()
def tree_levels_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shallow(*views.tree(spark, sf_dir), graph.levels_recursive, graph.levels).select("id", "level")


@query()
def tree_main_stem_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shallow(*views.tree(spark, sf_dir), graph.main_stem_recursive, graph.main_stem).select("pos", "id")


for _name in ("tree_areas", "tree_levels", "tree_main_stem"):
    SQL[f"{_name}_recursive"] = SQL[_name]



# --- Geometry and units -----------------------------------------------------------------------

_PX, _PY = "(CAST(c_acctbal AS DOUBLE) / 100.0::DOUBLE)", "CAST(c_custkey % 97 AS DOUBLE)"


def _plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kites around each customer's place."""
    x, y = F.col("c_acctbal").cast("double") / 100.0, (F.col("c_custkey") % 97).cast("double")
    w, h = 1.0 + F.col("c_custkey") % 7, 2.0 + F.col("c_nationkey") % 5
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return views.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", x.alias("x"), y.alias("y"), F.array(p(x - w, y), p(x, y + h), p(x + 2.0 * w, y), p(x, y - h)).alias("vertices"))


@query(f"""SELECT c_custkey, round(3.0::DOUBLE * w * h, 6) AS area, round(3.0::DOUBLE * w * h / 43560.0::DOUBLE, 9) AS acres, round(x + w / 3.0::DOUBLE, 6) AS cx, round(y, 6) AS cy, true AS inside, false AS outside
       FROM (SELECT *, {_PX} AS x, {_PY} AS y, 1.0::DOUBLE + c_custkey % 7 AS w, 2.0::DOUBLE + c_nationkey % 5 AS h FROM customer)""")
def catchment_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ge.centroid("vertices")
    return _plots(spark, sf_dir).select(
        "c_custkey", r6(ge.shoelace_area("vertices"), "area"), r6(ge.acres(ge.shoelace_area("vertices")), "acres", 9), r6(c["x"], "cx"), r6(c["y"], "cy"),
        ge.point_in_polygon(F.col("x") + 0.1, F.col("y") + 0.1, "vertices").alias("inside"), ge.point_in_polygon(F.col("x") + 99.0, F.col("y") + 0.1, "vertices").alias("outside"),
    )


@query(f"""SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey, round(min(d), 6) AS distance FROM (
         SELECT c_custkey, s_suppkey, sqrt(pow({_PX} - CAST(s_acctbal AS DOUBLE) / 100.0::DOUBLE, 2) + pow({_PY} - CAST(s_suppkey % 97 AS DOUBLE), 2)) AS d FROM customer JOIN supplier ON s_nationkey = c_nationkey) GROUP BY c_custkey""")
def nearest_inlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from culvert.operators.editing import nearest

    points = _plots(spark, sf_dir).select(F.col("c_nationkey").alias("network_id"), F.col("c_custkey").alias("point"), "x", "y")
    inlets = views.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("network_id"), F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"), (F.col("s_acctbal").cast("double") / 100.0).alias("x"), (F.col("s_suppkey") % 97).cast("double").alias("y"))
    return nearest(points, inlets).select(F.col("point").alias("c_custkey"), F.col("id").alias("s_suppkey"), r6("distance", "distance"))


@query(f"""SELECT network_id, ord, round(length * 0.3048::DOUBLE, 6) AS length_m, round(area_ac * 0.404686::DOUBLE, 6) AS area_ha, mm, round(area_ac / 0.404686::DOUBLE, 6) AS acres_of_ha
       FROM (SELECT *, (list_sort(list_transform([300, 375, 450, 525, 600, 675, 750, 900, 1050, 1200, 1350, 1500, 1800], lambda m: {{'off': abs(diameter * 0.3048::DOUBLE * 1000.0::DOUBLE - m), 'mm': m}}))[1]).mm AS mm FROM ({views.REACH}))""")
def metric_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = views.reach(spark, sf_dir)
    return r.select(*_K, r6(F.col("length") * un.M_PER_FT, "length_m"), r6(F.col("area_ac") * un.HA_PER_AC, "area_ha"), un.nearest_metric_mm(F.col("diameter") * un.M_PER_FT).alias("mm"), r6(un.to_acres("area_ac", F.lit("si")), "acres_of_ha"))


@query(f"SELECT network_id, ord, round(3.0::DOUBLE * round(length / 3.0::DOUBLE), 6) AS snapped, CASE WHEN p <= 1 THEN b WHEN p <= 2 THEN 2 * b WHEN p <= 5 THEN 5 * b ELSE 10 * b END AS step FROM (SELECT *, length / 8.0::DOUBLE / pow(10.0::DOUBLE, floor(log10(length / 8.0::DOUBLE))) AS p, pow(10.0::DOUBLE, floor(log10(length / 8.0::DOUBLE))) AS b FROM ({views.REACH}))")
def snapping_and_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.reach(spark, sf_dir).select(*_K, r6(ge.snap("length", F.lit(3.0)), "snapped"), ge.tick_step("length").alias("step"))


# --- More of networks -------------------------------------------------------------------------


def _periods_sql() -> str:
    """chain_flows for several periods: factors of C and of the intensity's scale."""
    flow = "60.0::DOUBLE * f / pow(tc + 10.0::DOUBLE, 0.8::DOUBLE) * ca"
    yn = f"(CASE WHEN q > {_QMAX} THEN diameter ELSE {_YN} END)"
    speed = lambda source: f"SELECT *, q / {_area_at('yn')} AS v, q > {_QMAX} AS surcharged FROM (SELECT *, {yn} AS yn FROM (SELECT *, {flow} AS q FROM ({source})))"
    first = "SELECT r.*, rp, f, cf, least(c * cf, 1.0::DOUBLE) * area_ac AS ca, greatest(tc_inlet, 10.0::DOUBLE) AS tc FROM r, p WHERE ord = 1"
    following = "SELECT r.*, rp, f, cf, s.total_ca + least(c * cf, 1.0::DOUBLE) * area_ac AS ca, greatest(r.tc_inlet, 10.0::DOUBLE, s.tc + s.travel) AS tc FROM r JOIN step s ON r.network_id = s.network_id AND r.ord = s.ord + 1"
    row = lambda source: f"SELECT network_id, ord, rp, f, cf, ca, tc, q, surcharged, CASE WHEN v > 0 THEN length / (v * 60.0::DOUBLE) ELSE 0.0::DOUBLE END FROM ({speed(source)})"
    return f"""WITH RECURSIVE r AS MATERIALIZED ({views.REACH}),
        p(rp, f, cf) AS (VALUES (2, 0.75::DOUBLE, 1.0::DOUBLE), (10, 1.0::DOUBLE, 1.0::DOUBLE), (25, 1.15::DOUBLE, 1.1::DOUBLE), (50, 1.28::DOUBLE, 1.2::DOUBLE), (100, 1.40::DOUBLE, 1.25::DOUBLE)),
        step(network_id, ord, rp, f, cf, total_ca, tc, q, surcharged, travel) AS ({row(first)} UNION ALL {row(following)})
        SELECT network_id, rp AS rp_years, 'P' || ord AS id, round(q, 4) AS design_q, surcharged FROM step"""


SQL["chain_all_periods"] = _periods_sql()


@query(f"""SELECT network_id, id, kind, round(x, 6) AS x, round(invert, 6) AS invert, round(rim, 6) AS rim FROM (
         SELECT network_id, ord, CAST(ord AS VARCHAR) AS id, 'inlet' AS kind, coalesce(sum(length) OVER (PARTITION BY network_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x,
                100.0::DOUBLE + sum(slope * length) OVER (PARTITION BY network_id ORDER BY ord DESC ROWS UNBOUNDED PRECEDING) AS invert,
                108.0::DOUBLE + sum(slope * length) OVER (PARTITION BY network_id ORDER BY ord DESC ROWS UNBOUNDED PRECEDING) AS rim FROM ({views.REACH})
         UNION ALL SELECT network_id, 0, 'OUT', 'outfall', sum(length), 100.0, 108.0 FROM ({views.REACH}) GROUP BY network_id)""")
def drawings_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DXF texts of all chains, written and read again."""
    from culvert.sinks.drawing import dxf_texts
    from culvert.sources.dxf import parse_dxf

    texts = dxf_texts(*views.chain(spark, sf_dir)).withColumn("file", F.lit("chain.dxf"))
    return parse_dxf(texts).nodes.select("network_id", "id", "kind", r6("x", "x"), r6("invert", "invert"), r6("rim", "rim"))


@query(f"""SELECT network_id, 'P' || ord AS id, 'N' || ord AS "from", 'N' || (ord + 1) AS "to", round(length, 3) AS length, round(diameter * 12.0::DOUBLE, 1) AS diameter_in FROM ({views.REACH})""")
def landxml_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LandXML texts of all chains, written and read again."""
    from culvert.sinks.drawing import landxml_texts
    from culvert.sources.landxml import parse_landxml

    nodes, pipes = views.chain(spark, sf_dir)
    names = nodes.filter("kind = 'outfall'").select("network_id", F.lit("chain").alias("name"))
    p = parse_landxml(landxml_texts(names, nodes, pipes).withColumn("file", F.lit("chain.xml"))).pipes
    return p.select("network_id", "id", "from", "to", r6("length", "length", 3), F.round(F.col("diameter") * 12.0, 1).alias("diameter_in"))


@query(f"""SELECT network_id, 'P' || ord AS pipe_id, printf('%.1f', length) AS length, printf('%.0f', d) AS diameter_in, printf('%.0f', length * CASE WHEN d <= 12 THEN 85.0::DOUBLE ELSE lo + (d - a) / (b - a) * (hi - lo) END) AS line_cost
       FROM (SELECT *, diameter * 12.0::DOUBLE AS d FROM ({views.REACH})) r
       LEFT JOIN (SELECT a, lead(a) OVER (ORDER BY a) AS b, lo, lead(lo) OVER (ORDER BY a) AS hi FROM (SELECT unnest({_COSTS[0]})::DOUBLE AS a, unnest({_COSTS[1]})::DOUBLE AS lo)) t ON d > a AND d <= b""")
def cost_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost template, cell by cell; pipes without results have none in it."""
    from culvert.sinks import report

    nodes, pipes = views.chain(spark, sf_dir)
    columns = report.TEMPLATES["cost"][1]
    bare = pipes.select("network_id", "id", F.lit(None).cast("int").alias("rp_years"))
    return report.cells(report.report_rows(nodes, pipes, bare, columns), columns).select("network_id", *columns)


@query()
def municipal_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV texts of the municipal template: one a network."""
    from culvert.sinks import report

    nodes, pipes, a = _analyzed(spark, sf_dir)
    name, columns = report.TEMPLATES["municipal"]
    return report.csv_reports(report.report_rows(nodes, pipes, a.pipes, columns), name, columns)


def _stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as inlets of their nation's network."""
    s = views.table(spark, sf_dir, "supplier")
    zero = F.lit(0.0)
    return s.select(
        F.col("s_nationkey").cast("bigint").alias("network_id"), F.col("s_suppkey").cast("int").alias("ord"), F.col("s_suppkey").cast("string").alias("id"), F.lit("inlet").alias("kind"), zero.alias("invert"), F.lit(8.0).alias("rim"),
        (1.0 + F.col("s_suppkey") % 3).alias("area_ac"), F.lit(0.6).alias("c"), F.lit(10.0).alias("tc_inlet"), (F.col("s_acctbal").cast("double") / 100.0).alias("x"), (F.col("s_suppkey") % 97).cast("double").alias("y"),
    )


def _catchments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' kites, a hundred times as large, as catchments of the nearest supplier."""
    from culvert.operators.editing import link_catchments

    big = F.transform("vertices", lambda v: F.struct((v["x"] * 100.0).alias("x"), (v["y"] * 100.0).alias("y")))
    given = _plots(spark, sf_dir).select(
        F.col("c_nationkey").cast("bigint").alias("network_id"), F.col("c_custkey").cast("int").alias("ord"), F.col("c_custkey").cast("string").alias("id"), "vertices", (0.3 + 0.1 * (F.col("c_custkey") % 5)).alias("c"), F.lit(0.01).alias("slope"), F.lit(100.0).alias("flow_length_ft"), F.lit(None).cast("string").alias("inlet"),
    )
    return link_catchments(given, _stations(spark, sf_dir), within=1e9).withColumn("vertices", big)


_LINKED = f"""SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s_suppkey FROM (
    SELECT c_custkey, s_suppkey, sqrt(pow({_PX} + (1.0::DOUBLE + c_custkey % 7) / 3.0::DOUBLE - CAST(s_acctbal AS DOUBLE) / 100.0::DOUBLE, 2) + pow({_PY} - CAST(s_suppkey % 97 AS DOUBLE), 2)) AS d
    FROM customer JOIN supplier ON s_nationkey = c_nationkey) GROUP BY c_custkey"""


@query(f"""WITH k AS ({_LINKED}), m AS (SELECT s_suppkey, sum(a) AS a, sum(a * c) AS ca FROM (SELECT s_suppkey, 30000.0::DOUBLE * (1.0::DOUBLE + customer.c_custkey % 7) * (2.0::DOUBLE + c_nationkey % 5) / 43560.0::DOUBLE AS a, 0.3::DOUBLE + 0.1::DOUBLE * (customer.c_custkey % 5) AS c
              FROM customer JOIN k USING (c_custkey)) GROUP BY s_suppkey)
       SELECT CAST(s_suppkey AS VARCHAR) AS id, round(own + coalesce(a, 0), 6) AS area_ac, round((own * 0.6::DOUBLE + coalesce(ca, 0)) / (own + coalesce(a, 0)), 6) AS c, CASE WHEN a IS NULL THEN 10.0::DOUBLE ELSE greatest(10.0::DOUBLE, 0.0) END AS tc_inlet
       FROM (SELECT s_suppkey, 1.0::DOUBLE + s_suppkey % 3 AS own FROM supplier) LEFT JOIN m USING (s_suppkey)""")
def merged_catchments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from culvert.operators.editing import merge_catchments

    return merge_catchments(_stations(spark, sf_dir), _catchments(spark, sf_dir)).select("id", r6("area_ac", "area_ac"), r6("c", "c"), r6("tc_inlet", "tc_inlet"))


@query(f"""SELECT s.s_suppkey AS point, CAST(max(c_custkey) AS VARCHAR) AS id FROM supplier s JOIN customer ON s_nationkey = c_nationkey,
         LATERAL (SELECT CAST(s_acctbal AS DOUBLE) / 100.0::DOUBLE - {_PX} AS dx, abs(CAST(s_suppkey % 97 AS DOUBLE) - {_PY}) AS dy, 1.0::DOUBLE + c_custkey % 7 AS w, 2.0::DOUBLE + c_nationkey % 5 AS h)
       WHERE dy / h + CASE WHEN dx < 0 THEN -dx / w ELSE dx / (2.0::DOUBLE * w) END < 1 GROUP BY s.s_suppkey""")
def containing_catchments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from culvert.operators.editing import containing_catchment

    plots = _plots(spark, sf_dir).select(F.col("c_nationkey").cast("bigint").alias("network_id"), F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("id"), "vertices")
    points = _stations(spark, sf_dir).select("network_id", F.col("ord").alias("point"), "x", "y")
    return containing_catchment(points, plots, sides=False).select(F.col("point").cast("bigint").alias("point"), "id")


@query(f"""SELECT s_suppkey AS id, round(CASE WHEN p > 1e-12 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, d / p)) ELSE 1.0::DOUBLE END, 6) AS cos, round((1.0::DOUBLE - CASE WHEN p > 1e-12 THEN greatest(-1.0::DOUBLE, least(1.0::DOUBLE, d / p)) ELSE 1.0::DOUBLE END) / 2.0::DOUBLE, 6) AS bend
       FROM (SELECT *, ux * vx + uy * vy AS d, sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy) AS p FROM (
         SELECT s_suppkey, CAST(s_acctbal AS DOUBLE) / 100.0::DOUBLE AS ux, CAST(s_suppkey % 97 AS DOUBLE) AS uy, 7.0::DOUBLE - CAST(s_acctbal AS DOUBLE) / 100.0::DOUBLE AS vx, 9.0::DOUBLE - CAST(s_suppkey % 97 AS DOUBLE) AS vy FROM supplier))""")
def deflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = F.lit(0.0)
    cos = ah.deflection_cos(zero, zero, "x", "y", F.lit(7.0), F.lit(9.0))
    return _stations(spark, sf_dir).select(F.col("ord").cast("bigint").alias("id"), r6(cos, "cos"), r6(ah.bend_coefficient(F.lit(1.0), cos), "bend"))


@query("""SELECT n_nationkey AS network_id, rp AS rp_years, round(a * f, 6) AS a, round(a * f / pow(25.0::DOUBLE, 0.8::DOUBLE), 6) AS intensity FROM (SELECT n_nationkey, 50.0::DOUBLE + n_nationkey AS a FROM nation),
          (VALUES (2, 0.75::DOUBLE), (5, 0.88::DOUBLE), (10, 1.0::DOUBLE), (25, 1.15::DOUBLE), (50, 1.28::DOUBLE), (100, 1.40::DOUBLE)) t(rp, f)""")
def synthetic_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = hd.synthetic_set(_nation_curves(spark, sf_dir))
    at = hd.intensities_at(sets, 15.0)
    return sets.join(at, ["network_id", "rp_years"]).select("network_id", "rp_years", r6("a", "a"), r6("intensity", "intensity"))


def _nation_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("bigint").alias("network_id"), F.lit(10).alias("rp_years"), (50.0 + F.col("n_nationkey")).alias("a"), F.lit(10.0).alias("b"), F.lit(0.8).alias("c"))


@query("""WITH c AS (SELECT n_nationkey AS network_id, rp FROM nation, (VALUES (2), (5), (10), (25), (50), (100)) t(rp) WHERE (rp + n_nationkey) % 3 > 0)
          SELECT network_id, coalesce(min(rp) FILTER (rp = 25), min(rp)) AS design, arg_min(rp, (abs(rp - 30), rp)) AS nearest, coalesce(min(rp) FILTER (rp = 7), min(rp)) AS fallback FROM c GROUP BY network_id""")
def chosen_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The design curve, the one nearest to 30 years, and the fallback of an unknown period; nations
    have different periods."""
    sets = hd.synthetic_set(_nation_curves(spark, sf_dir)).filter("(rp_years + network_id) % 3 > 0")
    pick = lambda df, name: df.select("network_id", F.col("rp_years").alias(name))
    return pick(hd.design_curve(sets, 25), "design").join(pick(hd.nearest_period(sets, 30.0), "nearest"), "network_id").join(pick(hd.design_curve(sets, 7), "fallback"), "network_id")


@query("""SELECT n_nationkey AS network_id, rp AS rp_years, round((50.0::DOUBLE + n_nationkey) * f + 0.003::DOUBLE, 1) AS a, 10.0::DOUBLE AS b, 0.8::DOUBLE AS c FROM nation,
          (VALUES (2, 0.75::DOUBLE), (5, 0.88::DOUBLE), (10, 1.0::DOUBLE), (25, 1.15::DOUBLE), (50, 1.28::DOUBLE), (100, 1.40::DOUBLE)) t(rp, f)""")
def fitted_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDF curves fitted to points of known curves, one for each nation and period."""
    sets = hd.synthetic_set(_nation_curves(spark, sf_dir))
    points = sets.withColumn("duration_min", F.explode(F.array(*[F.lit(float(t)) for t in (5, 10, 15, 30, 60, 120, 180)])))
    depth = hd.idf_intensity("duration_min", "a", "b", "c") * F.col("duration_min") / 60.0
    fitted = hd.atlas_to_idf(points.withColumn("depth_in", depth).select("network_id", "rp_years", "duration_min", "depth_in"))
    # Fits come near to the curves: 0.003 keeps them from ties of the rounding.
    return fitted.select("network_id", "rp_years", r6(F.col("a") + 0.003, "a", 1), r6("b", "b", 1), r6("c", "c", 2))


@query(f"""WITH RECURSIVE r AS MATERIALIZED (SELECT *, 60.0::DOUBLE * sum(least(c, 1.0::DOUBLE) * area_ac) OVER (PARTITION BY network_id ORDER BY ord) AS q, max(ord) OVER (PARTITION BY network_id) AS last,
         100.0::DOUBLE + sum(slope * length) OVER (PARTITION BY network_id ORDER BY ord DESC) - slope * length AS inv_dn, pi() / 64.0::DOUBLE AS a, 1.49::DOUBLE / n * (pi() / 64.0::DOUBLE) * pow(0.0625::DOUBLE, 2.0::DOUBLE / 3.0::DOUBLE) AS conv FROM ({views.REACH})),
       up(network_id, ord, hgl_dn, hgl_up) AS (
         SELECT network_id, ord, 101.0::DOUBLE, greatest(101.0::DOUBLE, inv_dn + 0.25::DOUBLE) + pow(q / conv, 2) * length + 0.5::DOUBLE * pow(q / a, 2) / 64.4::DOUBLE FROM r WHERE ord = last
         UNION ALL
         SELECT r.network_id, r.ord, u.hgl_up, greatest(u.hgl_up, inv_dn + 0.25::DOUBLE) + pow(q / conv, 2) * length + 0.5::DOUBLE * pow(q / a, 2) / 64.4::DOUBLE FROM r JOIN up u ON r.network_id = u.network_id AND r.ord = u.ord - 1)
       SELECT network_id, 'P' || ord AS id, round(hgl_dn, 2) AS hgl_dn, round(hgl_up, 2) AS hgl_up, true AS surcharged FROM up""")
def pressurized_grade_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 3-inch pipes under 60 in/hr: all reaches run full."""
    nodes, pipes = views.chain(spark, sf_dir)
    a = network.analyze_rational(nodes, pipes.withColumn("diameter", F.lit(0.25)), 60.0, Options(tailwater=101.0))
    return a.pipes.select("network_id", "id", r6("hgl_dn", "hgl_dn", 2), r6("hgl_up", "hgl_up", 2), "surcharged")


def _raw_chain() -> str:
    """CTEs that end in step: chain flows as they are, not rounded."""
    return _chain_sql().rsplit("SELECT network_id, ord, round(total_ca", 1)[0].rstrip()


def _state(source: str) -> str:
    """Adds over, velocity, share and fits to rows of q, n, slope, diameter."""
    y = f"(CASE WHEN q > {_QMAX} THEN diameter ELSE {_YN} END)"
    filled = f"SELECT *, q > {_QMAX} AS over, {y} AS y, q / {_FULL} AS share FROM ({source})"
    moving = f"SELECT *, CASE WHEN over THEN q / (pi() * diameter * diameter / 4.0::DOUBLE) WHEN {_area_at('y')} > 0 THEN q / {_area_at('y')} ELSE 0.0::DOUBLE END AS velocity FROM ({filled})"
    return f"SELECT *, NOT over AND velocity <= 10.0::DOUBLE + 1e-9 AND share <= 0.85::DOUBLE + 1e-9 AS fits FROM ({moving})"


SQL["chain_sizes"] = f"""{_raw_chain()},
    own AS MATERIALIZED ({_state("SELECT r.network_id, r.ord, s.q, n, slope, diameter FROM r JOIN step s ON r.network_id = s.network_id AND r.ord = s.ord")}),
    trial AS ({_state(f"SELECT network_id, ord, q, n, slope, unnest({_TRIALS}) / 12.0::DOUBLE AS diameter FROM own WHERE NOT fits")}),
    best AS (SELECT network_id, ord, coalesce(arg_min({{'d': diameter, 'v': velocity, 's': share, 'o': over}}, diameter) FILTER (fits), arg_max({{'d': diameter, 'v': velocity, 's': share, 'o': over}}, diameter)) AS b, bool_or(fits) AS found FROM trial GROUP BY network_id, ord)
    SELECT o.network_id, 'P' || o.ord AS id, CASE WHEN o.fits THEN 'adequate' WHEN found THEN 'sized' ELSE 'no_solution' END AS outcome, round(CASE WHEN o.fits THEN diameter ELSE b.d END, 6) AS recommended_diameter,
           round(CASE WHEN o.fits THEN velocity ELSE b.v END, 4) AS velocity, round(CASE WHEN o.fits THEN share ELSE b.s END, 6) AS pct_full, CASE WHEN o.fits THEN over ELSE b.o END AS surcharged
    FROM own o LEFT JOIN best ON o.network_id = best.network_id AND o.ord = best.ord"""


@query(f"""{_raw_chain()},
    p AS (SELECT r.*, q, 'P' || r.ord AS id, q > {_QMAX} AS over, q / {_FULL} AS share, CASE WHEN q > {_QMAX} THEN q / (pi() * diameter * diameter / 4.0::DOUBLE) ELSE q / {_area_at('y')} END AS velocity
          FROM (SELECT r.*, s.q, {_YN.replace(' q', ' s.q')} AS y FROM r JOIN step s ON r.network_id = s.network_id AND r.ord = s.ord) r)
    SELECT network_id, 'surcharged' AS rule, id FROM p WHERE over
    UNION ALL SELECT network_id, 'pct_full', id FROM p WHERE NOT over AND share > 0.85::DOUBLE
    UNION ALL SELECT network_id, 'low_velocity', id FROM p WHERE velocity < 2.0::DOUBLE AND q > 0
    UNION ALL SELECT network_id, 'high_velocity', id FROM p WHERE velocity > 10.0::DOUBLE AND q > 0
    UNION ALL SELECT network_id, 'cover', id FROM p WHERE 8.0::DOUBLE - diameter < 6.1::DOUBLE
    UNION ALL SELECT network_id, 'cover', id FROM p WHERE 8.0::DOUBLE - diameter < 6.1::DOUBLE
    UNION ALL SELECT network_id, 'flat_slope', id FROM p WHERE slope < 0.004::DOUBLE
    UNION ALL SELECT a.network_id, 'size_progression', b.id FROM p a JOIN p b ON a.network_id = b.network_id AND b.ord = a.ord + 1 WHERE b.diameter + 1e-9 < a.diameter""")
def pipe_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rules of pipes, with a cover of 6.1 ft and slopes of 0.004 asked for."""
    from culvert.schema import ReviewCriteria

    nodes, pipes, a = _analyzed(spark, sf_dir)
    found = design.review_analysis(nodes, pipes, a, ReviewCriteria(min_cover_ft=6.1, min_slope=0.004))
    return found.filter("rule not in ('flooding', 'freeboard')").select("network_id", "rule", "id")
