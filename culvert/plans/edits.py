"""Registered queries of edits, checks with every fault, units, sections, SQL functions and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.functions import geometry as ge
from culvert.functions import hydraulics as hy
from culvert.functions import inlets as il
from culvert.functions import registry
from culvert.functions import units as un
from culvert.operators import editing, network, study, validation
from culvert.plans import views
from culvert.plans.catalog import _FLOWS, _FULL, _PX, _PY, _YC, _YN, _bisected, _catchments, _flows, _plots, _stations, query, r6
from culvert.plans.documents import _CHAIN, _TO, _all, _part, _sql_part
from culvert.sinks import drawing
from culvert.sources import dxf

# --- Faults -------------------------------------------------------------------------------------

# Chains with a fault that their id tells: 1 a second outfall, 2 a lone inlet, 3 a pipe from nowhere, 4 no
# nodes, 5 catchments astray, 6 no pipe to the outfall, 0 none.
_FAULTY = f"""c AS MATERIALIZED (SELECT *, network_id % 7 AS fault FROM ({_CHAIN})),
    n AS (SELECT network_id, fault, CAST(ord AS VARCHAR) AS id, 'inlet' AS kind, area_ac FROM c WHERE fault <> 4 UNION ALL SELECT network_id, fault, 'OUT', 'outfall', 0 FROM c WHERE ord = last AND fault <> 4
          UNION ALL SELECT network_id, fault, 'OUT2', 'outfall', 0 FROM c WHERE ord = last AND fault = 1 UNION ALL SELECT network_id, fault, 'X', 'inlet', 0 FROM c WHERE ord = last AND fault = 2),
    p AS (SELECT network_id, fault, ord, 'P' || ord AS id, CASE WHEN fault = 3 AND ord = 1 THEN 'ZZ' ELSE CAST(ord AS VARCHAR) END AS a, {_TO} AS b FROM c WHERE NOT (fault = 6 AND ord = last))"""


@query(f"""WITH {_FAULTY}
    SELECT network_id, 'no_nodes' AS rule, 'error' AS severity, 'network' AS id FROM c WHERE ord = 1 AND fault = 4
    UNION ALL SELECT network_id, 'no_outfall', 'error', 'network' FROM c WHERE ord = 1 AND fault = 4
    UNION ALL SELECT network_id, 'dangling_from', 'error', id FROM p WHERE fault = 4 OR a = 'ZZ'
    UNION ALL SELECT network_id, 'dangling_to', 'error', id FROM p WHERE fault = 4
    UNION ALL SELECT network_id, 'orphan', 'warning', id FROM n WHERE kind <> 'outfall' AND NOT EXISTS (SELECT 1 FROM p WHERE p.network_id = n.network_id AND n.id IN (p.a, p.b))
    UNION ALL SELECT network_id, 'no_area', 'warning', id FROM n WHERE kind = 'inlet' AND area_ac <= 0
    UNION ALL SELECT network_id, 'many_outfalls', 'info', 'network' FROM n WHERE id = 'OUT2'
    UNION ALL SELECT network_id, 'unreachable', 'warning', id FROM n WHERE kind <> 'outfall' AND (fault = 6 OR (fault = 2 AND id = 'X') OR (fault = 3 AND id = '1'))
    UNION ALL SELECT network_id, 'unlinked', 'warning', 'C1' FROM c WHERE ord = 1 AND fault = 5
    UNION ALL SELECT network_id, 'missing_inlet', 'error', 'C2' FROM c WHERE ord = 1 AND fault = 5
    UNION ALL SELECT network_id, 'few_vertices', 'error', 'C2' FROM c WHERE ord = 1 AND fault = 5""")
def diagnose_faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains with all kinds of faults: every rule of validation and diagnosis."""
    nodes, pipes = views.chain(spark, sf_dir)
    fault = F.col("network_id") % 7
    ends = nodes.filter("kind = 'outfall'")
    second = ends.filter(fault == 1).withColumn("id", F.lit("OUT2"))
    lone = ends.filter(fault == 2).withColumns({"id": F.lit("X"), "kind": F.lit("inlet")})
    every = nodes.unionByName(second).unionByName(lone).filter(fault != 4)
    # The last pipe is the one to OUT.
    lines = pipes.withColumn("from", F.when((fault == 3) & (F.col("ord") == 1), "ZZ").otherwise(F.col("from"))).filter(~((fault == 6) & (F.col("to") == "OUT")))
    corner = lambda k: F.struct(F.lit(float(k)).alias("x"), F.lit(float(k * k)).alias("y"))
    shape = lambda n: F.array(*[corner(k) for k in range(n)])
    areas = F.inline(F.array(F.struct(F.lit(1).alias("ord"), F.lit("C1").alias("id"), shape(3).alias("vertices"), F.lit(None).cast("string").alias("inlet")), F.struct(F.lit(2).alias("ord"), F.lit("C2").alias("id"), shape(2).alias("vertices"), F.lit("nowhere").alias("inlet"))))
    catchments = ends.filter(fault == 5).select("network_id", areas)
    return validation.diagnose(ends.select("network_id"), every, lines, catchments).select("network_id", "rule", "severity", "id")


@query(f"SELECT network_id, CASE WHEN network_id % 3 = 0 THEN 'cycle' ELSE 'P1 has an unknown node' END AS error FROM ({views.REACH}) WHERE ord = 1 AND network_id % 3 < 2")
def network_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks that the analysis refuses: a cycle, a pipe from an unknown node."""
    nodes, pipes = views.chain(spark, sf_dir)
    kind = F.col("network_id") % 3
    back = pipes.filter((kind == 0) & (F.col("to") == "OUT")).select("network_id", (F.col("ord") + 1).alias("ord"), F.lit("BACK").alias("id"), F.col("from").alias("_f"), F.lit("1").alias("to"), "length", "diameter", "n").withColumnRenamed("_f", "from")
    # A chain of one reach turns back to its own node.
    lines = pipes.withColumn("from", F.when((kind == 1) & (F.col("ord") == 1), "ZZ").otherwise(F.col("from"))).unionByName(back)
    a = network.analyze_rational(nodes, lines, 3.0)
    return a.errors.select("network_id", F.when(F.col("error") == "cycle", "cycle").otherwise("P1 has an unknown node").alias("error"))


# --- Edits --------------------------------------------------------------------------------------

_N = "(SELECT min(network_id) FROM c WHERE ord = 3)"


def _edited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """(nodes, pipes, the first network with three reaches) of the chains."""
    nodes, pipes = views.chain(spark, sf_dir)
    pipes = network.with_sections(pipes).withColumn("ord", F.col("ord").cast("int"))
    return nodes.withColumn("ord", F.col("ord").cast("int")), pipes, pipes.filter("id = 'P3'").agg(F.min("network_id")).first()[0]


@query(f"""WITH c AS MATERIALIZED ({_CHAIN}), p AS (SELECT network_id, 'P' || ord AS id, CAST(ord AS VARCHAR) AS a, {_TO} AS b, length, 2.0::DOUBLE AS diameter, 0.015::DOUBLE AS n FROM c)
    SELECT network_id, id, CASE WHEN network_id = {_N} AND id = 'P2' THEN b ELSE a END AS "from", CASE WHEN network_id = {_N} AND id = 'P2' THEN a ELSE b END AS "to", round(length, 6) AS length, diameter, n FROM p WHERE NOT (network_id = {_N} AND id = 'P1')
    UNION ALL SELECT network_id, 'P' || (max(ord) + 1), '1', '3', round(sum(CASE WHEN ord < 3 THEN length ELSE 0 END), 6), 2.5::DOUBLE, 0.013::DOUBLE FROM c WHERE network_id = {_N} GROUP BY network_id""")
def edited_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roughness and diameter of all pipes; one turned, one deleted, one placed."""
    nodes, pipes, n = _edited(spark, sf_dir)
    pipes = editing.set_diameter(editing.set_roughness(pipes, 0.015), 2.0)
    pipes = editing.reverse_pipe(pipes, n, "P2")
    pipes = editing.delete_pipe(editing.place_pipe(nodes, pipes, n, "1", "3", 2.5), n, "P1")
    return pipes.select("network_id", "id", "from", "to", r6("length", "length"), "diameter", "n")


@query(f"""WITH c AS MATERIALIZED ({_CHAIN}), n AS (
      SELECT network_id, CAST(ord AS VARCHAR) AS id, 'inlet' AS kind, x, 0.0::DOUBLE AS y, inv, inv + 8.0::DOUBLE AS rim, area_ac, c, tc_inlet FROM c
      UNION ALL SELECT network_id, 'OUT', 'outfall', x + length, 0, 100, 108, 0, 0, 0 FROM c WHERE ord = last)
    SELECT network_id, id, CASE WHEN network_id = {_N} AND id = '2' THEN 'junction' ELSE kind END AS kind, round(x, 6) AS x, y, round(inv, 6) AS invert, round(rim, 6) AS rim, round(area_ac, 6) AS area_ac, CASE WHEN network_id = {_N} AND id = '1' THEN 33.0::DOUBLE ELSE tc_inlet END AS tc_inlet FROM n
    UNION ALL SELECT network_id, 'N1', 'inlet', 7, 9, 100, 106, 1, 10 FROM c WHERE network_id = {_N} AND ord = 1
    UNION ALL SELECT network_id, 'NEW', 'outfall', 70, 90, 100, 106, 0, 0 FROM c WHERE network_id = {_N} AND ord = 1
    UNION ALL SELECT network_id, 'N2', 'inlet', 20, -20, round(inv, 6), round(inv + 8.0::DOUBLE, 6), round(area_ac, 6), 33.0::DOUBLE FROM c WHERE network_id = {_N} AND ord = 1""")
def edited_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures placed, copied, of another kind, and with another time."""
    nodes, _, n = _edited(spark, sf_dir)
    nodes = editing.place_structure(nodes, n, "inlet", 7.0, 9.0)
    nodes = editing.place_structure(nodes, n, "outfall", 70.0, 90.0, "NEW")
    nodes = editing.duplicate_node(editing.set_tc(editing.set_kind(nodes, n, "2", "junction"), n, "1", 33.0), n, "1")
    return nodes.select("network_id", "id", "kind", r6("x", "x"), "y", r6("invert", "invert"), r6("rim", "rim"), r6("area_ac", "area_ac"), "tc_inlet")


@query(
    f"WITH c AS MATERIALIZED ({_CHAIN}), o AS (SELECT *, network_id = {_N} AS hit FROM c), l AS (SELECT network_id, inv, slope, length, last FROM o WHERE hit AND ord = 1) "
    + " UNION ALL ".join(
        [
            _sql_part("pipe", "o WHERE NOT (hit AND ord IN (1, 2))", "'P' || ord", "ord", _TO, ("length",)),
            _sql_part("pipe", "l", "'P1'", "'1'", "'N1'", ("40",)),
            _sql_part("pipe", "l", "'P' || (last + 1)", "'N1'", "'2'", ("sqrt(1600.0::DOUBLE + 90000.0::DOUBLE)",)),
            _sql_part("pipe", "(SELECT o.network_id, o.x, o.length FROM o WHERE hit AND ord = 2)", "'P2'", "'2'", "'3'", ("sqrt((x + length) * (x + length) + 90000.0::DOUBLE)",)),
            _sql_part("node", "l", "'N1'", "'junction'", "NULL", ("40", "0", "inv - 40.0::DOUBLE * slope", "inv + 8.0::DOUBLE - 40.0::DOUBLE * slope")),
            _sql_part("node", "(SELECT network_id, inv FROM o WHERE hit AND ord = 2)", "'2'", "'inlet'", "NULL", ("0", "300", "inv", "inv + 8.0::DOUBLE")),
        ]
    )
)
def split_and_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipe split near a point, a structure moved, and all lengths synced."""
    nodes, pipes, n = _edited(spark, sf_dir)
    nodes, pipes = editing.split_pipe(nodes, pipes, n, "P1", 40.0, 3.0)
    nodes, pipes = editing.move_node(nodes, pipes, n, "2", 0.0, 300.0)
    shown = nodes.filter((F.col("network_id") == n) & F.col("id").isin("N1", "2"))
    return _part(pipes, "pipe", "id", "from", "to", ("length",)).unionByName(_part(shown, "node", "id", "kind", None, ("x", "y", "invert", "rim")))


@query(
    f"WITH c AS MATERIALIZED ({_CHAIN}), o AS (SELECT *, network_id = {_N} AS hit FROM c) "
    + " UNION ALL ".join(
        [
            _sql_part("node", "o WHERE NOT (hit AND ord IN (1, 2))", "ord"),
            _sql_part("node", "o WHERE ord = last", "'OUT'"),
            _sql_part("pipe", "o WHERE NOT (hit AND ord IN (1, 2))", "'P' || ord", "ord", _TO),
            _sql_part("catchment", "o WHERE ord = 1 AND NOT hit", "'C1'", "1"),
            _sql_part("catchment", "o WHERE ord = 1", "'C2'", "CASE WHEN hit THEN 3 ELSE 2 END"),
            _sql_part("catchment", "o WHERE ord = 1", "'C3'", "CASE WHEN hit THEN 3 ELSE 2 END"),
            _sql_part("catchment", "o WHERE ord = 1", "'C4'", "CASE WHEN hit THEN NULL ELSE 2 END"),
        ]
    )
)
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A structure merged into the next, with its pipes and catchments, another one deleted, and
    catchments deleted, linked and unlinked."""
    nodes, pipes, n = _edited(spark, sf_dir)
    ends = nodes.filter("kind = 'outfall'")
    areas = F.inline(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(f"C{k}").alias("id"), F.lit("1" if k == 1 else "2").alias("inlet")) for k in (1, 2, 3, 4)]))
    catchments = ends.select("network_id", areas)
    nodes, pipes, catchments = editing.merge_node(nodes, pipes, catchments, n, "2", "3")
    nodes, pipes = editing.delete_node(nodes, pipes, n, "1")
    catchments = editing.delete_catchment(catchments, n, 1)
    catchments = editing.relink_catchment(editing.relink_catchment(catchments, nodes, n, 3, "3"), nodes, n, 4, None)
    return _all([_part(nodes, "node", "id"), _part(pipes, "pipe", "id", "from", "to"), _part(catchments, "catchment", "id", "inlet")])


_S = "(CASE WHEN network_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.3048::DOUBLE END)"
_MM = "(list_sort(list_transform([300, 375, 450, 525, 600, 675, 750, 900, 1050, 1200, 1350, 1500, 1800], lambda m: {'off': abs(diameter * 0.3048::DOUBLE * 1000.0::DOUBLE - m), 'mm': m}))[1]).mm / 1000.0::DOUBLE"


@query(
    f"WITH c AS MATERIALIZED ({_CHAIN}) "
    + " UNION ALL ".join(
        [
            _sql_part("si node", "c", "ord", "NULL", "NULL", (f"inv * {_S}", f"(inv + 8.0::DOUBLE) * {_S}", "area_ac * CASE WHEN network_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.404686::DOUBLE END", f"x * {_S}")),
            _sql_part("si pipe", "c", "'P' || ord", "NULL", "NULL", (f"length * {_S}", f"CASE WHEN network_id % 2 = 0 THEN diameter ELSE {_MM} END")),
            _sql_part("si settings", "c WHERE ord = 1", "'si'", "NULL", "NULL", ("60.0::DOUBLE * CASE WHEN network_id % 2 = 0 THEN 1.0::DOUBLE ELSE 25.4::DOUBLE END", f"101.5::DOUBLE * {_S}")),
            _sql_part("us pipe", "c", "'P' || ord", "NULL", "NULL", ("length / CASE WHEN network_id % 2 = 0 THEN 0.3048::DOUBLE ELSE 1.0::DOUBLE END", "CASE WHEN network_id % 2 = 0 THEN round(diameter / 0.3048::DOUBLE * 12.0::DOUBLE) / 12.0::DOUBLE ELSE diameter END")),
            _sql_part("us settings", "c WHERE ord = 1", "'us_customary'", "NULL", "NULL", ("60.0::DOUBLE / CASE WHEN network_id % 2 = 0 THEN 25.4::DOUBLE ELSE 1.0::DOUBLE END", "101.5::DOUBLE / CASE WHEN network_id % 2 = 0 THEN 0.3048::DOUBLE ELSE 1.0::DOUBLE END")),
        ]
    )
)
def converted_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of all chains, every second one in SI, made SI, and made US customary."""
    nodes, pipes = views.chain(spark, sf_dir)
    names = nodes.filter("kind = 'outfall'").select("network_id", F.lit("chain").alias("name"))
    made = study.from_engine(nodes, network.with_sections(pipes), names)
    settings = made.settings.withColumns({"units": F.when(F.col("network_id") % 2 == 0, "si").otherwise("us_customary"), "tailwater": F.lit(101.5)})
    si, us = (study.convert_project(made._replace(settings=settings), u) for u in ("si", "us_customary"))
    return _all(
        [
            _part(si.nodes.filter("kind <> 'outfall'"), "si node", "id", None, None, ("invert", "rim", "area_ac", "x")),
            _part(si.pipes, "si pipe", "id", None, None, ("length", "diameter")),
            _part(si.settings, "si settings", "units", None, None, ("idf_a", "tailwater")),
            _part(us.pipes, "us pipe", "id", None, None, ("length", "diameter")),
            _part(us.settings, "us settings", "units", None, None, ("idf_a", "tailwater")),
        ]
    )


# --- Sections, SQL functions, inlets ------------------------------------------------------------

_RQ = "(1.49::DOUBLE / n * (span * ({y})) * pow((span * ({y})) / (span + 2.0::DOUBLE * ({y})), 2.0::DOUBLE / 3.0::DOUBLE) * sqrt(slope))"
_BOX = f"SELECT *, diameter AS rise, 1.5::DOUBLE * diameter AS span FROM ({_FLOWS})"
_BOX_YN = _bisected("0", "rise", f"{_RQ.format(y='@m')} <= q")
_BOX_YC = _bisected("1e-6 * rise", "0.999 * rise", "q * q * span - 32.2::DOUBLE * pow(span * @m, 3) > 0")
_ARC = "(0.4::DOUBLE * rise)"


@query(f"""SELECT network_id, ord, CASE WHEN q <= q_max THEN round({_BOX_YN}, 4) END AS normal_depth, round({_BOX_YC}, 4) AS critical_depth,
           round(q_max, 6) AS q_max, round(span * {_ARC}, 6) AS box_area, round(span + 2.0::DOUBLE * {_ARC}, 6) AS box_perimeter,
           round(CASE WHEN 0.4::DOUBLE * rise <= 0.25::DOUBLE * rise THEN span * {_ARC} ELSE span * 0.25::DOUBLE * rise + 0.15::DOUBLE * rise * sqrt(0.5625::DOUBLE - 0.0225::DOUBLE) * rise + 0.5625::DOUBLE * rise * rise * asin(0.2::DOUBLE) END, 6) AS arch_area, round(0.5::DOUBLE * span, 6) AS half_span
       FROM (SELECT * EXCLUDE (q_max), {_RQ.format(y='rise')} AS q_max FROM ({_BOX}))""")
def section_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes 1.5 times as wide as high: depths, capacity and geometry; the area of such an arch."""
    f = _flows(spark, sf_dir).withColumns({"rise": F.col("diameter"), "span": 1.5 * F.col("diameter"), "box": F.lit("rectangular"), "arch": F.lit("arch")})
    box = hy.section_geometry(0.4 * F.col("rise"), "box", "rise", "span")
    arch = hy.section_geometry(0.4 * F.col("rise"), "arch", "rise", "span")
    return f.select(
        "network_id", "ord", r6(hy.normal_depth("q", "n", "slope", "rise", F.col("box"), "span"), "normal_depth", 4), r6(hy.critical_depth("q", "rise", F.col("box"), "span"), "critical_depth", 4),
        r6(hy.section_max_capacity("n", "slope", "box", "rise", "span"), "q_max"), r6(box["area"], "box_area"), r6(box["perimeter"], "box_perimeter"), r6(arch["area"], "arch_area"), r6(0.5 * F.col("span"), "half_span"),
    )


@query(f"""SELECT network_id, ord, round(c * 4.0::DOUBLE * area_ac, 6) AS peak, round({_FULL}, 6) AS full_flow, CASE WHEN q <= q_max THEN round({_YN}, 4) END AS yn, round({_YC}, 4) AS yc,
           round(0.0078::DOUBLE * pow(length, 0.77::DOUBLE) * pow(slope, -0.385::DOUBLE), 6) AS kirpich, round(0.42::DOUBLE * pow(0.011::DOUBLE * length, 0.8::DOUBLE) / (sqrt(3.0::DOUBLE) * pow(slope, 0.4::DOUBLE)), 6) AS sheet FROM ({_FLOWS})""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered SQL functions, called by SQL."""
    registry.register(spark)
    _flows(spark, sf_dir).createOrReplaceTempView("culvert_flows")
    return spark.sql(
        """SELECT network_id, ord, round(rational_peak(c, 4D, area_ac), 6) AS peak, round(manning_full_flow_circular(n, slope, diameter), 6) AS full_flow,
           CASE WHEN NOT isnan(normal_depth_circular(q, n, slope, diameter)) THEN round(normal_depth_circular(q, n, slope, diameter), 4) END AS yn, round(critical_depth_circular(q, diameter), 4) AS yc,
           round(kirpich_tc(length, slope), 6) AS kirpich, round(tr55_sheet_flow(length, slope, 0.011D, 3D), 6) AS sheet FROM culvert_flows"""
    )


_NODE_Q = f"SELECT *, least(c, 1.0::DOUBLE) * area_ac * (4.0::DOUBLE + ord % 3 + CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END) AS nq, CASE WHEN ord % 3 = 0 THEN 3.0::DOUBLE ELSE 2.0::DOUBLE END AS len, CASE WHEN ord % 5 = 0 THEN 0.02::DOUBLE ELSE 0.01::DOUBLE END AS gs FROM ({views.REACH})"
_NT = "pow(nq * 0.016::DOUBLE / (0.56::DOUBLE * pow(0.02::DOUBLE, 1.67::DOUBLE) * sqrt(gs)), 1.0::DOUBLE / 2.67::DOUBLE)"


@query(f"""SELECT network_id, CAST(ord AS VARCHAR) AS id, round(nq, 6) AS design_q, kind, round(CASE WHEN sag THEN 0 ELSE t END, 6) AS spread_ft, round(cap, 6) AS capacity_cfs, round(greatest(nq - cap, 0.0::DOUBLE), 6) AS bypass_cfs, CASE WHEN sag THEN cap >= nq ELSE t <= 10.0::DOUBLE END AS ok
       FROM (SELECT *, CASE WHEN sag THEN 'sag_grate' ELSE 'grate_on_grade' END AS kind, CASE WHEN sag THEN least(3.0::DOUBLE * (len + 3.0::DOUBLE) * pow(0.3::DOUBLE, 1.5::DOUBLE), 0.67::DOUBLE * len * 1.5::DOUBLE * sqrt(64.4::DOUBLE * 0.3::DOUBLE))
               ELSE nq * greatest(0.0::DOUBLE, least(1.0::DOUBLE, rf * eo + (1.0::DOUBLE / (1.0::DOUBLE + 0.15::DOUBLE * pow(v, 1.8::DOUBLE) / (0.02::DOUBLE * pow(len, 2.3::DOUBLE)))) * (1.0::DOUBLE - eo))) END AS cap
             FROM (SELECT *, CASE WHEN 1.5::DOUBLE >= t THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - pow(1.0::DOUBLE - 1.5::DOUBLE / t, 2.67::DOUBLE) END AS eo, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - 0.09::DOUBLE * (v - 5.0::DOUBLE))) AS rf
                   FROM (SELECT *, ord % 4 = 0 AS sag, {_NT} AS t, nq / (0.5::DOUBLE * 0.02::DOUBLE * pow({_NT}, 2)) AS v FROM ({_NODE_Q}))))""")
def inlets_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inlets at the largest intensity of their node's outgoing reaches, with lengths, slopes and sags of their own."""
    nodes, pipes = views.chain(spark, sf_dir)
    nodes = nodes.withColumns({"inlet_length_ft": F.when(F.col("ord") % 3 == 0, 3.0).otherwise(0.0), "inlet_slope": F.when(F.col("ord") % 5 == 0, 0.02).otherwise(0.0), "inlet_sag": F.col("ord") % 4 == 0})
    first = pipes.select("network_id", F.lit(10).alias("rp_years"), "from", (4.0 + F.col("ord") % 3).alias("intensity"), "ord")
    results = first.unionByName(first.filter("ord % 2 = 0").withColumn("intensity", F.col("intensity") + 1.0))
    made = il.node_inlets(nodes, pipes, results)
    return made.select("network_id", "id", *[r6(c, c) for c in ("design_q", "spread_ft", "capacity_cfs", "bypass_cfs")], "kind", "ok")


@query("""SELECT s_suppkey, kind, label, coalesce(kind IN ('sag_grate', 'sag_curb'), false) AS sag, round(inches / 12.0::DOUBLE, 6) AS feet FROM (
         SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'grate_on_grade' WHEN 1 THEN 'curb_opening' WHEN 2 THEN 'combination' WHEN 3 THEN 'sag_grate' WHEN 4 THEN 'sag_curb' END AS kind,
                CASE s_suppkey % 6 WHEN 0 THEN 'Grate (on grade)' WHEN 1 THEN 'Curb opening' WHEN 2 THEN 'Combination' WHEN 3 THEN 'Sag grate' WHEN 4 THEN 'Sag curb' END AS label, 1.0::DOUBLE + s_suppkey % 60 AS inches FROM supplier)""")
def inlet_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of inlet kinds, and inches in feet."""
    given = F.get(F.array(*map(F.lit, (" Grate ", "CURB OPENING", "combo", "sag", "Sag Curb", "drain"))), F.col("s_suppkey").cast("int") % 6)
    s = views.table(spark, sf_dir, "supplier").withColumn("kind", il.inlet_kind(given))
    return s.select("s_suppkey", "kind", il.inlet_label("kind").alias("label"), F.coalesce(il.is_sag("kind"), F.lit(False)).alias("sag"), r6(un.inches_to_feet(1.0 + F.col("s_suppkey") % 60), "feet"))


# --- Plans and profiles -------------------------------------------------------------------------


@query(
    f"WITH c AS MATERIALIZED ({_CHAIN}) "
    + " UNION ALL ".join(
        [
            _sql_part("line", "c", "'P' || ord", "NULL", "NULL", ("x", "x + length", "x + length / 2.0::DOUBLE", "0")),
            _sql_part("bounds", "c WHERE ord = last", "'box'", "NULL", "NULL", ("0", "x + length", "0", "0")),
            _sql_part("ground", "c", "ord", "NULL", "NULL", ("x", "inv + 8.0::DOUBLE", "2.0::DOUBLE * x", "10.0::DOUBLE * (inv - 92.0::DOUBLE)")),
            _sql_part("ground", "c WHERE ord = last", "'OUT'", "NULL", "NULL", ("x + length", "108", "2.0::DOUBLE * (x + length)", "80")),
            _sql_part("invert", "c", "ord", "NULL", "NULL", ("x", "inv", "2.0::DOUBLE * x", "10.0::DOUBLE * (inv - 100.0::DOUBLE)")),
            _sql_part("invert", "c WHERE ord = last", "'OUT'", "NULL", "NULL", ("x + length", "100", "2.0::DOUBLE * (x + length)", "0")),
            _sql_part("hgl", "c WHERE ord <= 3 AND last >= 2", "ord", "NULL", "NULL", ("x", "inv + 1.0::DOUBLE", "2.0::DOUBLE * x", "10.0::DOUBLE * (inv - 99.0::DOUBLE)")),
        ]
    )
)
def plans_and_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan lines, bounds, and the profile of each chain's main stem; a grade line of its first three places."""
    nodes, pipes = views.chain(spark, sf_dir)
    levels = nodes.filter("ord <= 3 and kind <> 'outfall'").select("network_id", "id", (F.col("invert") + 1.0).alias("hgl"))
    profile = drawing.profile_points(nodes, pipes, levels, h_scale=2.0)
    each = [_part(profile.filter(F.col("role") == role), role, "id", None, None, ("station", "elevation", "px", "py")) for role in ("ground", "invert", "hgl")]
    lines, box = drawing.plan_lines(nodes, pipes), drawing.bounds(nodes)
    return _all([_part(lines, "line", "id", None, None, ("x1", "x2", "label_x", "label_y")), _part(box, "bounds", F.lit("box"), None, None, ("min_x", "max_x", "min_y", "max_y")), *each])


@query("""WITH s AS (SELECT s_nationkey AS network_id, s_suppkey, CAST(s_acctbal AS DOUBLE) / 100.0::DOUBLE AS x, CAST(s_suppkey % 97 AS DOUBLE) AS y, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier),
       r AS (SELECT *, lead(k) OVER w AS k2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY network_id ORDER BY x, k))
       SELECT network_id, 'P' || i AS id, 'N' || k AS "from", 'N' || k2 AS "to", round(greatest(1.0::DOUBLE, sqrt(pow(x - x2, 2) + pow(y - y2, 2))), 6) AS length FROM r WHERE k2 IS NOT NULL""")
def drawn_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings with structures alone: pipes run through them by x."""
    pairs = lambda *p: F.concat_ws("\n", *[t for code, v in p for t in (F.lit(str(code)), v if not isinstance(v, str) else F.lit(v))])
    circle = pairs((0, "CIRCLE"), (8, dxf.LAYERS["nodes"]), (10, F.col("x").cast("string")), (20, F.col("y").cast("string")), (40, "5"))
    s = _stations(spark, sf_dir).groupBy("network_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", circle.alias("t")))), lambda z: z["t"]), "\n").alias("text"))
    return dxf.parse_dxf(s.withColumn("file", F.lit("made.dxf"))).pipes.select("network_id", "id", "from", "to", r6("length", "length"))


_CX = f"({_PX} + (1.0::DOUBLE + c_custkey % 7) / 3.0::DOUBLE)"


@query(f"""WITH k AS (SELECT c_custkey, arg_min(s_suppkey, (d, s_suppkey)) AS s, min(d) AS d FROM (
             SELECT c_custkey, s_suppkey, sqrt(pow({_CX} * 100.0::DOUBLE - CAST(s_acctbal AS DOUBLE) / 100.0::DOUBLE, 2) + pow({_PY} * 100.0::DOUBLE - CAST(s_suppkey % 97 AS DOUBLE), 2)) AS d FROM customer JOIN supplier ON s_nationkey = c_nationkey) GROUP BY c_custkey)
       SELECT CAST(c_custkey AS VARCHAR) AS id, round(l, 4) AS flow_length_ft, round(0.0078::DOUBLE * pow(l, 0.77::DOUBLE) * pow(0.01::DOUBLE, -0.385::DOUBLE), 4) AS minutes FROM (SELECT customer.c_custkey, coalesce(d, 100.0::DOUBLE) AS l FROM customer LEFT JOIN k USING (c_custkey))""")
def catchment_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow lengths of catchments to the nearest inlet, and their times; all links are taken away first."""
    from culvert.functions.hydrology import kirpich_minutes

    areas = _catchments(spark, sf_dir).withColumn("inlet", F.lit(None).cast("string"))
    made = editing.flow_lengths(areas, _stations(spark, sf_dir))
    return made.select("id", r6("flow_length_ft", "flow_length_ft", 4), r6(kirpich_minutes("flow_length_ft", "slope"), "minutes", 4))


_SX, _SY = "(CAST(s_acctbal AS DOUBLE) / 100.0::DOUBLE)", "CAST(s_suppkey % 97 AS DOUBLE)"


@query(f"""WITH s AS (SELECT s_nationkey AS net, s_suppkey AS k, {_SX} AS x, {_SY} AS y, lead({_SX}) OVER w AS x2, lead({_SY}) OVER w AS y2, row_number() OVER w AS i FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)),
       m AS (SELECT c_custkey, k, {_PX} AS px, {_PY} AS py, s.* EXCLUDE (k, net, i), greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({_PX} - x) * (x2 - x) + ({_PY} - y) * (y2 - y)) / nullif(pow(x2 - x, 2) + pow(y2 - y, 2), 0))) AS t FROM customer JOIN s ON net = c_nationkey AND x2 IS NOT NULL AND i % 2 = 1),
       d AS (SELECT c_custkey, k, sqrt(pow(px - x - coalesce(t, 0) * (x2 - x), 2) + pow(py - y - coalesce(t, 0) * (y2 - y), 2)) AS d FROM m)
       SELECT c_custkey AS point, 'P' || arg_min(k, (d, k)) AS id, round(min(d), 6) AS distance FROM d WHERE d <= 40.0::DOUBLE GROUP BY c_custkey""")
def nearest_pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipe within 40 ft that is nearest to each customer; each two suppliers of a nation are ends of one."""
    from pyspark.sql import Window as W

    nodes = _stations(spark, sf_dir)
    along = W.partitionBy("network_id").orderBy("ord")
    row = nodes.withColumns({"to": F.lead("id").over(along), "i": F.row_number().over(along)}).filter(F.col("to").isNotNull() & (F.col("i") % 2 == 1))
    pipes = row.select("network_id", "ord", F.concat(F.lit("P"), "id").alias("_p"), F.col("id").alias("from"), "to").withColumnRenamed("_p", "id")
    points = _plots(spark, sf_dir).select(F.col("c_nationkey").cast("bigint").alias("network_id"), F.col("c_custkey").alias("point"), "x", "y")
    return editing.nearest_pipe(points, nodes, pipes, 40.0).select("point", "id", r6("distance", "distance"))


@query(f"SELECT network_id, round(acres, 6) AS acres, n FROM (SELECT c_nationkey AS network_id, sum(30000.0::DOUBLE * (1.0::DOUBLE + c_custkey % 7) * (2.0::DOUBLE + c_nationkey % 5)) / 43560.0::DOUBLE AS acres, count(*) AS n FROM customer GROUP BY c_nationkey)")
def total_catchments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catchment area of each project."""
    return ge.total_areas(_catchments(spark, sf_dir)).select("network_id", r6("acres", "acres"), "n")
