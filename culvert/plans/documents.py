"""Registered queries of file formats: texts made of the views, read again by the readers, whole.

Rows of different tables of one file come as parts of one result: part, id, two texts, four numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.functions import hydrology as hd
from culvert.operators import network, study
from culvert.operators.graph import kept
from culvert.plans import views
from culvert.plans.catalog import _nation_curves, query
from culvert.sinks.drawing import project_texts
from culvert.sources import dxf, landxml, noaa, project, ssn, stm

_NONE = "CAST(NULL AS DOUBLE)"
#: Chains with the places of their nodes: invert and x of a reach's upper end, and its lower end's.
_PLACED = """SELECT *, 100.0::DOUBLE + sum(slope * length) OVER (PARTITION BY network_id ORDER BY ord DESC ROWS UNBOUNDED PRECEDING) AS inv,
    coalesce(sum(length) OVER (PARTITION BY network_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x, max(ord) OVER (PARTITION BY network_id) AS last FROM ({})"""
_CHAIN = _PLACED.format(views.REACH)


def _part(df: DataFrame, part: str, id_, a=None, b=None, numbers=()) -> DataFrame:
    """Rows of one table of a file: numbers are rounded to 6 digits."""
    text = lambda c: F.lit(None).cast("string") if c is None else (c if isinstance(c, Column) else F.col(c)).cast("string")
    values = [F.round((v if isinstance(v, Column) else F.col(v)).cast("double"), 6) for v in numbers]
    values += [F.lit(None).cast("double")] * (4 - len(values))
    return df.select("network_id", F.lit(part).alias("part"), text(id_).alias("id"), text(a).alias("a"), text(b).alias("b"), *[v.alias(f"v{k + 1}") for k, v in enumerate(values)])


def _sql_part(part: str, source: str, id_: str, a: str = "NULL", b: str = "NULL", numbers: tuple[str, ...] = ()) -> str:
    values = [f"round(CAST({v} AS DOUBLE), 6)" for v in numbers] + [_NONE] * (4 - len(numbers))
    columns = ", ".join(f"{v} AS v{k + 1}" for k, v in enumerate(values))
    return f"SELECT network_id, '{part}' AS part, CAST({id_} AS VARCHAR) AS id, CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, {columns} FROM {source}"


def _all(parts: list[DataFrame]) -> DataFrame:
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _texts(parts: list[DataFrame]) -> DataFrame:
    """(network_id, file, text) of lines (network_id, k, ord, line), in that order."""
    listed = F.array_sort(F.collect_list(F.struct("k", "ord", "line")))
    made = _all(parts).groupBy("network_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("text"))
    return made.withColumn("file", F.lit("made.txt"))


def _line(df: DataFrame, k: int, ord_, *cells) -> DataFrame:
    text = [c if isinstance(c, Column) else F.lit(c) for c in cells]
    return df.select("network_id", F.lit(k).alias("k"), F.lit(ord_).cast("int").alias("ord") if isinstance(ord_, int) else F.col(ord_).cast("int").alias("ord"), F.concat(*[t.cast("string") for t in text]).alias("line"))


def _joined(*names: str) -> list:
    """Columns with blanks between them."""
    return [x for name in names for x in (F.lit(" "), F.col(name))]


_TO = "CASE WHEN ord = last THEN 'OUT' ELSE CAST(ord + 1 AS VARCHAR) END"


@query(
    f"WITH c AS MATERIALIZED ({_CHAIN}) "
    + " UNION ALL ".join(
        [
            _sql_part("node", "c", "ord", "'inlet'", "NULL", ("inv", "inv + 8.0::DOUBLE", "area_ac", "tc_inlet")),
            _sql_part("node", "c WHERE ord = last", "'OUT'", "'outfall'", "NULL", ("100", "108", "0", "0")),
            _sql_part("pipe", "c", "'P' || ord", "ord", _TO, ("length", "diameter", "n")),
            _sql_part("options", "c WHERE ord = 1", "'IDF'", "NULL", "NULL", ("60", "10", "7.5", "101.25")),
            _sql_part("error", "c WHERE ord = last AND network_id % 5 = 0", "'line ' || (2 * last + 6) || ': unknown keyword culvert'", "NULL", "NULL", ("2 * last + 6",)),
            _sql_part("error", "c WHERE ord = last AND network_id % 5 = 0", "'line ' || (2 * last + 7) || ': ten is not a number'", "NULL", "NULL", ("2 * last + 7",)),
        ]
    )
)
def ssn_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`.ssn` texts of all chains, some with unknown keywords and numbers that are none."""
    nodes, pipes = map(kept, views.chain(spark, sf_dir))
    ends = nodes.filter("kind = 'outfall'")
    upper = F.when(F.col("ord") % 2 == 0, "NODE ").otherwise("node ")
    parts = [
        _line(ends, 0, 1, "# a chain"),
        _line(ends, 0, 2, "idf 60 10 0.8  # a b c"),
        _line(ends, 0, 3, "MINTC 7.5"),
        _line(ends, 0, 4, "\tTAILWATER   101.25"),
        _line(nodes, 1, "ord", upper, F.col("id"), *_joined("kind", "x", "y", "invert", "rim"), F.when(F.col("kind") == "outfall", "").otherwise(F.concat_ws(" ", F.lit(""), "area_ac", "c", "tc_inlet"))),
        _line(pipes, 2, "ord", "PIPE ", F.col("id"), *_joined("from", "to", "length", "diameter", "n")),
        _line(ends.filter("network_id % 5 = 0"), 3, 1, "culvert 7"),
        _line(ends.filter("network_id % 5 = 0"), 3, 2, "JUNCTIONK ten"),
    ]
    n = ssn.parse_ssn(kept(_texts(parts), "zstd"))
    options = n.idf.join(n.scenarios, ["network_id", "rp_years"])
    return _all(
        [
            _part(n.nodes, "node", "id", "kind", None, ("invert", "rim", "area_ac", "tc_inlet")),
            _part(n.pipes, "pipe", "id", "from", "to", ("length", "diameter", "n")),
            _part(options, "options", F.lit("IDF"), None, None, ("a", "b", "min_tc", "tailwater")),
            _part(n.errors, "error", "error", None, None, ("line_no",)),
        ]
    )


_F = "(CASE WHEN network_id % 2 = 0 THEN 1.0::DOUBLE / 0.3048::DOUBLE ELSE 1.0::DOUBLE END)"
_A = "(CASE WHEN network_id % 2 = 0 THEN 1.0::DOUBLE / 0.404686::DOUBLE ELSE 1.0::DOUBLE END)"
_I = "(CASE WHEN network_id % 2 = 0 THEN 1.0::DOUBLE / 25.4::DOUBLE ELSE 1.0::DOUBLE END)"
_BOX = "(ord % 3 = 0)"


@query(
    f"WITH c AS MATERIALIZED ({_CHAIN}) "
    + " UNION ALL ".join(
        [
            _sql_part("node", "c", "ord", "CASE WHEN ord % 4 = 0 THEN 'junction' ELSE 'inlet' END", "NULL", (f"inv * {_F}", f"(inv + 8.0::DOUBLE) * {_F}", f"area_ac * {_A}", "tc_inlet")),
            _sql_part("node", "c WHERE ord = last", "'OUT'", "'outfall'", "NULL", (f"100 * {_F}", f"108 * {_F}", "0", "0")),
            _sql_part("pipe", "c", "'P' || ord", f"CASE WHEN {_BOX} THEN 'rectangular' ELSE 'circular' END", _TO, (f"length * {_F}", f"diameter * {_F}", f"CASE WHEN {_BOX} THEN diameter * {_F} ELSE 0 END", f"CASE WHEN {_BOX} THEN 2 * diameter * {_F} ELSE 0 END")),
            _sql_part("curve", "c WHERE ord = 1", "10", "NULL", "NULL", (f"CASE WHEN network_id % 3 = 0 THEN 70 ELSE 60 END * {_I}", "10", "0.8")),
            _sql_part("scenario", "c WHERE ord = 1", "10", "NULL", "NULL", (f"101.5::DOUBLE * {_F}", "10", "1", "4")),
            _sql_part("catchment", "c WHERE ord = 1", "'C1'", "'1'", "NULL", ("3", "50", "0.6", "120")),
        ]
    )
)
def project_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project documents of all chains, every second one in SI units, written, read, and made engine tables."""
    nodes, pipes = views.chain(spark, sf_dir)
    nodes = nodes.withColumn("kind", F.when((F.col("kind") == "inlet") & (F.col("ord") % 4 == 0), "junction").otherwise(F.col("kind")))
    box = F.col("ord") % 3 == 0
    pipes = pipes.withColumns({"shape": F.when(box, "rectangular").otherwise("circular"), "rise": F.col("diameter"), "span": F.when(box, 2.0 * F.col("diameter")).otherwise(F.col("diameter"))})
    names = nodes.filter("kind = 'outfall'").select("network_id", F.concat(F.lit('chain "'), F.col("network_id").cast("string"), F.lit('"')).alias("name"))
    made = study.from_engine(nodes, pipes, names)
    point = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    corners = F.array(point(0.0, 0.0), point(10.0, 0.0), point(0.0, 10.0))
    area = names.select("network_id", F.lit(1).alias("ord"), F.lit("C1").alias("id"), corners.alias("vertices"), F.lit(0.6).alias("c"), F.lit(120.0).alias("flow_length_ft"), F.lit(0.01).alias("slope"), F.lit("1").alias("inlet"))
    curves = names.filter("network_id % 3 = 0").select("network_id", F.lit(10).alias("rp_years"), F.lit(70.0).alias("a"), F.lit(10.0).alias("b"), F.lit(0.8).alias("c"))
    settings = made.settings.withColumns({"units": F.when(F.col("network_id") % 2 == 0, "si").otherwise("us_customary"), "tailwater": F.lit(101.5)})
    back = project.parse_projects(project_texts(made._replace(settings=settings, catchments=area, idf=curves)))
    e = project.engine_tables(back)
    from culvert.functions.geometry import shoelace_area

    return _all(
        [
            _part(e.nodes, "node", "id", "kind", None, ("invert", "rim", "area_ac", "tc_inlet")),
            _part(e.pipes, "pipe", "id", "shape", "to", ("length", "diameter", "rise", "span")),
            _part(e.idf, "curve", "rp_years", None, None, ("a", "b", "c")),
            _part(e.scenarios, "scenario", "rp_years", None, None, ("tailwater", "min_tc", "cf", "access_hole_diam_ft")),
            _part(back.catchments, "catchment", "id", "inlet", None, (F.size("vertices"), shoelace_area("vertices"), "c", "flow_length_ft")),
            _part(back.errors, "error", "error"),
        ]
    )


def _stm_texts(nodes: DataFrame, pipes: DataFrame) -> DataFrame:
    """`.stm` texts of chains: every second reach is a box, the first one begins at an inlet."""
    up = nodes.select("network_id", F.col("id").alias("from"), "x", "invert", "rim", "area_ac", "c", "tc_inlet")
    dn = nodes.select("network_id", F.col("id").alias("to"), F.col("kind").alias("dn_kind"), F.col("x").alias("x2"), F.col("invert").alias("invert2"), F.col("rim").alias("rim2"))
    line = pipes.join(up, ["network_id", "from"]).join(dn, ["network_id", "to"])
    field = lambda label, value: F.concat(F.lit(f'"{label}",'), value.cast("string"))
    c, first = F.col, F.col("ord") == 1
    inches = c("diameter") * 12.0
    block = F.concat_ws(
        "\n", field("Line No. = ", c("ord")), field("Downstream Line No. = ", F.when(c("dn_kind") == "outfall", 0).otherwise(c("ord") + 1)), field("Line ID = ", F.lit('"run"')), field("Line Type = ", F.when(c("ord") % 2 == 0, '"Box"').otherwise('"Cir"')),
        field("Inlet ID = ", F.when(first, '"IN 1"').otherwise('""')), field("Drainage Area = ", c("area_ac")), field("Runoff Coeff. = ", c("c")), field("Inlet Time = ", c("tc_inlet")), field("Line Length = ", c("length")),
        field("X,Y Coord Up = ", F.concat_ws(",", c("x"), F.lit(0.0))), field("X,Y Coord Dn = ", F.concat_ws(",", c("x2"), F.lit(0.0))), field("Invert Elev Up = ", c("invert")), field("Invert Elev Dn = ", c("invert2")),
        field("Ground / Rim Elev Up = ", c("rim")), field("Ground / Rim Elev Dn = ", c("rim2")), field("Rise = ", inches), field("Span = ", F.when(c("ord") % 2 == 0, 2.0 * inches).otherwise(inches)), field("N-Value = ", c("n")), F.lit("-" * 39),
    )
    ends = nodes.filter("kind = 'outfall'")
    head = [
        f'"{stm.MAGIC}"', '"SI Units? ",#FALSE#', '"Minimum Tc used to calc Intensity",6', '"Default Pipe n-value = ",0.015', '"Min Slope = ",0.2', '"Return Period Index = ",5',
    ]
    rows = [",".join(str(round(base + step * k, 6)) for k in range(8)) for base, step in ((60.0, 1.0), (10.0, 1.0), (0.7, 0.01))]
    parts = [_line(ends, 0, k, text) for k, text in enumerate(head)]
    parts += [_line(ends, 1, 0, '"Project Name = ","Job ', F.col("network_id"), '"'), _line(ends, 2, 0, '"LINE DATA"')]
    parts += [line.select("network_id", F.lit(3).alias("k"), F.col("ord").cast("int").alias("ord"), block.alias("line")), _line(ends, 4, 0, '"IDF Curves"')]
    parts += [_line(ends, 5, k, text) for k, text in enumerate(rows)]
    return _texts(parts)


_PERIOD_ROW = ", ".join(f"({rp}, {60.0 + k}::DOUBLE, {10.0 + k}::DOUBLE, {0.7 + 0.01 * k:.2f}::DOUBLE)" for k, rp in stm.PERIODS.items())


@query(
    f"WITH c AS MATERIALIZED ({_CHAIN}) "
    + " UNION ALL ".join(
        [
            _sql_part("node", "c WHERE ord = 1", "'IN_1'", "'inlet'", "NULL", ("x", "inv", "inv + 8.0::DOUBLE", "area_ac")),
            _sql_part("node", "c", "'N' || (ord + 1)", "CASE WHEN ord = last THEN 'outfall' ELSE 'junction' END", "NULL", ("x + length", "inv - slope * length", "inv - slope * length + 8.0::DOUBLE", "0")),
            _sql_part("pipe", "c", "'P' || ord", "CASE WHEN ord = 1 THEN 'IN_1' ELSE 'N' || ord END", "'N' || (ord + 1)", ("length", "CASE WHEN ord % 2 = 0 THEN 2 * diameter ELSE diameter END", "n", "CASE WHEN ord % 2 = 0 THEN 2 * diameter ELSE 0 END")),
            _sql_part("curve", f"c, (VALUES {_PERIOD_ROW}) t(rp, ia, ib, ic) WHERE ord = 1", "rp", "NULL", "NULL", ("ia", "ib", "ic")),
            _sql_part("settings", "c WHERE ord = 1", "'Job ' || network_id", "'us_customary'", "NULL", ("25", "6", "0.002", "65")),
        ]
    )
)
def stm_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`.stm` texts of all chains: header, line blocks, curves."""
    nodes, pipes = views.chain(spark, sf_dir)
    p = stm.parse_stm(kept(_stm_texts(kept(nodes), kept(pipes)), "zstd"), kept)
    return _all(
        [
            _part(p.nodes, "node", "id", "kind", None, ("x", "invert", "rim", "area_ac")),
            _part(p.pipes, "pipe", "id", "from", "to", ("length", "diameter", "n", "span")),
            _part(p.idf, "curve", "rp_years", None, None, ("a", "b", "c")),
            _part(p.settings, "settings", "name", "units", None, ("design_return_period_years", "min_tc", "min_slope", "idf_a")),
            _part(p.errors, "error", "error"),
        ]
    )


_DURATIONS = {"5-min:": 5, "10-min:": 10, "15-min:": 15, "30-min:": 30, "60-min:": 60, "2-hr:": 120, "3-hr:": 180, "1-day:": 1440}
_RPS = (2, 5, 10, 25, 50, 100)
_FACTORS = "(VALUES (2, 0.75::DOUBLE), (5, 0.88::DOUBLE), (10, 1.0::DOUBLE), (25, 1.15::DOUBLE), (50, 1.28::DOUBLE), (100, 1.40::DOUBLE)) f(rp, factor)"


def _atlas_texts(spark: SparkSession, sf_dir: str, durations: dict[str, int]) -> DataFrame:
    """A rainfall file for each nation: depths of its own curve; some without durations."""
    n = _nation_curves(spark, sf_dir).drop("rp_years")
    depth = lambda t, rp: F.col("a") * hd.SYNTHETIC_FACTORS[rp] / F.pow(F.col("b") + float(t), F.col("c")) * (t / 60.0)
    lines = [F.lit("Point precipitation frequency estimates (inches)"), F.lit(""), F.lit("by duration for ARI (years):, " + ",".join(map(str, _RPS)))]
    lines += [F.concat_ws(",", F.lit(label), *[depth(t, rp).cast("string") for rp in _RPS]) for label, t in durations.items()]
    whole = F.concat_ws("\n", *lines, F.lit(""), F.lit("by duration for ARI (years):, 1"), F.lit("5-min:,9"))
    return n.select("network_id", F.lit("atlas.csv").alias("file"), F.when(F.col("network_id") % 10 == 9, F.lit("no table here")).otherwise(whole).alias("text"))


@query(
    "SELECT network_id, part, id, a, b, v1, v2, v3, v4 FROM ("
    + _sql_part("depth", f"(SELECT n_nationkey AS network_id, 50.0::DOUBLE + n_nationkey AS na FROM nation) n, {_FACTORS}, (SELECT unnest([5, 10, 15, 30, 60, 120, 180, 1440]) AS t) WHERE network_id % 10 <> 9", "rp", "t", "NULL", ("na * factor / pow(10.0::DOUBLE + t, 0.8::DOUBLE) * t / 60.0::DOUBLE",))
    + " UNION ALL "
    + _sql_part("error", "(SELECT n_nationkey AS network_id FROM nation) WHERE network_id % 10 = 9", "'no header of return periods'")
    + ")"
)
def atlas_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth-duration tables of nations, read again: one row a duration and period."""
    depths, errors = noaa.parse_atlas14(_atlas_texts(spark, sf_dir, _DURATIONS))
    minutes = F.col("duration_min").cast("int")
    return _part(depths, "depth", "rp_years", minutes, None, ("depth_in",)).unionByName(_part(errors, "error", "error"))


@query(f"""SELECT n_nationkey AS network_id, rp AS rp_years, round((50.0::DOUBLE + n_nationkey) * factor + 0.003::DOUBLE, 1) AS a, 10.0::DOUBLE AS b, 0.8::DOUBLE AS c, CASE WHEN n_nationkey % 3 = 0 THEN 'si' ELSE 'us_customary' END AS units,
           round((50.0::DOUBLE + n_nationkey) * 1.15::DOUBLE + 0.003::DOUBLE, 1) AS idf_a FROM nation, {_FACTORS} WHERE n_nationkey % 10 <> 9""")
def rainfall_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves fitted to the tables of nations, and imported into projects of both units with a 30-year design period."""
    depths, _ = noaa.parse_atlas14(_atlas_texts(spark, sf_dir, {k: v for k, v in _DURATIONS.items() if v <= 180}))
    fitted = hd.atlas_to_idf(depths)
    names = _nation_curves(spark, sf_dir).select("network_id").filter("network_id % 10 <> 9")
    units = F.when(F.col("network_id") % 3 == 0, "si").otherwise("us_customary")
    settings = project.defaults(names, units=units, design_return_period_years=F.lit(30.0))
    none = spark.createDataFrame([], "network_id bigint")
    own = project.import_rainfall(project.Project(settings, none, none, none, none, none), fitted)
    back = own.idf.join(own.settings.select("network_id", "units", "idf_a"), "network_id")
    # Fits come near to the curves: 0.003 keeps them from ties of the rounding.
    inches = lambda c: F.round(F.when(F.col("units") == "si", F.col(c) / 25.4).otherwise(F.col(c)) + 0.003, 1).alias(c)
    return back.select("network_id", "rp_years", inches("a"), F.round("b", 1).alias("b"), F.round("c", 2).alias("c"), "units", inches("idf_a"))


@query("""SELECT c_custkey AS network_id, CASE WHEN x = 0 AND y = 0 THEN 0 ELSE 1 END + 4 + 24 AS n, round(sqrt(x * x + y * y) + 2 * sqrt(9.0::DOUBLE + 16.0::DOUBLE) + 2 * sqrt(36.0::DOUBLE + 16.0::DOUBLE) + 48.0::DOUBLE * r * sin(pi() / 24.0::DOUBLE), 5) AS total
          FROM (SELECT c_custkey, CAST(c_acctbal AS DOUBLE) / 100.0::DOUBLE AS x, CAST(c_custkey % 97 AS DOUBLE) AS y, 1.0::DOUBLE + c_custkey % 5 AS r FROM customer)""")
def underlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawings of a line, a closed polyline and a circle, with the network's own layers passed over."""
    x, y, r = F.col("c_acctbal").cast("double") / 100.0, (F.col("c_custkey") % 97).cast("double"), 1.0 + F.col("c_custkey") % 5
    pairs = lambda *p: F.concat_ws("\n", *[t for code, v in p for t in (F.lit(str(code)), v.cast("string") if isinstance(v, Column) else F.lit(str(v)))])
    corner = lambda dx, dy: ((10, x + dx), (20, y + dy))
    text = F.concat_ws(
        "\n", pairs((0, "SECTION"), (2, "ENTITIES")), pairs((0, "LINE"), (8, "roads"), (10, 0.0), (20, 0.0), (11, x), (21, y)),
        pairs((0, "LWPOLYLINE"), (8, "0"), (90, 4), *corner(-3.0, 0.0), *corner(0.0, 4.0), *corner(6.0, 0.0), *corner(0.0, -4.0)), pairs((0, "CIRCLE"), (8, "trees"), (10, x), (20, y), (40, r)),
        pairs((0, "CIRCLE"), (8, dxf.LAYERS["nodes"]), (10, x), (20, y), (40, 5.0)), pairs((0, "ENDSEC"), (0, "EOF")),
    )
    found = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("network_id"), text.alias("text"))
    length = F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))
    return dxf.parse_underlay(found).groupBy("network_id").agg(F.count("*").alias("n"), F.round(F.sum(length), 5).alias("total"))


_M = "3.280839895::DOUBLE"


@query(
    "WITH n AS (SELECT n_nationkey AS network_id, CAST(n_nationkey AS DOUBLE) AS k FROM nation) "
    + " UNION ALL ".join(
        [
            _sql_part("node", "n", "'N1'", "'inlet'", "NULL", ("0", f"k * {_M}", f"(k + 5) * {_M} - 5", f"(k + 5) * {_M}")),
            _sql_part("node", "n", "'N2'", "'junction'", "NULL", (f"40 * {_M}", "0", f"2 * {_M}", f"2 * {_M} + 5")),
            _sql_part("node", "n", "'N3'", "'outfall'", "NULL", (f"40 * {_M}", f"(30 + k) * {_M}", f"1.5::DOUBLE * {_M}", f"4 * {_M}")),
            _sql_part("pipe", "n", "'P1'", "'N1'", "'N2'", (f"sqrt(1600.0::DOUBLE + k * k) * {_M}", "450.0::DOUBLE / 304.8::DOUBLE")),
            _sql_part("pipe", "n", "'P2'", "'N2'", "'N3'", (f"(30 + k) * {_M}", "600.0::DOUBLE / 304.8::DOUBLE")),
        ]
    )
)
def landxml_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LandXML in metres and millimetres, with a prefix, ends named by children, a pipe to nowhere, and
    kinds and elevations that follow from what else is given."""
    k = lambda x: F.format_string("%.1f", x)
    n = F.col("n_nationkey").cast("double")
    text = F.concat(
        F.lit('<?xml version="1.0"?>\n<lx:LandXML xmlns:lx="http://www.landxml.org/schema/LandXML-1.2"><lx:Units><lx:Metric linearUnit="meter" diameterUnit="millimeter"></lx:Metric></lx:Units><lx:PipeNetworks><lx:PipeNetwork name="none"/><lx:PipeNetwork name="m"><lx:Structs>'),
        F.lit('<lx:Struct name="CB-1"><lx:Center>'), k(n), F.lit(" 0 "), k(n + 5.0), F.lit("</lx:Center></lx:Struct>"),
        F.lit('<lx:Struct name="IN-2" role="Manhole"><lx:Center>0 40</lx:Center><lx:Invert>2</lx:Invert></lx:Struct>'),
        F.lit('<lx:Struct name="Outlet"><lx:Center>'), k(n + 30.0), F.lit(" 40 9</lx:Center><lx:Invert>1.5</lx:Invert><lx:ElevRim>4</lx:ElevRim></lx:Struct></lx:Structs><lx:Pipes>"),
        F.lit('<lx:Pipe name="a" refStart="CB-1" refEnd="IN-2"><lx:CircPipe diameter="450"/></lx:Pipe><lx:Pipe name="lost" refStart="CB-1" refEnd="nowhere"><lx:CircPipe diameter="450"/></lx:Pipe>'),
        F.lit('<lx:Pipe name="b"><lx:StartStruct>IN-2</lx:StartStruct><lx:EndStruct>Outlet</lx:EndStruct><lx:CircPipe diameter="600"/></lx:Pipe></lx:Pipes></lx:PipeNetwork></lx:PipeNetworks></lx:LandXML>'),
    )
    p = landxml.parse_landxml(views.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("network_id"), text.alias("text")))
    return _part(p.nodes, "node", "id", "kind", None, ("x", "y", "invert", "rim")).unionByName(_part(p.pipes, "pipe", "id", "from", "to", ("length", "diameter")))


@query(f"SELECT network_id, round(d, 6) AS total_ca, round(q, 4) AS last_q FROM (SELECT network_id, sum(least(c, 1.0::DOUBLE) * area_ac) AS d, sum(least(c, 1.0::DOUBLE) * area_ac) * 3.0::DOUBLE AS q FROM ({views.REACH}) GROUP BY network_id)")
def ssn_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`.ssn` texts of all chains under one intensity, read and solved: the last reach of each."""
    nodes, pipes = views.chain(spark, sf_dir)
    ends = nodes.filter("kind = 'outfall'")
    parts = [
        _line(ends, 0, 1, "INTENSITY 3"),
        _line(nodes, 1, "ord", "NODE ", F.col("id"), *_joined("kind", "x", "y", "invert", "rim", "area_ac", "c", "tc_inlet")),
        _line(pipes, 2, "ord", "PIPE ", F.col("id"), *_joined("from", "to", "length", "diameter", "n")),
    ]
    n = ssn.parse_ssn(_texts(parts))
    a = network.analyze(n.nodes, n.pipes, n.idf, scenarios=n.scenarios)
    return a.pipes.filter("`to` = 'OUT'").select("network_id", F.round("total_ca", 6).alias("total_ca"), F.round("design_q", 4).alias("last_q"))
