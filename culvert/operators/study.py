"""A whole study of projects: checks, merged catchments, all periods, review, sizes and costs."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert.functions import units as un
from culvert.functions.inlets import node_inlets
from culvert.operators.design import pipe_costs, review_analysis, size_network
from culvert.operators.editing import merge_catchments
from culvert.operators.network import Analysis, analyze
from culvert.operators.validation import diagnose, validate
from culvert.schema import Params
from culvert.sources.project import Engine, Project, defaults, engine_tables


class Study(NamedTuple):
    """Lazy frames; `errors` are of projects that were left out."""

    errors: DataFrame
    diagnostics: DataFrame
    design: Analysis
    periods: Analysis
    findings: DataFrame
    sizes: DataFrame
    costs: DataFrame
    inlets: DataFrame


def analysis_tables(project: Project, all_periods: bool = False) -> Engine:
    """Engine tables with the catchments of a project merged into their inlets, in US units."""
    made = engine_tables(project, all_periods)
    units = project.settings.select("network_id", "units")
    feet = lambda p: F.struct(un.to_feet(p["x"], "units").alias("x"), un.to_feet(p["y"], "units").alias("y"))
    areas = project.catchments.join(units, "network_id").withColumn("vertices", F.transform("vertices", feet)).withColumn("flow_length_ft", un.to_feet("flow_length_ft", "units"))
    return made._replace(nodes=merge_catchments(made.nodes, areas.drop("units")))


def run_study(project: Project, params: Params = Params()) -> Study:
    """Everything that a user asks of projects, for all projects at once.

    Projects with errors (missing keys, no nodes, no outfall, repeated ids, dangling pipes) are
    left out. The review reads the unmerged network, whose geometry is the same.
    """
    networks = project.settings.select("network_id")
    found = validate(networks, project.nodes, project.pipes)
    errors = found.unionByName(project.errors.select("network_id", F.lit("document").alias("rule"), F.lit("error").alias("severity"), F.lit("project").alias("id"), F.col("error").alias("message")))
    bad = errors.select("network_id").distinct()
    good = lambda df: df.join(bad, "network_id", "left_anti")
    plain = Engine(*(good(df) for df in engine_tables(project)))
    one, every = (Engine(*(good(df) for df in analysis_tables(project, k))) for k in (False, True))
    design = analyze(one.nodes, one.pipes, one.idf, params.options, one.scenarios)
    periods = analyze(every.nodes, every.pipes, every.idf, params.options, every.scenarios)
    return Study(
        errors,
        diagnose(networks, project.nodes, project.pipes, project.catchments),
        design,
        periods,
        review_analysis(plain.nodes, plain.pipes, design, params.review),
        size_network(one.pipes, design.pipes, params.design),
        pipe_costs(plain.pipes),
        node_inlets(one.nodes, one.pipes, design.pipes, params.inlet),
    )


def convert_project(project: Project, units: str) -> Project:
    """Projects in SI or US customary units; those already in them stay as they are.

    Lengths, areas, intensities and sizes are scaled, a stored access hole too; diameters become
    nominal metric ones, or whole inches.
    """
    own = project.settings.select("network_id", "units")
    part = lambda df, same: df.join(own.filter((F.col("units") == units) if same else (F.col("units") != units)).select("network_id"), "network_id", "left_semi")
    f, a, i = (un.M_PER_FT, un.HA_PER_AC, un.MM_PER_IN) if units == "si" else (1 / un.M_PER_FT, 1 / un.HA_PER_AC, 1 / un.MM_PER_IN)
    other = part(project.settings, False)
    settings = other.withColumns({c: F.col(c) * f for c in ("tailwater", "access_hole_diam_ft")} | {"idf_a": F.col("idf_a") * i, "units": F.lit(units)})
    areas = part(project.catchments, False).withColumns({"vertices": F.transform("vertices", lambda p: F.struct((p["x"] * f).alias("x"), (p["y"] * f).alias("y"))), "flow_length_ft": F.col("flow_length_ft") * f})
    nodes = un.nodes_to(part(project.nodes, False), units).withColumn("inlet_length_ft", F.col("inlet_length_ft") * f)
    return Project(
        part(project.settings, True).unionByName(settings),
        part(project.nodes, True).unionByName(nodes),
        part(project.pipes, True).unionByName(un.pipes_to(part(project.pipes, False), units)),
        part(project.catchments, True).unionByName(areas),
        part(project.idf, True).unionByName(part(project.idf, False).withColumn("a", F.col("a") * i)),
        project.errors,
    )


def from_engine(nodes: DataFrame, pipes: DataFrame, names: DataFrame) -> Project:
    """Projects of engine tables (network_id, name in names), shapes kept."""
    spark = nodes.sparkSession
    has = set(nodes.columns)
    fill = {c: F.lit(v) for c, v in (("inlet_length_ft", 0.0), ("inlet_slope", 0.0), ("inlet_sag", False)) if c not in has}
    shape = F.when(F.col("shape") == "rectangular", "box").otherwise(F.coalesce("shape", F.lit("circular")))
    flat = lambda c: F.when(shape == "circular", 0.0).otherwise(F.col(c))
    return Project(
        defaults(names, name=F.col("name")),
        nodes.withColumns(fill),
        pipes.withColumns({"rise": flat("rise"), "span": flat("span")}).withColumn("shape", shape),
        spark.createDataFrame([], "network_id bigint, ord int, id string, vertices array<struct<x:double,y:double>>, c double, flow_length_ft double, slope double, inlet string"),
        spark.createDataFrame([], "network_id bigint, rp_years int, a double, b double, c double"),
        spark.createDataFrame([], "network_id bigint, error string"),
    )
