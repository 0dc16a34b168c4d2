import json

import pytest
from pyspark.sql import functions as F
from test_files import SSN, engine_flows, given

from culvert import cli
from culvert.operators.study import convert_project, from_engine, run_study
from culvert.sinks.drawing import project_texts
from culvert.sources import project
from culvert.streaming.rain import intensities


def documents(spark):
    doc = json.loads(project_texts(project.demo(spark)).first().text) | {"catchments": []}
    side = 43560.0**0.5
    square = [[0.0, 0.0], [side, 0.0], [side, side], [0.0, side]]
    merged = doc | {"catchments": [{"id": "C1", "vertices": square, "c": 0.5, "flow_length_ft": 10.0, "slope": 0.1, "inlet_node_id": "N1"}]}
    broken = doc | {"pipes": [*doc["pipes"], doc["pipes"][0] | {"id": "X", "to": "GONE"}]}
    return project.parse_projects(given(spark, json.dumps(doc), json.dumps(merged), json.dumps(broken)))


def test_study(spark):
    s = run_study(documents(spark))
    assert {(r.network_id, r.rule) for r in s.errors.collect()} == {(3, "dangling_to")}
    q = {(r.network_id, r.id): r.design_q for r in s.design.pipes.collect()}
    assert q[1, "P3"] == pytest.approx(8.4768, abs=1e-4) and q[2, "P1"] > q[1, "P1"] and {k for k, _ in q} == {1, 2}
    assert {r.rp_years for r in s.periods.pipes.collect()} == {2, 5, 10, 25, 50, 100}
    assert ("pct_full", "P2") in {(r.rule, r.id) for r in s.findings.filter("network_id = 1").collect()}
    assert s.sizes.filter("network_id = 1 and id = 'P2'").first().outcome == "sized"
    assert s.costs.filter("network_id = 1").agg(F.sum("line_cost")).first()[0] > 0
    inlet = s.inlets.filter("network_id = 1 and id = 'N1'").first()
    assert inlet.design_q == pytest.approx(q[1, "P1"]) and inlet.spread_ft > 0
    assert s.diagnostics.filter("network_id = 2").count() == 0


def test_units_do_not_change_flows(spark):
    p = project.demo(spark)
    si = convert_project(p, "si")
    assert si.settings.first().units == "si" and {r.diameter for r in si.pipes.collect()} == {0.375, 0.45, 0.525}
    assert engine_flows(si)["P1"] == pytest.approx(engine_flows(p)["P1"], rel=1e-9)
    back = convert_project(si, "us_customary")
    assert {r.id: round(r.diameter * 12) for r in back.pipes.collect()} == {"P1": 15, "P2": 18, "P3": 21}
    assert convert_project(p, "us_customary").pipes.count() == 3


def test_documents_of_engine_tables(spark):
    e = project.engine_tables(project.demo(spark))
    made = from_engine(e.nodes, e.pipes, spark.createDataFrame([(1, "again")], "network_id bigint, name string"))
    again = project.parse_projects(project_texts(made))
    assert again.errors.count() == 0 and again.settings.first().name == "again" and engine_flows(again)["P1"] == pytest.approx(3.5425, abs=1e-4)
    assert project.empty(spark).nodes.count() == 1


def test_analyze_ssn(spark):
    got = {r.network_id: r.text for r in cli.analyze_ssn(given(spark, SSN, "WHAT")).collect()}
    assert "P3" in got[1] and got[2] == "error: line 1: unknown keyword WHAT"


def test_rain_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:01:00", 0.2), ("a", "2024-01-01 00:09:00", 0.3), ("a", "2024-01-01 00:12:00", 0.1), ("b", "2024-01-01 00:02:00", 1.0)]
    schema = "gauge string, at timestamp, depth_in double"
    data = spark.createDataFrame(rows, "gauge string, at string, depth_in double").withColumn("at", F.to_timestamp("at"))
    batch = {(r.gauge, r.start.minute): round(r.intensity, 6) for r in intensities(data).collect()}
    assert batch == {("a", 0): 3.0, ("a", 10): 0.6, ("b", 0): 6.0}
    data.write.parquet(str(tmp_path / "in"))
    stream = intensities(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("rain").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.table("rain").count() == 3
