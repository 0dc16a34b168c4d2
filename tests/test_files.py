import json

import pytest
from nets import demo, frames
from pyspark.sql import functions as F

from culvert import cli
from culvert.functions.hydrology import atlas_to_idf
from culvert.operators.design import pipe_costs, review, size_network
from culvert.operators.network import analyze
from culvert.operators.validation import validate
from culvert.schema import IDF, Options, Params
from culvert.sinks import drawing, report
from culvert.sources import dxf, landxml, noaa, project, ssn, stm

SSN = """# demo
IDF 60 10 0.8
tailwater 100.5
MINTC 10
NODE N1 inlet 0 0 104 110 1 0.7 12
NODE N2 inlet 300 0 102.5 108.5 1 0.7   # ten minutes
NODE N3 junction 550 0 101.2 107 0.5 0.8 8
NODE OUT outfall 730 0 100 106
PIPE P1 N1 N2 300 1.25 0.013
PIPE P2 N2 N3 250 1.5 0.013
PIPE P3 N3 OUT 180 1.75 0.013
"""


def given(spark, *texts):
    return spark.createDataFrame([(k + 1, f"f{k + 1}.x", t) for k, t in enumerate(texts)], "network_id bigint, file string, text string")


def engine_flows(p):
    e = project.engine_tables(p)
    return {r.id: r.design_q for r in analyze(e.nodes, e.pipes, e.idf, Options(), e.scenarios).pipes.collect()}


def test_ssn(spark, tmp_path):
    (tmp_path / "a.ssn").write_text(SSN)
    n = ssn.read_ssn(spark, str(tmp_path))
    a = analyze(n.nodes, n.pipes, n.idf, scenarios=n.scenarios)
    assert n.errors.count() == 0 and a.pipes.filter("id = 'P3'").first().design_q == pytest.approx(8.4768, abs=1e-4)
    assert a.nodes.filter("id = 'N1'").first().hgl == pytest.approx(104.9572, abs=1e-3)
    texts = [t.first().text for t in cli.reports(n, size=True, check=True)]
    assert "All pipes flow open-channel" in texts[0] and "UPSIZE" in texts[1] and "0 error(s)" in texts[2]
    bad = ssn.parse_ssn(given(spark, "WHAT 1\nNODE A inlet 0 0 x 1 1 1\nPIPE P A\nNODE B lake 1 2 3 4\nIDF 1 2"))
    assert [r.error for r in bad.errors.orderBy("line_no").collect()] == [
        "line 1: unknown keyword WHAT", "line 2: x is not a number", "line 3: PIPE needs an id and two nodes", "line 4: unknown node kind lake", "line 5: missing value 3",
    ]


def test_projects(spark):
    p = project.demo(spark)
    assert p.errors.count() == 0 and engine_flows(p)["P3"] == pytest.approx(8.4768, abs=1e-4)
    assert p.settings.first().p2_rainfall_in == 3.0 and p.settings.first().units == "us_customary"
    again = project.parse_projects(drawing.project_texts(p))
    assert engine_flows(again) == engine_flows(p) and again.catchments.count() == 1
    area = p.catchments.first()
    assert (area.id, area.inlet, area.c, [tuple(v) for v in area.vertices]) == ("C1", "N1", 0.7, [(-40.0, 80.0), (40.0, 80.0), (0.0, 140.0)])
    blank = project.empty(spark, "New")
    assert validate(blank.settings, blank.nodes, blank.pipes).count() == 0 and blank.settings.first().name == "New"
    assert [(r.id, r.kind, r.x, r.y) for r in blank.nodes.collect()] == [("OUT", "outfall", 0.0, 0.0)]
    every = project.engine_tables(p, all_periods=True)
    assert {r.rp_years for r in every.idf.collect()} == {2, 5, 10, 25, 50, 100}
    assert project.parse_projects(given(spark, '{"name": "x"}')).errors.first().error.startswith("missing: idf_a")
    doc = json.loads(drawing.project_texts(p).first().text)
    for n in doc["nodes"]:
        n.update({k: n[k] * 0.3048 for k in ("x", "y", "invert", "rim")} | {"area_ac": n["area_ac"] * 0.404686})
    for q in doc["pipes"]:
        q.update({k: q[k] * 0.3048 for k in ("length", "diameter")})
    doc |= {"units": "si", "idf_a": 60 * 25.4, "tailwater": 100.5 * 0.3048}
    si = engine_flows(project.parse_projects(given(spark, json.dumps(doc))))
    assert si == {k: pytest.approx(v, rel=1e-6) for k, v in engine_flows(p).items()}


NOAA = """estimates
by duration for ARI (years):,1,2,10
5-min:,0.276,0.330,0.475
10-min:,0.404,0.483,0.696
60-min:,0.834,0.997,1.438
2-hr:,0.977,1.168,1.685
Upper bound
by duration for ARI (years):,1,2,10
5-min:,9,9,9
"""


def test_atlas(spark):
    depths, errors = noaa.parse_atlas14(given(spark, NOAA, "x", NOAA.replace("0.483", ""), NOAA[:100]))
    got = {(r.duration_min, r.rp_years): r.depth_in for r in depths.filter("network_id = 1").collect()}
    assert len(got) == 12 and got[120.0, 10] == 1.685 and got[5.0, 1] == 0.276
    assert {r.network_id: r.error for r in errors.collect()} == {2: "no header of return periods", 3: "a duration row has a missing or non-numeric depth", 4: "fewer than three duration rows"}
    curves = {r.rp_years: r for r in atlas_to_idf(depths).collect()}
    at = lambda r, t: r.a / (t + r.b) ** r.c
    assert set(curves) == {1, 2, 10} and at(curves[10], 15.0) == pytest.approx(0.862 * 4, rel=0.08)
    p = project.import_rainfall(project.demo(spark), atlas_to_idf(depths))
    assert p.settings.first().idf_a == pytest.approx(curves[10].a)


def stm_text():
    def block(no, down, dn, up, area, kind, inlet, inv, size, length, line="Cir"):
        fields = [("Line No. = ", no), ("Line ID = ", f'"L{no}"'), ("Downstream Line No. = ", down), ("X,Y Coord Dn = ", f"{dn[0]},{dn[1]}"), ("X,Y Coord Up = ", f"{up[0]},{up[1]}"), ("Drainage Area = ", area), ("Runoff Coeff. = ", 0.7), ("Inlet Time = ", 10), ("Line Length = ", length), ("Invert Elev Up = ", inv + 1), ("Invert Elev Dn = ", inv), ("Ground / Rim Elev Up = ", inv + 9), ("Ground / Rim Elev Dn = ", inv + 8), ("Rise = ", size), ("Span = ", 2 * size), ("N-Value = ", 0.013), ("Line Type = ", f'"{line}"'), ("Junction Type = ", kind), ("Inlet ID = ", f'"{inlet}"'), ("Inlet Length = ", 6), ("Gutter Slope = ", 0.005), ("Inlet Sag = ", 0)]
        return "\n".join(f'"{k}",{v}' for k, v in fields)

    rule = '\n"---------------------------------------"\n'
    head = '"Hydraflow Storm Sewers 2008"\n"Project Name = ","Try"\n"SI Units? ",#FALSE#\n"Minimum Tc used to calc Intensity",7\n"Min Slope = ",0.40\n"Return Period Index = ",5\n"LINE DATA ====="\n'
    lines = [block(1, 2, (100, 0), (0, 0), 2.5, 2, "CB 1", 101, 15, 100), block(2, 0, (200, 0), (100.1, 0.1), 0, 1, "", 100, 24, 0.2, "Box")]
    return head + rule.join(lines) + rule + '"IDF Curves"\n"a,b,c"\n0,80,0,90,96,105,112,120\n0,11,0,11,11,12,11,11\n0,0.85,0,0.85,0.85,0.85,0.85,0.85\n'


def test_stm(spark):
    p = stm.parse_stm(given(spark, stm_text(), "nothing", "Hydraflow Storm Sewers"))
    assert [(r.id, r.kind, r.area_ac) for r in p.nodes.orderBy("ord").collect()] == [("CB_1", "inlet", 2.5), ("N2", "junction", 0.0), ("N3", "outfall", 0.0)]
    assert [(r.id, r["from"], r.to, r.length, r.diameter, r.shape, r.rise, r.span) for r in p.pipes.orderBy("ord").collect()] == [("P1", "CB_1", "N2", 100.0, 1.25, "circular", 0.0, 0.0), ("P2", "N2", "N3", 1.0, 4.0, "box", 2.0, 4.0)]
    s = p.settings.first()
    assert (s.name, s.min_tc, s.min_slope, s.idf_a, s.idf_b, s.design_return_period_years) == ("Try", 7.0, pytest.approx(0.004), 105.0, 12.0, 25.0)
    assert {r.rp_years: r.a for r in p.idf.collect()} == {2: 80.0, 5: 90.0, 10: 96.0, 25: 105.0, 50: 112.0, 100: 120.0}
    assert {r.network_id: r.error for r in p.errors.collect()} == {2: "not a storm-sewer STM file", 3: "no LINE DATA section"}
    named = given(spark, 'IDF Curves\n#TRUE#,"a/base.dxf","base"\n0,1,200,300\n')
    assert tuple(stm.background(named).first())[1:] == ("a/base.dxf", 0.0, 1.0, 200.0, 300.0)


def test_landxml_round_trip(spark):
    nodes, pipes = frames(spark, *demo())
    texts = drawing.landxml_texts(spark.createDataFrame([(1, "A & B")], "network_id bigint, name string"), nodes, pipes)
    p = landxml.parse_landxml(texts.withColumn("file", F.lit("f")))
    assert p.settings.first().name == "A & B"
    assert [(r.id, r.kind, r.x, r.invert, r.rim) for r in p.nodes.orderBy("ord").collect()] == [("N1", "inlet", 0.0, 104.0, 110.0), ("N2", "inlet", 300.0, 102.5, 108.5), ("N3", "junction", 550.0, 101.2, 107.0), ("N4", "outfall", 730.0, 100.0, 106.0)]
    assert [(r.id, r["from"], r.to, r.length, r.diameter) for r in p.pipes.orderBy("ord").collect()] == [("P1", "N1", "N2", 300.0, 1.25), ("P2", "N2", "N3", 250.0, 1.5), ("P3", "N3", "N4", 180.0, 1.75)]
    metric = '<LandXML><Units><Metric linearUnit="meter" diameterUnit="millimeter"></Metric></Units><PipeNetworks><PipeNetwork name="e"><Structs/></PipeNetwork><PipeNetwork name="n"><Structs><Struct name="CB1"><Center>0 0 10</Center></Struct><Struct name="OF1"><Center>0 100</Center><Invert>5</Invert></Struct></Structs><Pipes><Pipe name="p"><StartStruct>CB1</StartStruct><EndStruct>OF1</EndStruct><CircPipe diameter="304.8"/></Pipe><Pipe name="q" refStart="CB1" refEnd="gone"/></Pipes></PipeNetwork></PipeNetworks></LandXML>'
    m = landxml.parse_landxml(given(spark, metric, "<LandXML></LandXML>"))
    row = m.pipes.collect()
    assert len(row) == 1 and row[0].diameter == pytest.approx(1.0) and row[0].length == pytest.approx(328.084, abs=1e-3)
    assert [(r.kind, round(r.invert, 3)) for r in m.nodes.orderBy("ord").collect()] == [("inlet", round(32.80839895 - 5, 3)), ("outfall", 16.404)]
    assert m.errors.count() == 1


def test_dxf_round_trip(spark):
    nodes, pipes = frames(spark, *demo())
    areas = spark.createDataFrame([(1, 1, "C1", [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)], 0.6, 0.02, 50.0, "N1")], "network_id bigint, ord int, id string, vertices array<struct<x:double,y:double>>, c double, slope double, flow_length_ft double, inlet string")
    texts = drawing.dxf_texts(nodes, pipes, areas).withColumn("file", F.lit("f"))
    p = dxf.parse_dxf(texts)
    assert (p.nodes.count(), p.pipes.count(), p.errors.count()) == (4, 3, 0)
    own = {r.id: r for r in p.nodes.collect()}
    assert (own["N1"].kind, own["N1"].tc_inlet, own["OUT"].kind) == ("inlet", 12.0, "outfall")
    assert [(r["from"], r.to, r.diameter) for r in p.pipes.orderBy("ord").collect()] == [("N1", "N2", 1.25), ("N2", "N3", 1.5), ("N3", "OUT", 1.75)]
    c = p.catchments.first()
    assert (c.c, c.slope, c.flow_length_ft, c.inlet, [tuple(v) for v in c.vertices]) == (0.6, 0.02, 50.0, "N1", [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)])
    circle = lambda x: f"0\nCIRCLE\n8\nSS_STRUCTURES\n10\n{x}\n20\n0\n40\n5\n"
    bare = dxf.parse_dxf(given(spark, circle(9) + circle(3) + circle(30), circle(0) + circle(100) + "0\nLINE\n8\nSS_PIPES\n10\n99\n20\n1\n11\n2\n21\n0\n", "0\nEOF\n"))
    assert [(r["from"], r.to, r.length) for r in bare.pipes.filter("network_id = 1").orderBy("ord").collect()] == [("N2", "N1", 6.0), ("N1", "N3", 21.0)]
    assert [(r["from"], r.to, r.diameter) for r in bare.pipes.filter("network_id = 2").collect()] == [("N2", "N1", 1.5)]
    assert [r.network_id for r in bare.errors.collect()] == [3]
    under = dxf.parse_underlay(given(spark, circle(0) + "0\nCIRCLE\n8\nX\n10\n0\n20\n0\n40\n2\n0\nLWPOLYLINE\n8\nY\n10\n0\n20\n0\n10\n1\n20\n0\n10\n1\n20\n1\n0\nLINE\n8\nZ\n10\n1\n20\n1\n11\n1\n21\n1\n"))
    assert under.count() == 24 + 3


def test_reports(spark, tmp_path):
    nodes, pipes = frames(spark, *demo())
    a = analyze(nodes, pipes, spark.createDataFrame([(1, 10, 60.0, 10.0, 0.8)], IDF), Options(tailwater=100.5))
    for name, columns in report.TEMPLATES.values():
        rows = report.report_rows(nodes, pipes, a.pipes, columns)
        assert rows.columns[3:] == columns and rows.count() == 3
        text = report.csv_reports(rows, name, columns).first().text.splitlines()
        assert text[0] == name and len(text) == 5 and "<table>" in report.html_tables(rows, name, columns).first().text
    rows = report.report_rows(nodes, pipes, a.pipes, report.TEMPLATES["municipal"][1])
    assert report.cells(rows, ["pipe_id", "design_q", "hgl_up"]).filter("pipe_id = 'P3'").first()[3:] == ("P3", "8.48", "102.23")
    page = report.html_reports(spark.createDataFrame([(1, "A<B")], "network_id bigint, name string"), rows, a.pipes, a.nodes).first().text
    assert "A&lt;B" in page and "0 surcharged reaches" in page and "1.49" in page
    assert "P2" in report.sizing_notes(size_network(pipes, a.pipes)).first().text
    assert "Total: $" in report.cost_texts(pipe_costs(pipes)).first().text
    assert report.review_texts(review(nodes, pipes, a.pipes, a.nodes)).first().text.startswith("=== DESIGN REVIEW")
    report.write_texts(report.text_reports(a.pipes, a.nodes), str(tmp_path / "out"))
    assert "P3" in spark.read.text(str(tmp_path / "out"), wholetext=True).first().value
    report.save_template(str(tmp_path / "t.json"), "T", ["pipe_id"])
    assert report.load_template(str(tmp_path / "t.json")) == ("T", ["pipe_id"])
    assert "min Tc 10" in Params().summary()


def test_profile(spark):
    nodes, pipes = frames(spark, *demo())
    a = analyze(nodes, pipes, spark.createDataFrame([(1, 10, 60.0, 10.0, 0.8)], IDF), Options(tailwater=100.5))
    got = drawing.profile_points(nodes, pipes, a.nodes.drop("rp_years")).filter("role = 'invert'").orderBy("pos").collect()
    assert [(r.id, r.station, r.py) for r in got] == [("N1", 0.0, pytest.approx(40)), ("N2", 300.0, pytest.approx(25)), ("N3", 550.0, pytest.approx(12)), ("OUT", 730.0, 0.0)]
    assert drawing.plan_lines(nodes, pipes).filter("id = 'P1'").first().label_x == 150.0 and drawing.bounds(nodes).first().max_x == 730.0
