import pytest
from nets import demo, frames, node, one, pipe, two
from pyspark.sql import functions as F

from culvert.operators import design, editing, graph, validation
from culvert.operators.network import CyclicNetwork, UnknownNode, analyze, analyze_all_periods, analyze_rational, check, peak_flow_pivot, with_hydraulics
from culvert.schema import CATCHMENTS, IDF, DesignCriteria, Options, ReviewCriteria


def solve(spark, net, intensity=None, **options):
    nodes, pipes = frames(spark, *net)
    if intensity is not None:
        a = analyze_rational(nodes, pipes, intensity, Options(**options))
    else:
        a = analyze(nodes, pipes, spark.createDataFrame([(1, 10, 60.0, 10.0, 0.8)], IDF), Options(**options))
    solved = a.solved.cache()
    got = {r.id: r for r in solved.filter("kind = 'pipe'").collect()}, {r.id: r for r in solved.filter("kind = 'node'").collect()}
    solved.unpersist()
    return got


def test_demo(spark):
    pipes, nodes = solve(spark, demo(), tailwater=100.5)
    assert [pipes[p].design_q for p in ("P1", "P2", "P3")] == [pytest.approx(x, abs=1e-4) for x in (3.5425, 6.7872, 8.4768)]
    assert [nodes[n].hgl for n in ("N1", "N2", "N3", "OUT")] == [pytest.approx(x, abs=1e-3) for x in (104.9572, 103.7893, 102.2313, 100.5)]
    assert [nodes[n].tc for n in ("N1", "N2", "N3", "OUT")] == [pytest.approx(x, abs=1e-3) for x in (12, 13.2134, 14.0709, 14.5927)]
    assert not any(p.surcharged for p in pipes.values())


def test_two_inlets_and_worked_example(spark):
    pipes, _ = solve(spark, two((100, 99, 98), (105, 104, 103), ((2, 0.7), (3, 0.8)), (100, 100), (1.5, 1.5)), 4.0)
    assert (pipes["P1"].total_ca, pipes["P2"].total_ca) == (pytest.approx(1.4), pytest.approx(3.8))
    assert (pipes["P1"].design_q, pipes["P2"].design_q) == (pytest.approx(5.6), pytest.approx(15.2))
    assert pipes["P2"].surcharged and not pipes["P1"].surcharged
    pipes, _ = solve(spark, two((100, 98, 97.4), (110, 108, 106), ((4, 0.6), (3, 0.7)), (200, 200), (2, 2)), 5.0)
    assert [round(pipes[p].capacity, 2) for p in ("P1", "P2")] == [22.68, 12.42]
    assert [round(pipes[p].velocity_full, 2) for p in ("P1", "P2")] == [7.22, 3.95]
    assert pipes["P1"].pct_full == pytest.approx(0.529, abs=1e-3) and pipes["P2"].surcharged


def test_grade_lines(spark):
    single = one(100, 108, 96, 106, 300, 1.5, 5, 0.8)
    pipes, nodes = solve(spark, single, 5.0, tailwater=100.0)
    assert pipes["P1"].hgl_up == pytest.approx(111.81, abs=0.05) and nodes["N1"].surcharge_to_surface
    pipes, _ = solve(spark, single, 5.0, tailwater=100.0, hec22=True)
    v = 20 / (3.141592653589793 * 1.5**2 / 4)
    assert pipes["P1"].hgl_up == pytest.approx(110.817 + 0.1 * 4 / 1.5 * v * v / 64.4, abs=0.03)
    series = two((98, 97, 96), (115, 108, 110), ((4, 0.9), (0, 0)), (200, 200), (1.5, 1.5), kinds=("inlet", "junction"))
    pipes, nodes = solve(spark, series, 5.0, tailwater=100.0)
    assert (nodes["N2"].hgl, nodes["N1"].hgl) == (pytest.approx(106.65, abs=0.03), pytest.approx(113.29, abs=0.03))
    m1, _ = solve(spark, one(96.6, 110, 96, 110, 300, 1.5, 2, 0.5), 3.0, tailwater=97.2, junction_k=0.0)
    assert 96.6 + m1["P1"].normal_depth - 0.05 < m1["P1"].hgl_up < 97.78


def test_steep_reach_and_drowning(spark):
    steep = one(105, 120, 100, 120, 100, 1.5, 1, 0.6)
    up = [solve(spark, steep, 2.0, tailwater=t)[0]["P1"].hgl_up for t in (100.0, 101.0, 103.0)]
    assert up[0] == up[1] and up[2] > up[1] + 0.5


def test_bends(spark):
    at = lambda places: two((98, 97, 96), (120, 118, 116), ((4, 0.9), (0, 0)), (200, 200), (1.5, 1.5), kinds=("inlet", "junction"), places=places)
    corner, line = at(((0, 100), (0, 0), (100, 0))), at(((0, 0), (100, 0), (200, 0)))
    hgl = lambda net, k: solve(spark, net, 5.0, tailwater=100.0, bend_loss_coeff=k)[1]["N1"].hgl
    assert hgl(corner, 1.0) - hgl(corner, 0.0) == pytest.approx(0.8055, abs=0.01)
    assert hgl(line, 1.0) == pytest.approx(hgl(line, 0.0), abs=1e-9)


def test_adverse_flat_zero_and_cf(spark):
    pipes, _ = solve(spark, one(100, 106, 102, 106, 100, 1.5, 1, 0.7))
    assert pipes["P1"].hgl_up is None and pipes["P1"].hgl_dn is not None and pipes["P1"].surcharged
    pipes, _ = solve(spark, one(100, 105, 100, 105, 100, 1.5, 1, 0.7), 4.0)
    assert pipes["P1"].slope == 0 and pipes["P1"].manning_slope == 0.001 and pipes["P1"].capacity > 0
    pipes, _ = solve(spark, one(100, 108, 99, 107, 100, 1.5, 0, 0))
    assert pipes["P1"].design_q == 0 and not pipes["P1"].surcharged
    q = [solve(spark, one(101, 108, 100, 106, 100, 2, 4, 0.6), 4.0, cf=cf)[0]["P1"].design_q for cf in (1.0, 1.25)]
    assert q[1] / q[0] == pytest.approx(1.25)
    q = [solve(spark, one(100, 112, 99, 110, 100, d, 6, 0.9, shape=s, rise=r, span=w), 5.0)[0]["P1"].capacity for s, r, w, d in (("elliptical", 2.0, 2.0, 2.0), (None, None, None, 2.0))]
    assert q[0] == pytest.approx(q[1], abs=0.02)


def test_errors_stay_in_their_network(spark):
    good, bad, ghost = demo(1), ([node(2, 1, "A", "inlet", 1, 2), node(2, 2, "B", "inlet", 1, 2)], [pipe(2, 1, "x", "A", "B", 9, 1), pipe(2, 2, "y", "B", "A", 9, 1)]), ([node(3, 1, "OUT", "outfall", 1, 2)], [pipe(3, 1, "P", "GHOST", "OUT", 9, 1)])
    lonely = ([node(4, 1, "LONELY", "inlet", 5, 9, 1, 0.5), *one(101, 108, 100, 106, 100, 2, 4, 0.6, network=4)[0]], one(101, 108, 100, 106, 100, 2, 4, 0.6, network=4)[1])
    nodes, pipes = frames(spark, *[sum((list(x[k]) for x in (good, bad, ghost, lonely)), []) for k in (0, 1)])
    idf = spark.createDataFrame([(k, 10, 60.0, 10.0, 0.8) for k in (1, 2, 3, 4)], IDF)
    a = analyze(nodes, pipes, idf)
    assert {r.network_id: r.error for r in a.errors.collect()} == {2: "cycle", 3: "pipe P references an unknown node"}
    assert {r.network_id: r["count"] for r in a.pipes.groupBy("network_id").count().collect()} == {1: 3, 4: 1}
    assert a.nodes.filter("id = 'LONELY'").first().hgl == 5.0
    with pytest.raises(CyclicNetwork):
        check(analyze(nodes.filter("network_id = 2"), pipes.filter("network_id = 2"), idf))
    with pytest.raises(UnknownNode):
        check(analyze(nodes.filter("network_id = 3"), pipes.filter("network_id = 3"), idf))


def test_many_networks_in_small_chunks(spark, monkeypatch):
    nets = [demo(k) for k in range(1, 60)]
    nodes, pipes = frames(spark, sum((n for n, _ in nets), []), sum((p for _, p in nets), []))
    nodes, pipes = nodes.orderBy(F.rand(1)), pipes.orderBy(F.rand(2))  # the order of rows doesn't matter
    idf = spark.createDataFrame([(k, rp, 60.0, 10.0, 0.8) for k in range(1, 60) for rp in (10, 25)], IDF)
    a = analyze_all_periods(nodes, pipes, idf)
    got = {(r.network_id, r.rp_years, r.id): round(r.design_q, 6) for r in a.pipes.collect()}
    assert len(got) == 59 * 2 * 3
    assert all(got[k, 10, "P3"] == got[1, 10, "P3"] for k in range(1, 60)) and got[1, 25, "P1"] == pytest.approx(1.1 * got[1, 10, "P1"], rel=1e-6)
    pivot = peak_flow_pivot(a.pipes).filter("network_id = 7 and id = 'P3'").first()
    assert round(pivot["10"], 6) == got[7, 10, "P3"] and pivot.asDict().keys() >= {"10", "25"}


def test_design(spark):
    nodes, pipes = frames(spark, *demo())
    a = analyze(nodes, pipes, spark.createDataFrame([(1, 10, 60.0, 10.0, 0.8)], IDF), Options(tailwater=100.5))
    sizes = design.size_network(pipes, a.pipes).collect()
    got = {r.id: r for r in sizes}
    assert got["P2"].outcome == "sized" and got["P2"].recommended_diameter == 1.75 and got["P1"].outcome == "adequate"
    bigger = design.apply_sizing(pipes, design.size_network(pipes, a.pipes))
    assert {r.id: r.diameter for r in bigger.collect()}["P2"] == 1.75
    found = design.review(nodes, pipes, a.pipes, a.nodes)
    assert ("pct_full", "P2") in {(r.rule, r.id) for r in found.collect()} and found.filter("severity = 'error'").count() == 0
    tight = design.review(nodes, pipes, a.pipes, a.nodes, ReviewCriteria(min_cover_ft=9.0, min_freeboard_ft=9.0))
    assert {r.rule for r in tight.collect()} >= {"cover", "freeboard"}
    none = design.size_pipes(spark.createDataFrame([(9999.0, 0.001, 0.013, 1.0), (0.5, 0.0004, 0.013, 0.5)], "design_q double, slope double, n double, diameter double")).collect()
    assert [r.outcome for r in none] == ["no_solution", "sized"] and none[0].recommended_diameter == 6.0
    assert design.size_pipes(a.pipes.join(pipes.select("id", "diameter", "n"), "id"), DesignCriteria.lateral()).filter("id = 'P2'").first().outcome == "adequate"
    unit = {d: spark.range(1).select(design.cost_per_foot(F.lit(d / 12)).alias("v")).first().v for d in (6, 12, 63, 90)}
    assert unit[6] == unit[12] == 85 and 460 < unit[63] < 540 and unit[90] == 625
    assert design.network_costs(pipes).first().n_pipes == 3
    assert {r.regime for r in with_hydraulics(a).collect()} == {"subcritical", "supercritical"}


def test_validation(spark):
    nodes, pipes = frames(spark, [node(1, 1, "A", "inlet", 5, 9), node(1, 2, "A", "inlet", 5, 9), node(1, 3, "B", "junction", 4, 9), node(1, 4, "O", "outfall", 1, 5), node(1, 5, "Q", "outfall", 1, 5), node(1, 6, "L", "junction", 4, 9)], [pipe(1, 1, "p", "A", "O", 9, 1), pipe(1, 2, "q", "A", "O", 9, 1), pipe(1, 3, "r", "B", "Z", 9, 1)])
    networks = spark.createDataFrame([(1,), (2,)], "network_id bigint")
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0)]
    catchments = spark.createDataFrame([(1, 1, "c1", square, 0.5, 0.01, 9.0, None), (1, 2, "c2", square[:2], 0.5, 0.01, 9.0, "X")], CATCHMENTS)
    got = {(r.network_id, r.rule, r.id) for r in validation.diagnose(networks, nodes, pipes, catchments).collect()}
    assert got == {
        (2, "no_nodes", "network"), (2, "no_outfall", "network"), (1, "duplicate_id", "A"), (1, "dangling_to", "r"), (1, "orphan", "L"), (1, "duplicate_pipe", "q"), (1, "no_area", "A"),
        (1, "many_outfalls", "network"), (1, "unreachable", "B"), (1, "unreachable", "L"), (1, "unlinked", "c1"), (1, "missing_inlet", "c2"), (1, "few_vertices", "c2"),
    }


def test_graph(spark):
    nodes, pipes = frames(spark, [node(1, 1, "A", "inlet", 5, 9, 1, 0.5), node(1, 2, "B", "inlet", 5, 9, 2, 0.5), node(1, 3, "J", "junction", 4, 9), node(1, 4, "O", "outfall", 1, 5)], [pipe(1, 1, "p", "A", "J", 9, 1), pipe(1, 2, "q", "B", "J", 9, 1), pipe(1, 3, "r", "J", "O", 9, 1), pipe(1, 4, "s", "J", "O", 9, 1)])
    assert {r.id: r.total_ca for r in graph.accumulate_ca(nodes, pipes).collect()} == {"A": 0.5, "B": 1.0, "J": 1.5, "O": 3.0}
    assert {r.id: r.level for r in graph.levels(nodes, pipes).collect()} == {"A": 0, "B": 0, "J": 1, "O": 2}
    assert [r.id for r in graph.main_stem(nodes, pipes).orderBy("pos").collect()] == ["B", "J", "O"]
    loop = pipes.unionByName(spark.createDataFrame([pipe(1, 5, "t", "O", "A", 9, 1)], pipes.schema))
    assert {r.id: r.level for r in graph.levels(nodes, loop).collect()} == {"B": 0, "A": None, "J": None, "O": None}
    assert graph.reaches_outfall(nodes, loop).count() == 4


def test_editing(spark):
    nodes, pipes = frames(spark, *demo())
    nodes2 = editing.place_structure(nodes, 1, "inlet", 10.0, 20.0)
    assert nodes2.filter("id = 'N4'").first().invert == 100.0
    assert editing.place_pipe(nodes2, pipes, 1, "N4", "N1").filter("id = 'P4'").first().length == pytest.approx(500**0.5)
    for a, b in (("N1", "N1"), ("N1", "N2"), ("N1", "nope")):
        with pytest.raises(ValueError):
            editing.place_pipe(nodes, pipes, 1, a, b)
    n3, p3 = editing.split_pipe(nodes, pipes, 1, "P1", 100.0, 5.0)
    assert (n3.count(), p3.count()) == (5, 4) and n3.filter("id = 'N4'").first().invert == pytest.approx(103.5)
    assert {r.id: (r["from"], r.to, r.length) for r in p3.collect()}["P4"] == ("N4", "N2", 200.0)
    assert editing.reverse_pipe(pipes, 1, "P1").filter("id = 'P1'").first()["from"] == "N2"
    n4, p4, _ = editing.merge_node(nodes, pipes, None, 1, "N2", "N3")
    assert n4.count() == 3 and {(r["from"], r.to) for r in p4.collect()} == {("N1", "N3"), ("N3", "OUT")}
    n5, p5 = editing.delete_node(nodes, pipes, 1, "N2")
    assert (n5.count(), p5.count()) == (3, 1)
    _, moved = editing.move_node(nodes, pipes, 1, "N1", 0.0, 400.0)
    assert moved.filter("id = 'P1'").first().length == 500.0
    assert editing.duplicate_node(nodes, 1, "N1").filter("id = 'N4'").first().x == 20.0
    assert editing.delete_pipe(pipes, 1, "P1").count() == 2 and editing.set_tc(nodes, 1, "N1", 5.0).first().tc_inlet == 5.0
    assert {r.diameter for r in editing.set_diameter(pipes, 3.0).collect()} == {3.0} and {r.n for r in editing.set_roughness(pipes, 0.02).collect()} == {0.02}


def test_catchments(spark):
    nodes, _ = frames(spark, [node(1, 1, "N1", "inlet", 5, 9, 1, 0.8, 5, 0, 0), node(1, 2, "N2", "inlet", 5, 9, 1, 0.8, 5, 500, 0)], [])
    side = 43560.0**0.5
    square = [(0.0, 0.0), (side, 0.0), (side, side), (0.0, side)]
    c = spark.createDataFrame([(1, 1, "C1", square, 0.5, 0.01, 500.0, "N1"), (1, 2, "C2", square, 0.5, 0.01, 1.0, None)], CATCHMENTS)
    merged = {r.id: r for r in editing.merge_catchments(nodes, c).collect()}
    assert (merged["N1"].area_ac, merged["N1"].c) == (pytest.approx(2.0), pytest.approx(0.65)) and merged["N1"].tc_inlet == pytest.approx(5.5, abs=0.02) and merged["N2"].c == 0.8
    linked = {r.id: r.inlet for r in editing.link_catchments(c, nodes).collect()}
    assert linked == {"C1": "N1", "C2": "N1"}
    assert {r.id: r.flow_length_ft for r in editing.flow_lengths(c, nodes).collect()}["C1"] == pytest.approx(side / 2**0.5)
    points = spark.createDataFrame([(1, 1, 10.0, 10.0)], "network_id bigint, point int, x double, y double")
    assert editing.containing_catchment(points, c).first().id == "C2"
    assert editing.relink_catchment(c, nodes, 1, 2, "N2").filter("id = 'C2'").first().inlet == "N2" and editing.delete_catchment(c, 1, 1).count() == 1
    with pytest.raises(ValueError):
        editing.relink_catchment(c, nodes, 1, 2, "nope")


def test_flows_of_own_curves(spark):
    """Each network's flows are by its own curve."""
    from culvert.plans import catalog

    reaches = spark.createDataFrame([(1, "P1", 12.0, 2.0), (2, "P1", 12.0, 2.0)], "network_id bigint, id string, tc_inlet double, ca double")
    curves = spark.createDataFrame([(1, 10, 60.0, 10.0, 0.8), (2, 10, 90.0, 10.0, 0.8)], "network_id bigint, rp_years int, a double, b double, c double")
    got = {(r.network_id, r.rp_years): r.design_q for r in catalog.flows_of_curves(reaches, curves).collect()}
    assert len(got) == 12
    assert all(abs(got[2, p] - 1.5 * got[1, p]) < 1e-9 for p in (2, 5, 10, 25, 50, 100))
    assert abs(got[1, 10] - 2 * 60 / 22**0.8) < 1e-6
