"""Cases that only larger tables show."""

import numpy as np
import pytest

import __spark_entry__  # noqa: F401 (fills QUERIES)

from culvert.functions import solvers
from culvert.operators import editing, graph, network
from culvert.plans.catalog import QUERIES
from culvert.sources import stm
from test_files import given, stm_text


def test_backwater_takes_the_root_that_halving_finds():
    """Two feet of pipe, nearly full: its last steps have three roots below and above the crown."""
    one = lambda x: np.array([x])
    pipe = solvers.Sections(np.zeros(1, int), one(2.0), one(2.0))
    up = solvers.backwater(pipe, one(0.013), one(17.992586661611), one(112.24), one(115.04), one(400.0), one(114.47693701123038), one(1.527863350569457), one(1.5531433210968972))
    assert up[0] - 115.04 == pytest.approx(1.897853086568, abs=1e-9)


@pytest.fixture
def limited(spark):
    """(nodes, pipes) of a tree of 40 nodes, in a session that allows a recursion 50 rows."""
    nodes = spark.range(40).selectExpr("1L AS network_id", "id AS ord", "CAST(id AS STRING) AS id", "IF(id = 0, 'outfall', 'inlet') AS kind", "2.0D AS area_ac", "0.5D AS c")
    pipes = spark.range(1, 40).selectExpr("1L AS network_id", "concat('P', id) AS id", "CAST(id AS STRING) AS `from`", "CAST(id DIV 2 AS STRING) AS `to`")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "50")
    yield nodes, pipes
    spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_recursive_areas_pass_the_row_limit(limited):
    assert {r.id: r.total_ca for r in graph.accumulate_ca_recursive(*limited).collect()}["0"] == 40.0


def test_recursive_main_stem_passes_the_row_limit(limited):
    assert sorted(graph.main_stem_recursive(*limited).collect()) == sorted(graph.main_stem(*limited).collect())


def test_recursive_levels_pass_the_row_limit(limited):
    assert {r.id: r.level for r in graph.levels_recursive(*limited).collect()}["0"] == 6


def test_all_periods_join_nothing(spark, capsys):
    nodes = spark.createDataFrame([(1, 1, "A", "inlet", 101.0, 108.0, 1.0, 0.9, 10.0, 0.0, 0.0), (1, 2, "O", "outfall", 100.0, 107.0, 0.0, 0.0, 0.0, 100.0, 0.0)], "network_id bigint, ord int, id string, kind string, invert double, rim double, area_ac double, c double, tc_inlet double, x double, y double")
    pipes = spark.createDataFrame([(1, 1, "P", "A", "O", 100.0, 2.0, 0.013)], "network_id bigint, ord int, id string, `from` string, `to` string, length double, diameter double, n double")
    idf = spark.createDataFrame([(1, 10, 60.0, 10.0, 0.8), (1, 100, 60.0, 10.0, 0.8)], "network_id bigint, rp_years int, a double, b double, c double")
    found = network.analyze_all_periods(nodes, pipes, idf).pipes
    found.explain()
    assert "Join" not in capsys.readouterr().out
    assert {r.rp_years: r.total_ca for r in found.collect()} == {10: 0.9, 100: 1.0}


def test_a_point_on_a_side_lies_in_no_catchment_without_sides(spark):
    points = spark.createDataFrame([(1, 1, 82.354, 2.0), (1, 2, 82.36, 2.0), (1, 3, 86.854, 0.0)], "network_id bigint, point int, x double, y double")
    corners = [(83.854 - 3.0, 0.0), (83.854, 4.0), (83.854 + 6.0, 0.0), (83.854, -4.0)]
    kite = spark.createDataFrame([(1, 1, "K", corners)], "network_id bigint, ord int, id string, vertices array<struct<x:double,y:double>>")
    assert {r.point for r in editing.containing_catchment(points, kite).collect()} == {1, 2, 3}
    assert {r.point for r in editing.containing_catchment(points, kite, sides=False).collect()} == {2, 3}


def test_pipes_of_stm_files_join_nothing_and_lines_are_parsed_once(spark, capsys):
    found, parsed = given(spark, stm_text()), []
    plain = stm.parse_stm(found)
    plain.pipes.explain()
    assert "Join" not in capsys.readouterr().out
    again = stm.parse_stm(found, lambda df: parsed.append(df) or df.cache())
    assert len(parsed) == 2
    for name in ("nodes", "pipes", "settings"):
        assert sorted(map(str, getattr(again, name).collect())) == sorted(map(str, getattr(plain, name).collect()))


def test_texts_that_are_read_back_are_made_once(spark, capsys):
    QUERIES["ssn_read_back"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "FileScan" in plan and "l_orderkey" not in plan
