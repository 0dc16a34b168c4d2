"""Depths found by Catalyst expressions against the array solvers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from culvert.functions import hydraulics as hy
from culvert.functions import registry, solvers

PYTHON = ("ArrowEvalPython", "BatchEvalPython", "InPandas", "InArrow")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cases(seed=11, n=4000):
    r = random.Random(seed)
    rows = [(i, math.exp(r.uniform(-6, 5)), r.choice([0.009, 0.013, 0.024]), math.exp(r.uniform(-8, -2)), r.choice([0.5, 1.0, 1.5, 4.0, 12.0]), r.uniform(0.5, 9.0)) for i in range(n)]
    rows += [(n, 0.0, 0.013, 0.01, 1.0, 1.0), (n + 1, -2.0, 0.013, 0.01, 1.0, 1.0), (n + 2, 1.0, 0.0, 0.01, 1.0, 1.0), (n + 3, 1.0, 0.013, 0.0, 1.0, 1.0), (n + 4, 1.0, 0.013, -0.01, 1.0, 1.0)]
    return rows


@pytest.mark.parametrize("shape", ["circular", "rectangular"])
def test_named_shapes_equal_the_array_solver_without_python(spark, shape):
    rows = cases()
    df = spark.createDataFrame(rows, "i int, q double, n double, s double, d double, w double")
    span = "w" if shape == "rectangular" else None
    found = df.select("i", hy.normal_depth("q", "n", "s", "d", shape, span).alias("yn"), hy.critical_depth("q", "d", shape, span).alias("yc"))
    assert not any(p in plan(found) for p in PYTHON)
    got = sorted(tuple(r) for r in found.collect())
    _, q, n, s, d, w = (np.array(c) for c in zip(*rows, strict=True))
    kind = solvers.SHAPES.get(shape, solvers.CIRCULAR)
    sections = solvers.Sections(np.full(len(q), kind), d, w if span else d)
    yn, yc = solvers.normal_depth(q, n, s, sections), solvers.critical_depth(q, sections)
    for (i, a, b), y, c in zip(got, yn, yc, strict=True):
        assert (a is None) == bool(np.isnan(y)), rows[i]
        assert a is None or a == pytest.approx(y, abs=1e-9), rows[i]
        assert b == pytest.approx(c, abs=1e-9), rows[i]


def test_missing_arguments_give_null(spark):
    df = spark.createDataFrame([(None, 0.013, 0.01, 1.0), (1.0, None, 0.01, 1.0), (1.0, 0.013, None, 1.0), (1.0, 0.013, 0.01, None)], "q double, n double, s double, d double")
    assert [r[0] for r in df.select(hy.normal_depth("q", "n", "s", "d")).collect()] == [None] * 4
    assert [r[0] is None for r in df.select(hy.critical_depth("q", "d")).collect()] == [True, False, False, True]


def test_sql_functions_equal_the_columns_without_python(spark):
    registry.register(spark)
    spark.createDataFrame(cases(5, 500), "i int, q double, n double, s double, d double, w double").createOrReplaceTempView("depth_cases")
    both = spark.sql("SELECT *, normal_depth_circular(q, n, s, d) AS yn, critical_depth_circular(q, d) AS yc FROM depth_cases")
    assert not any(p in plan(both) for p in PYTHON)
    apart = both.select(F.nvl(F.abs(F.nanvl("yn", F.lit(None)) - hy.normal_depth("q", "n", "s", "d")), F.lit(0.0)).alias("a"), F.abs(F.col("yc") - hy.critical_depth("q", "d")).alias("b"), (F.isnan("yn") == hy.normal_depth("q", "n", "s", "d").isNull()).alias("same"))
    assert tuple(apart.agg(F.max("a") < 1e-9, F.max("b") < 1e-9, F.min("same")).first()) == (True, True, True)
