"""Rainfall curves fitted by expressions against NumPy's least squares, one group at a time."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from culvert.functions import hydrology as hd

PYTHON = ("ArrowEvalPython", "BatchEvalPython", "InPandas", "InArrow")
SCHEMA = "k int, duration_min double, intensity double"


def fit_idf(duration_min, intensity) -> tuple[float, float, float]:
    """(a, b, c) by the same grid and halvings."""
    t, ln_i = np.asarray(duration_min, float), np.log(np.maximum(np.asarray(intensity, float), 1e-9))

    def fitted(b):
        x = np.log(t + b)
        if np.ptp(x) < 1e-9:
            return math.inf, 0.0, 0.0
        slope, cut = np.polyfit(x, ln_i, 1)
        return float(((ln_i - np.polyval((slope, cut), x)) ** 2).sum()), math.exp(cut), -slope

    best = min((k * 0.25 for k in range(0 if t.min() > 0 else 1, 161)), key=lambda b: fitted(b)[0])
    lo, hi = max(0.0, best - 0.25), best + 0.25
    for _ in range(40):
        mid = 0.5 * (lo + hi)
        if fitted(0.5 * (lo + mid))[0] < fitted(0.5 * (mid + hi))[0]:
            hi = mid
        else:
            lo = mid
    b = 0.5 * (lo + hi)
    _, a, c = fitted(b)
    return a, b, c


def fitted(spark, rows):
    out = hd.fit_idf_curves(spark.createDataFrame(rows, SCHEMA), ["k"])
    assert not any(p in out._jdf.queryExecution().executedPlan().toString() for p in PYTHON)
    return {r.k: (r.a, r.b, r.c) for r in out.collect()}


def test_fits_equal_least_squares(spark):
    r = random.Random(1)
    rows = []
    for k in range(40):
        a, b, c = r.uniform(5, 120), r.uniform(0, 39), r.uniform(0.4, 1.1)
        durations = [5.0, 10.0, 15.0, 30.0, 60.0, 120.0, 180.0] if k % 3 else [0.0, 7.5, 20.0, 90.0]
        rows += [(k, t, a / (t + max(b, 0.5)) ** c * (1 + r.uniform(-0.03, 0.03) * (k % 2))) for t in durations]
        rows += rows[-2:] * (k % 4)  # repeated points weigh more
    got = fitted(spark, rows)
    for k in range(40):
        own = [x for x in rows if x[0] == k]
        for g, w in zip(got[k], fit_idf([x[1] for x in own], [x[2] for x in own]), strict=True):
            assert g == pytest.approx(w, rel=1e-4, abs=1e-4), k


def test_odd_groups(spark):
    nan = math.nan
    rows = [(1, 5.0, 3.0), (1, 10.0, 2.0)]  # two points
    rows += [(2, 10.0, 3.0)] * 4  # one duration
    rows += [(3, 5.0, 0.0), (3, 10.0, -1.0), (3, 20.0, 0.0)]  # no rain
    rows += [(4, 5.0, 6.0), (4, 10.0, 4.0), (4, None, 1.0), (4, -5.0, 1.0), (4, 30.0, None), (4, 20.0, nan)]  # two points that count
    rows += [(None, 5.0, 6.0), (None, 10.0, 4.0), (None, 60.0, 1.0)]
    got = fitted(spark, rows)
    assert set(got) == {2, 3, None}
    assert got[2][0] == 0.0 and got[2][2] == 0.0
    assert got[3][0] == pytest.approx(1e-9) and got[3][2] == pytest.approx(0.0, abs=1e-9)
    assert fitted(spark, []) == {}


def test_a_hot_group_is_summed_by_duration(spark):
    """200,000 rows of one group are eight points."""
    many = spark.range(200_000).select(F.lit(1).alias("k"), (F.col("id") % 8 * 20.0 + 5.0).alias("duration_min")).withColumn("intensity", 60.0 / F.pow(F.col("duration_min") + 10.0, F.lit(0.8)))
    row = hd.fit_idf_curves(many, ["k"]).first()
    assert (row.a, row.b, row.c) == (pytest.approx(60.0, rel=1e-4), pytest.approx(10.0, abs=1e-3), pytest.approx(0.8, abs=1e-4))
