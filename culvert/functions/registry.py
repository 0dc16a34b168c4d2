"""SQL functions of the engine's scalar surface, for spark.sql."""

from __future__ import annotations

from pyspark.sql import SparkSession

from culvert.functions import solvers
from culvert.schema import G_US, K_US

#: Circles of diameter d at depth y: the angle, and what follows from it.
_ANGLE = "(CASE WHEN d > 0 THEN 2D * acos(greatest(-1D, least(1D, 1D - 2D * {y} / d))) ELSE 0D END)"
_AREA = "(d * d / 8D * ({t} - sin({t})))"


def _at(y: str, form: str) -> str:
    """A form in {a} (area) and {t} (angle) at a depth."""
    t = _ANGLE.format(y=y)
    return form.format(a=_AREA.format(t=t), t=t)


def _halved(lo: str, hi: str, goes_up: str) -> str:
    """The middle of a bracket halved until narrower than the tolerance; goes_up is at depth {y}."""
    mid = "(0.5D * (acc.lo + acc.hi))"
    steps = f"least(200, greatest(1, CAST(floor(log2(({hi} - {lo}) / {solvers.TOLERANCE}D)) + 1 AS INT)))"
    step = f"CASE WHEN {goes_up.format(y=mid)} THEN named_struct('lo', {mid}, 'hi', acc.hi) ELSE named_struct('lo', acc.lo, 'hi', {mid}) END"
    return f"aggregate(sequence(1, {steps}), named_struct('lo', {lo}, 'hi', {hi}), (acc, i) -> {step}, acc -> 0.5D * (acc.lo + acc.hi))"


_DEEPEST = f"(d * {solvers.CIRCLE_PEAK}D / {solvers.GRID}D)"
_MANNING = f"{K_US}D / n * {{a}} * power({{a}} / (d * {{t}} / 2D), 2D / 3D) * sqrt(greatest(s, 0D))"
_Q_MAX = f"CASE WHEN n > 0 AND d > 0 THEN {_at(_DEEPEST, _MANNING)} ELSE 0D END"
_FLOWS_MORE = f"power({_at('{y}', '{a}')}, 5D) <= power(q * n / ({K_US}D * sqrt(s)), 3D) * power({_at('{y}', 'd * {t} / 2D')}, 2D)"
_BELOW_CRITICAL = f"q * q / {G_US}D * {_at('{y}', 'd * sin({t} / 2D)')} > power({_at('{y}', '{a}')}, 3D)"

#: name: (parameters, expression); expressions inline into the caller's plan.
EXPRESSIONS = {
    "rational_peak": ("c DOUBLE, i DOUBLE, a DOUBLE", "c * i * a"),
    "manning_full_flow_circular": ("n DOUBLE, s DOUBLE, d DOUBLE", f"CASE WHEN n > 0 THEN {K_US}D / n * (pi() * d * d / 4D) * power(d / 4D, 2D / 3D) * sqrt(greatest(s, 0D)) ELSE 0D END"),
    "normal_depth_circular": (
        "q DOUBLE, n DOUBLE, s DOUBLE, d DOUBLE",
        f"CASE WHEN q IS NULL OR n IS NULL OR s IS NULL OR d IS NULL THEN NULL WHEN q <= 0 THEN 0D WHEN q > {_Q_MAX} THEN double('NaN') ELSE {_halved('0D', _DEEPEST, _FLOWS_MORE)} END",
    ),
    "critical_depth_circular": ("q DOUBLE, d DOUBLE", f"CASE WHEN q IS NULL OR d IS NULL THEN NULL WHEN q <= 0 THEN 0D ELSE {_halved('(1e-6D * d)', '(0.999D * d)', _BELOW_CRITICAL)} END"),
    "kirpich_tc": ("l DOUBLE, s DOUBLE", "CASE WHEN l > 0 AND s > 0 THEN 0.0078D * power(l, 0.77D) * power(s, -0.385D) ELSE 0D END"),
    "tr55_sheet_flow": ("l DOUBLE, s DOUBLE, n DOUBLE, p2 DOUBLE", "CASE WHEN l > 0 AND s > 0 AND n > 0 AND p2 > 0 THEN 0.42D * power(n * l, 0.8D) / (sqrt(p2) * power(s, 0.4D)) ELSE 0D END"),
}


def register(spark: SparkSession) -> list[str]:
    """Adds the functions as temporary SQL functions; returns their names.

    All are SQL functions, so Catalyst sees through them and no Python worker runs; depths are halved
    brackets, NaN beyond the largest open-channel flow.
    analyze_ssn is a table function over a table of texts: see functions.tables.
    """
    for name, (parameters, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS DOUBLE RETURN {body}")
    from culvert.functions.tables import register_tables

    register_tables(spark)
    return [*EXPRESSIONS, "analyze_ssn"]
