"""Rainfall intensity and times of concentration as Column expressions (minutes, in/hr)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.functions.hydraulics import col, positive
from culvert.schema import K_US, SYNTHETIC_FACTORS


def idf_intensity(t, a, b, c) -> Column:
    """a / (t + b)^c; a negative time counts as 0."""
    return col(a) / F.pow(F.greatest(col(t), F.lit(0.0)) + col(b), col(c))


def kirpich_minutes(length, slope) -> Column:
    length, slope = col(length), col(slope)
    return positive((length > 0) & (slope > 0), 0.0078 * F.pow(length, F.lit(0.77)) * F.pow(slope, F.lit(-0.385)))


def sheet_flow_minutes(length, slope, n, p2) -> Column:
    """TR-55 sheet flow."""
    length, slope, n, p2 = map(col, (length, slope, n, p2))
    ok = (length > 0) & (slope > 0) & (n > 0) & (p2 > 0)
    return positive(ok, 0.42 * F.pow(n * length, F.lit(0.8)) / (F.sqrt(p2) * F.pow(slope, F.lit(0.4))))


def faa_minutes(length, slope, c) -> Column:
    length, slope = col(length), col(slope)
    return positive((length > 0) & (slope > 0), 1.8 * (1.1 - col(c)) * F.sqrt(length) / F.cbrt(100.0 * slope))


def segment_minutes(kind, length, slope, n, paved, p2, radius) -> Column:
    """Travel time of a TR-55 segment: sheet, shallow (paved or not) or channel."""
    kind, length, slope, n, radius = map(col, (kind, length, slope, n, radius))
    shallow = length / (F.when(col(paved), 20.33).otherwise(16.1346) * F.sqrt(slope)) / 60.0
    rough, r = F.when(n > 0, n).otherwise(0.013), F.when(radius > 0, radius).otherwise(1.0)
    channel = length / (K_US / rough * F.pow(r, F.lit(2.0 / 3.0)) * F.sqrt(slope)) / 60.0
    time = F.when(kind == "sheet", sheet_flow_minutes(length, slope, n, p2)).when(kind == "shallow", shallow).when(kind == "channel", channel)
    return F.when((length > 0) & (slope > 0), time).otherwise(0.0)


def worksheet(segments: DataFrame) -> DataFrame:
    """TR-55 segments with minutes and, in their order, running_minutes."""
    from pyspark.sql import Window as W

    minutes = segment_minutes("kind", "length_ft", "slope", "n", "paved", "p2_in", "hydraulic_radius_ft")
    so_far = W.partitionBy("network_id", "node_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return segments.withColumn("minutes", minutes).withColumn("running_minutes", F.sum("minutes").over(so_far))


def worksheet_tc(segments: DataFrame) -> DataFrame:
    """Time of concentration of each node: the sum over its segments."""
    minutes = segment_minutes("kind", "length_ft", "slope", "n", "paved", "p2_in", "hydraulic_radius_ft")
    return segments.groupBy("network_id", "node_id").agg(F.sum(minutes).alias("tc_minutes"))


def tc_minutes(method, length, slope, c=0.7, n=0.011, p2=3.0) -> Column:
    """Time by method: faa, tr55 or kirpich."""
    method = col(F.lit(method)) if method in ("faa", "tr55", "kirpich") else col(method)
    return F.when(method == "faa", faa_minutes(length, slope, c)).when(method == "tr55", sheet_flow_minutes(length, slope, n, p2)).when(method == "kirpich", kirpich_minutes(length, slope))


def frequency_factor(rp_years) -> Column:
    """Rational-method factor by return period."""
    rp = col(rp_years)
    return F.when(rp <= 10, 1.0).when(rp <= 25, 1.1).when(rp <= 50, 1.2).otherwise(1.25)


def effective_ca(c, area, cf=1.0) -> Column:
    return F.least(col(c) * col(cf), F.lit(1.0)) * col(area)


def rational_peak(c, intensity, area) -> Column:
    return col(c) * col(intensity) * col(area)


def depth_to_intensity(depth_in, duration_min) -> Column:
    return positive(col(duration_min) > 0, col(depth_in) / (col(duration_min) / 60.0))


def design_curve(idf: DataFrame, design_rp: int) -> DataFrame:
    """Each network's curve of the design period, else its curve of the smallest period."""
    order = F.struct(F.when(F.col("rp_years") == design_rp, 0).otherwise(1), "rp_years")
    return idf.groupBy("network_id").agg(F.min_by(F.struct("rp_years", "a", "b", "c"), order).alias("r")).select("network_id", "r.*")


def intensities_at(idf: DataFrame, minutes: float) -> DataFrame:
    """(network_id, rp_years, intensity) at a duration, by period ascending in each network."""
    return idf.select("network_id", "rp_years", idf_intensity(F.lit(minutes), "a", "b", "c").alias("intensity"))


def synthetic_set(curves: DataFrame) -> DataFrame:
    """Curves of six return periods from one (network_id, rp_years, a, b, c), scaled by fixed factors;
    the design period's curve stays as it is."""
    each = F.explode(F.array(*[F.struct(F.lit(rp).alias("rp"), F.lit(f).alias("f")) for rp, f in SYNTHETIC_FACTORS.items()]))
    made = curves.withColumn("e", each).select("network_id", F.col("e.rp").alias("rp_years"), F.when(F.col("e.rp") == F.col("rp_years"), F.col("a")).otherwise(F.col("a") * F.col("e.f")).alias("a"), "b", "c")
    return made.unionByName(curves.filter(~F.col("rp_years").isin(*SYNTHETIC_FACTORS)).select("network_id", "rp_years", "a", "b", "c"))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _line(points: Column, b: Column) -> Column:
    """struct(error, cut, slope) of ln i = cut + slope ln(t + b) by weighted least squares over points
    (w, t, y); an endless error where all t are one."""
    total = lambda of, f: F.aggregate(of, F.lit(0.0), lambda acc, p: acc + f(p))
    logs = F.transform(points, lambda p: F.struct(p["w"].alias("w"), F.ln(p["t"] + b).alias("x"), p["y"].alias("y")))

    def means(of):
        w = total(of, lambda p: p["w"])
        spread = F.array_max(F.transform(of, lambda p: p["x"])) - F.array_min(F.transform(of, lambda p: p["x"]))
        m = F.struct((total(of, lambda p: p["w"] * p["x"]) / w).alias("x"), (total(of, lambda p: p["w"] * p["y"]) / w).alias("y"), spread.alias("spread"))
        return _let(m, lambda m: F.when(m["spread"] >= 1e-9, sloped(of, m)).otherwise(F.struct(F.lit(float("inf")).alias("error"), F.lit(None).cast("double").alias("cut"), F.lit(0.0).alias("slope"))))

    def sloped(of, m):
        around = lambda p, c: p[c] - m[c]
        slope = total(of, lambda p: p["w"] * around(p, "x") * around(p, "y")) / total(of, lambda p: p["w"] * around(p, "x") * around(p, "x"))
        return _let(slope, lambda k: F.struct(total(of, lambda p: p["w"] * F.pow(around(p, "y") - k * around(p, "x"), F.lit(2.0))).alias("error"), (m["y"] - k * m["x"]).alias("cut"), k.alias("slope")))

    return _let(logs, means)


def _best_shift(points: Column) -> Column:
    """b of the least error: on a grid of quarter minutes to 40, then by 40 steps that keep the better
    half around it."""
    error = lambda b: _line(points, b)["error"]
    first = F.when(F.array_min(F.transform(points, lambda p: p["t"])) > 0, 0).otherwise(1)
    tried = F.transform(F.sequence(first, F.lit(160)), lambda k: _let(k * 0.25, lambda b: F.struct(error(b).alias("error"), b.alias("b"))))
    bracket = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(acc, _):
        return _let(0.5 * (acc["lo"] + acc["hi"]), lambda m: F.when(error(0.5 * (acc["lo"] + m)) < error(0.5 * (m + acc["hi"])), bracket(acc["lo"], m)).otherwise(bracket(m, acc["hi"])))

    start = _let(F.array_min(tried)["b"], lambda b: bracket(F.greatest(F.lit(0.0), b - 0.25), b + 0.25))
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halve, lambda acc: 0.5 * (acc["lo"] + acc["hi"]))


def fit_idf_curves(intensities: DataFrame, keys: list[str]) -> DataFrame:
    """IDF curves i = a / (t + b)^c (keys, a, b, c) fitted to (keys, duration_min, intensity) by least
    squares on logarithms; groups of fewer than three points are left out.

    Points without a duration of 0 or more or without an intensity don't count; an intensity below 1e-9
    counts as that; points of one duration alone give a = c = 0. Points of one duration are summed
    first, which leaves the fit as it is, so a group holds its durations, not its rows: one shuffle by
    keys and duration, one by keys, and expressions.
    """
    t, i = F.col("duration_min").cast("double"), F.col("intensity").cast("double")
    given = intensities.select(*keys, t.alias("_t"), F.ln(F.greatest(i, F.lit(1e-9))).alias("_y")).filter((t >= 0) & i.isNotNull() & ~F.isnan(i) & ~F.isnan(t))
    summed = given.groupBy(*keys, "_t").agg(F.count("*").alias("_n"), F.avg("_y").alias("_y"))
    point = F.struct(F.col("_t").alias("t"), F.col("_n").cast("double").alias("w"), F.col("_y").alias("y"))
    # In order of t: sums of doubles come out the same in every run.
    grouped = summed.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sort_array(F.collect_list(point)).alias("_points")).filter("_n >= 3")
    fitted = grouped.withColumn("_b", _best_shift(F.col("_points"))).withColumn("_f", _line(F.col("_points"), F.col("_b")))
    return fitted.select(*keys, F.coalesce(F.exp("_f.cut"), F.lit(0.0)).alias("a"), F.col("_b").alias("b"), (0.0 - F.col("_f.slope")).alias("c"))


def atlas_to_idf(depths: DataFrame, max_duration_min: float = 180.0, keys: tuple[str, ...] = ("network_id",)) -> DataFrame:
    """Curves by return period of depth-duration rows (keys, duration_min, rp_years, depth_in), from
    durations up to a cap."""
    used = depths.filter(F.col("duration_min") <= max_duration_min)
    return fit_idf_curves(used.withColumn("intensity", depth_to_intensity("depth_in", "duration_min")), [*keys, "rp_years"])


def nearest_period(idf: DataFrame, rp_years: float) -> DataFrame:
    """Each network's curve with the return period nearest to rp_years, the smaller one on ties."""
    order = F.struct(F.abs(F.col("rp_years") - rp_years), "rp_years")
    return idf.groupBy("network_id").agg(F.min_by(F.struct("rp_years", "a", "b", "c"), order).alias("r")).select("network_id", "r.*")
