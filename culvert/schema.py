"""Schemas, options and fixed tables. Units are feet, acres, minutes, in/hr and cfs."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Manning's and gravity constants, US and metric.
K_US, G_US = 1.49, 32.2
K_SI, G_SI = 1.0, 9.81

NODES = "network_id bigint, ord int, id string, kind string, invert double, rim double, area_ac double, c double, tc_inlet double, x double, y double"
PIPES = "network_id bigint, ord int, id string, `from` string, `to` string, length double, diameter double, n double, shape string, rise double, span double"
IDF = "network_id bigint, rp_years int, a double, b double, c double"
CATCHMENTS = "network_id bigint, ord int, id string, vertices array<struct<x:double,y:double>>, c double, slope double, flow_length_ft double, inlet string"
SEGMENTS = "network_id bigint, node_id string, seq int, kind string, length_ft double, slope double, n double, paved boolean, p2_in double, hydraulic_radius_ft double"

#: Nominal pipe diameters in inches and in millimetres.
CATALOG_IN = (8, 10, 12, 15, 18, 21, 24, 27, 30, 33, 36, 42, 48, 54, 60, 66, 72)
CATALOG_MM = (300, 375, 450, 525, 600, 675, 750, 900, 1050, 1200, 1350, 1500, 1800)
#: Installed cost, US$ a foot, by diameter in inches.
COST_PER_FT = {
    12: 85.0, 15: 95.0, 18: 110.0, 21: 125.0, 24: 140.0, 27: 160.0, 30: 180.0, 33: 200.0,
    36: 225.0, 42: 275.0, 48: 330.0, 54: 390.0, 60: 460.0, 66: 540.0, 72: 625.0,
}
#: Intensity factors of a synthetic set, by return period in years.
SYNTHETIC_FACTORS = {2: 0.75, 5: 0.88, 10: 1.0, 25: 1.15, 50: 1.28, 100: 1.40}


@dataclass(frozen=True)
class Options:
    """Analysis options; None stands for not set."""

    min_tc: float = 10.0
    tailwater: float | None = None
    junction_k: float = 0.5
    intensity_override: float | None = None
    min_slope: float = 0.001
    bend_loss_coeff: float = 0.0
    hec22: bool = False
    access_hole_diam_ft: float = 4.0
    bench_factor: float = 1.0
    cf: float = 1.0

    def columns(self) -> dict:
        """Literal columns, so that Catalyst folds them; flags are doubles."""
        return {k: F.lit(None if v is None else float(v)).cast("double") for k, v in asdict(self).items()}


@dataclass(frozen=True)
class DesignCriteria:
    min_velocity: float = 2.0
    max_velocity: float = 10.0
    max_pct_full: float = 0.85
    require_open_channel: bool = True

    @classmethod
    def lateral(cls) -> DesignCriteria:
        return cls(max_pct_full=0.95)


@dataclass(frozen=True)
class ReviewCriteria:
    min_velocity: float = 2.0
    max_velocity: float = 10.0
    max_pct_full: float = 0.85
    min_cover_ft: float = 1.0
    min_slope: float = 0.0005
    check_size_progression: bool = True
    min_freeboard_ft: float = 0.5


@dataclass(frozen=True)
class InletGeometry:
    """Gutter and inlet geometry, ft and ft/ft."""

    kind: str = "grate_on_grade"
    grate_length_ft: float = 2.0
    grate_width_ft: float = 1.5
    curb_opening_length_ft: float = 4.0
    gutter_slope: float = 0.01
    cross_slope: float = 0.02
    gutter_n: float = 0.016
    splash_over_velocity_fps: float = 5.0
    allowable_spread_ft: float = 10.0
    clogging_fraction: float = 0.0
    sag_ponding_depth_ft: float = 0.3
    curb_opening_height_ft: float = 0.5

    def columns(self) -> dict:
        return {k: F.lit(v) for k, v in asdict(self).items()}


@dataclass(frozen=True)
class Params:
    """Everything that a standard study sets."""

    options: Options = Options()
    design: DesignCriteria = DesignCriteria()
    review: ReviewCriteria = ReviewCriteria()
    inlet: InletGeometry = InletGeometry()
    idf: tuple[float, float, float] = (60.0, 10.0, 0.8)

    def summary(self) -> str:
        a, b, c = self.idf
        o, d = self.options, self.design
        loss = "HEC-22" if o.hec22 else f"K {o.junction_k:g}"
        tail = "free outfall" if o.tailwater is None else f"tailwater {o.tailwater:g} ft"
        return f"i = {a:g}/(t+{b:g})^{c:g}; min Tc {o.min_tc:g} min; {tail}; {loss}; V {d.min_velocity:g}-{d.max_velocity:g} ft/s; max {100 * d.max_pct_full:g}% full"


def catalog(spark: SparkSession) -> DataFrame:
    """Pipe catalog: 17 rows (diameter_in, diameter_ft)."""
    return spark.createDataFrame([(d, d / 12.0) for d in CATALOG_IN], "diameter_in int, diameter_ft double")


def cost_table(spark: SparkSession) -> DataFrame:
    """Cost table: 15 rows (diameter_in, cost_per_ft)."""
    return spark.createDataFrame(list(COST_PER_FT.items()), "diameter_in int, cost_per_ft double")
