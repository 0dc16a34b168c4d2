"""Registered query of the edit log: edits in the networks of all customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.operators import network
from culvert.operators.edit_log import EDITS, apply_edits
from culvert.plans import views
from culvert.plans.catalog import query
from culvert.plans.documents import _PLACED, _TO, _all, _part, _sql_part

#: Where the nearest point to (7, 0) lies on the pipe from (7, 9) to (0, 0).
_T = "(81.0::DOUBLE / 130.0::DOUBLE)"


@query(
    f"WITH c AS MATERIALIZED ({_PLACED.format(views.STREET)}), l AS (SELECT network_id, inv, last, c, area_ac FROM c WHERE ord = 1) "
    + " UNION ALL ".join(
        [
            _sql_part("node", "c", "ord", "'inlet'", "NULL", ("x", "0", "inv", "CASE WHEN ord = 1 THEN 34 ELSE tc_inlet END")),
            _sql_part("node", "c WHERE ord = last", "'OUT'", "'outfall'", "NULL", ("x + length", "0", "100", "0")),
            _sql_part("node", "l", "'N1'", "'inlet'", "NULL", ("7", "9", "100", "10")),
            _sql_part("node", "l", "'N2'", "'junction'", "NULL", (f"7 - 7 * {_T}", f"9 - 9 * {_T}", f"100 + {_T} * (inv - 100)", "10")),
            _sql_part("node", "l", "'N3'", "'inlet'", "NULL", ("20", "-20", "inv", "34")),
            _sql_part("pipe", "c WHERE ord < last", "'P' || ord", f"CASE WHEN ord = 1 THEN {_TO} ELSE CAST(ord AS VARCHAR) END", f"CASE WHEN ord = 1 THEN '1' ELSE {_TO} END", ("length", "diameter", "0.015")),
            _sql_part("pipe", "l", "'P' || (last + 1)", "'N1'", "'N2'", (f"{_T} * sqrt(130.0::DOUBLE)", "2.5", "0.013")),
            _sql_part("pipe", "l", "'P' || (last + 2)", "'N2'", "'1'", (f"(1 - {_T}) * sqrt(130.0::DOUBLE)", "2.5", "0.013")),
            _sql_part("rejected", "l", "'delete_node'", "'unknown node'", "NULL", ("10",)),
            _sql_part("version", "l", "'12'"),
        ]
    )
)
def edited_streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve edits in the network of every customer, as rows of one log."""
    nodes, pipes = views.street(spark, sf_dir)
    pipes = network.with_sections(pipes)
    last = pipes.groupBy("network_id").agg(F.max("ord").alias("last"))
    text = lambda c: F.lit(None).cast("string") if c is None else c if not isinstance(c, str) else F.lit(c)
    pipe = lambda k: F.concat(F.lit("P"), (F.col("last") + k).cast("string"))
    edit = lambda seq, op, id_=None, a=None, b=None, x=None, y=None, value=None: F.struct(F.lit(seq).alias("seq"), F.lit(op).alias("op"), text(id_).alias("id"), text(a).alias("a"), text(b).alias("b"), *[F.lit(v).cast("double").alias(k) for k, v in (("x", x), ("y", y), ("value", value))])
    edits = [
        edit(1, "set_roughness", value=0.015), edit(2, "place_structure", a="inlet", x=7, y=9), edit(3, "place_structure", "NEW", "outfall", x=70, y=90), edit(4, "place_pipe", a="N1", b="1", value=2.5),
        edit(5, "reverse_pipe", "P1"), edit(6, "set_tc", "1", value=33), edit(7, "set_tc", "1", value=34), edit(8, "delete_pipe", pipe(0)), edit(9, "merge_node", "NEW", "OUT"), edit(10, "delete_node", "nowhere"),
        edit(11, "split_pipe", pipe(1), x=7, y=0), edit(12, "duplicate_node", "1"),
    ]
    log = last.select("network_id", F.inline(F.array(*edits)))
    none = spark.createDataFrame([], "network_id bigint, ord int, id string, inlet string")
    done = apply_edits(nodes, pipes, none, log.select(*[c.split()[0] for c in EDITS.split(", ")]))
    return _all(
        [
            _part(done.nodes, "node", "id", "kind", None, ("x", "y", "invert", "tc_inlet")),
            _part(done.pipes, "pipe", "id", "from", "to", ("length", "diameter", "n")),
            _part(done.rejected, "rejected", "op", "reason", None, ("seq",)),
            _part(done.version, "version", F.col("version").cast("string")),
        ]
    )
