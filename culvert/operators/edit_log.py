"""Edits of very many networks as a table: a log that is applied by joins and windows.

A row of the log is an edit of a network; seq orders a network's edits. Every network takes its next
edits at the same time: edits that follow each other and do not build on one another make a round (new
structures, new pipes, settings, turned pipes, deletions), and splits, merges and copies are a round each.
A round is a few joins over all networks, written to the shared folder. The number of rounds is that of
the most edited network; no row of a network comes to the driver.

op, and what it uses of the columns id, a, b, x, y, value:
    place_structure  id (null: the next N...), a: kind, x, y       duplicate_node  id
    place_pipe       id (null: the next P...), a: from, b: to,     reverse_pipe    id
                     value: diameter (null: 1.5)                   delete_pipe     id
    split_pipe       id, x, y                                      delete_node     id
    move_node        id, x, y                                      merge_node      id: gone, a: into
    set_kind         id, a: kind                                   set_tc          id, value
    set_diameter     value                                         set_roughness   value
    relink_catchment value: place, a: inlet (null: none)           delete_catchment value: place

What an edit does is what the function of its name in operators.editing does; lengths are taken anew in
networks whose structures move or whose pipes are split. An edit that cannot be made changes nothing
and is a row of `rejected` with its reason, in the words of those functions.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from culvert.functions import geometry as ge
from culvert.operators.editing import NEW_NODE, sync_lengths
from culvert.operators.graph import kept

EDITS = "network_id bigint, seq int, op string, id string, a string, b string, x double, y double, value double"
#: Edits of one of these groups can be made together where they follow each other.
_TOGETHER = {
    "place_structure": 1, "place_pipe": 2, "move_node": 3, "set_kind": 3, "set_tc": 3, "set_diameter": 3, "set_roughness": 3, "reverse_pipe": 4, "delete_pipe": 5, "delete_node": 6,
    "relink_catchment": 7, "delete_catchment": 8,
}
_ALONE = ("split_pipe", "merge_node", "duplicate_node")
OPS = (*_TOGETHER, *_ALONE)
_KEY = ["network_id", "id"]


class Edited(NamedTuple):
    """Tables after the edits; version (network_id, version): the last edit's seq of each edited
    network; rejected: rows of the log with their reason."""

    nodes: DataFrame
    pipes: DataFrame
    catchments: DataFrame
    version: DataFrame
    rejected: DataFrame


class _State(NamedTuple):
    nodes: DataFrame
    pipes: DataFrame
    catchments: DataFrame


def in_rounds(edits: DataFrame) -> DataFrame:
    """Edits with their round, from 1."""
    group = F.coalesce(*[F.when(F.col("op") == op, g) for op, g in _TOGETHER.items()], F.lit(0))
    by_seq = W.partitionBy("network_id").orderBy("seq")
    grouped = edits.withColumn("group", group)
    begins = F.when((F.col("group") == 0) | ~F.col("group").eqNullSafe(F.lag("group").over(by_seq)), 1).otherwise(0)
    # Two steps: a window cannot hold another.
    marked = grouped.withColumn("begins", begins)
    return marked.withColumn("round", F.sum("begins").over(by_seq)).drop("group", "begins")


def _number(prefix: str) -> Column:
    return F.regexp_extract("id", f"^{prefix}([0-9]+)$", 1).try_cast("int")


def _named(new: DataFrame, table: DataFrame, prefix: str) -> DataFrame:
    """New rows with ids and ord: where id is null, one more than the largest number after the prefix that
    the network has by then; ord goes on after the table's."""
    held = table.groupBy("network_id").agg(F.coalesce(F.max(_number(prefix)), F.lit(0)).alias("_most"), F.coalesce(F.max("ord"), F.lit(0)).alias("_ord"))
    rows = new.join(held, "network_id", "left").na.fill(0, ["_most", "_ord"])
    by_seq = W.partitionBy("network_id").orderBy("seq")
    auto = F.col("id").isNull()
    rows = rows.withColumn("_before", F.greatest(F.col("_most"), F.coalesce(F.max(_number(prefix)).over(by_seq.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    rows = rows.withColumn("_rank", F.sum(F.when(auto, 1).otherwise(0)).over(by_seq)).withColumn("_place", F.row_number().over(by_seq))
    rows = rows.withColumn("_free", F.max(F.when(auto, F.col("_before") - F.col("_rank") + 1)).over(by_seq))
    made = F.concat(F.lit(prefix), (F.col("_rank") + F.col("_free")).cast("string"))
    rows = rows.withColumns({"id": F.coalesce("id", made), "ord": (F.col("_ord") + F.col("_place")).cast("int")})
    return rows.drop("_most", "_ord", "_before", "_rank", "_place", "_free")


def _as(rows: DataFrame, like: DataFrame, **values: Column) -> DataFrame:
    """Rows in the columns of a table: the given values, else the rows' own, else null."""
    own = lambda f: values[f.name] if f.name in values else F.col(f.name) if f.name in rows.columns else F.lit(None)
    return rows.select(*[own(f).cast(f.dataType).alias(f.name) for f in like.schema.fields])


def _checked(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, and (network_id, seq, op, reason) of the others."""
    rows = rows.withColumn("reason", reason)
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").select("network_id", "seq", "op", "reason")


def _has(rows: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """Rows with whether their column `on` is an id of keys (network_id, id)."""
    there = keys.select("network_id", F.col("id").alias(on)).distinct().withColumn(flag, F.lit(True))
    return rows.join(there, ["network_id", on], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _first_of(*keys: str) -> Column:
    """Whether a row is the first with its values of keys, none of them null, by seq."""
    return F.when(reduce(lambda p, q: p | q, [F.col(k).isNull() for k in keys]), True).otherwise(F.row_number().over(W.partitionBy("network_id", *keys).orderBy("seq")) == 1)


def _why(*cases: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(condition, F.lit(text)) for condition, text in cases])


def _place_structures(state: _State, edits: DataFrame):
    rows = _has(edits, state.nodes, "id", "taken").withColumn("first", _first_of("id"))
    good, bad = _checked(rows, _why((F.col("a").isNull() | ~F.col("a").isin("inlet", "junction", "outfall"), "unknown kind"), (F.col("taken") | ~F.col("first"), "this id is taken")))
    dry = {"area_ac", "c", "tc_inlet"}
    values = {k: F.when(F.col("a") == "outfall", 0.0).otherwise(v) if k in dry else F.lit(v) for k, v in NEW_NODE.items()}
    made = _as(_named(good, state.nodes, "N"), state.nodes, kind=F.col("a"), **values)
    return state._replace(nodes=state.nodes.unionByName(made)), bad


def _place_pipes(state: _State, edits: DataFrame):
    at = lambda e: state.nodes.select("network_id", F.col("id").alias(e), F.col("x").alias(f"x_{e}"), F.col("y").alias(f"y_{e}"), F.lit(True).alias(f"known_{e}"))
    pairs = state.pipes.select("network_id", F.col("from").alias("a"), F.col("to").alias("b"), F.lit(True).alias("there")).distinct()
    rows = edits.drop("x", "y").join(at("a"), ["network_id", "a"], "left").join(at("b"), ["network_id", "b"], "left").join(pairs, ["network_id", "a", "b"], "left")
    rows = _has(rows, state.pipes, "id", "taken")
    good, bad = _checked(
        rows,
        _why((F.col("a") == F.col("b"), "a pipe needs two nodes"), (F.col("known_a").isNull() | F.col("known_b").isNull(), "unknown node"), (F.col("there").isNotNull(), "these nodes have a pipe"), (F.col("taken"), "this id is taken")),
    )
    # Of what is left the first with these ends, and of those the first with an id.
    good, again = _checked(good.withColumn("first", _first_of("a", "b")), _why((~F.col("first"), "these nodes have a pipe")))
    good, twice = _checked(good.withColumn("first", _first_of("id")), _why((~F.col("first"), "this id is taken")))
    size = F.coalesce("value", F.lit(1.5))
    length = F.greatest(ge.distance("x_a", "y_a", "x_b", "y_b"), F.lit(1.0))
    values = {"from": F.col("a"), "to": F.col("b"), "length": length, "diameter": size, "n": F.lit(0.013), "shape": F.lit("circular"), "rise": size, "span": size}
    made = _as(_named(good, state.pipes, "P"), state.pipes, **values)
    return state._replace(pipes=state.pipes.unionByName(made)), bad.unionByName(again).unionByName(twice)


def _known(edits: DataFrame, table: DataFrame, what: str) -> tuple[DataFrame, DataFrame]:
    good, bad = _checked(_has(edits, table, "id", "there"), _why((~F.col("there"), f"unknown {what}")))
    return good.drop("there"), bad


def _settings(state: _State, edits: DataFrame):
    """Of each setting of an object the last one counts."""
    whole, own = edits.filter(F.col("op").isin("set_diameter", "set_roughness")), edits.filter(F.col("op").isin("move_node", "set_kind", "set_tc"))
    good, bad = _known(own, state.nodes, "node")
    last = lambda op, value: F.max_by(F.when(F.col("op") == op, value), F.when(F.col("op") == op, F.col("seq")))
    told = good.groupBy(*_KEY).agg(last("move_node", F.struct("x", "y")).alias("_at"), last("set_kind", F.col("a")).alias("_kind"), last("set_tc", F.col("value")).alias("_tc"))
    joined = state.nodes.join(told, _KEY, "left")
    nodes = joined.withColumns({"x": F.coalesce("_at.x", "x"), "y": F.coalesce("_at.y", "y"), "kind": F.coalesce("_kind", "kind"), "tc_inlet": F.coalesce("_tc", "tc_inlet")}).select(state.nodes.columns)
    sizes = whole.groupBy("network_id").agg(last("set_diameter", F.col("value")).alias("_d"), last("set_roughness", F.col("value")).alias("_n"))
    circle = F.coalesce(F.col("shape"), F.lit("circular")) == "circular" if "shape" in state.pipes.columns else F.lit(True)
    of = {c: F.when(circle & F.col("_d").isNotNull(), F.col("_d")).otherwise(F.col(c)) for c in ("diameter", "rise", "span") if c in state.pipes.columns}
    pipes = state.pipes.join(sizes, "network_id", "left").withColumns({**of, "n": F.coalesce("_n", "n")}).select(state.pipes.columns)
    return _State(nodes, _synced(nodes, pipes, told.filter("_at is not null")), state.catchments), bad


def _synced(nodes: DataFrame, pipes: DataFrame, changed: DataFrame) -> DataFrame:
    """Pipes with new lengths in the networks of changed (network_id)."""
    which = changed.select("network_id").distinct()
    moved, still = pipes.join(which, "network_id", "left_semi"), pipes.join(which, "network_id", "left_anti")
    return still.unionByName(sync_lengths(nodes, moved))


def _reverse(state: _State, edits: DataFrame):
    good, bad = _known(edits, state.pipes, "pipe")
    odd = good.groupBy(*_KEY).agg((F.count("*") % 2 == 1).alias("_turned"))
    turned = F.coalesce("_turned", F.lit(False))
    joined = state.pipes.join(odd, _KEY, "left")
    ends = {"from": F.when(turned, F.col("to")).otherwise(F.col("from")), "to": F.when(turned, F.col("from")).otherwise(F.col("to"))}
    return state._replace(pipes=joined.withColumns(ends).select(state.pipes.columns)), bad


def _delete_pipes(state: _State, edits: DataFrame):
    good, bad = _known(edits, state.pipes, "pipe")
    good, again = _checked(good.withColumn("first", _first_of("id")), _why((~F.col("first"), "unknown pipe")))
    return state._replace(pipes=state.pipes.join(good.select(*_KEY), _KEY, "left_anti")), bad.unionByName(again)


def _delete_nodes(state: _State, edits: DataFrame):
    good, bad = _known(edits, state.nodes, "node")
    good, again = _checked(good.withColumn("first", _first_of("id")), _why((~F.col("first"), "unknown node")))
    gone = good.select(*_KEY)
    pipes = state.pipes
    for end in ("from", "to"):
        pipes = pipes.join(gone.withColumnRenamed("id", end), ["network_id", end], "left_anti")
    return state._replace(nodes=state.nodes.join(gone, _KEY, "left_anti"), pipes=pipes.select(state.pipes.columns)), bad.unionByName(again)


def _placed(edits: DataFrame, catchments: DataFrame) -> DataFrame:
    there = catchments.select("network_id", F.col("ord").cast("int").alias("_ord"), F.lit(True).alias("there"))
    return edits.withColumn("_ord", F.col("value").cast("int")).join(there, ["network_id", "_ord"], "left")


def _relink(state: _State, edits: DataFrame):
    rows = _has(_placed(edits, state.catchments), state.nodes.filter("kind = 'inlet'"), "a", "inlet")
    good, bad = _checked(rows, _why((F.col("there").isNull(), "unknown catchment"), (F.col("a").isNotNull() & ~F.col("inlet"), "no such inlet")))
    told = good.groupBy("network_id", F.col("_ord").alias("ord")).agg(F.max_by(F.struct("a"), "seq").alias("_link"))
    joined = state.catchments.join(told, ["network_id", "ord"], "left")
    linked = joined.withColumn("inlet", F.when(F.col("_link").isNotNull(), F.col("_link.a")).otherwise(F.col("inlet")))
    return state._replace(catchments=linked.select(state.catchments.columns)), bad


def _delete_catchments(state: _State, edits: DataFrame):
    rows = _placed(edits, state.catchments).withColumn("first", _first_of("_ord"))
    good, bad = _checked(rows, _why((F.col("there").isNull() | ~F.col("first"), "unknown catchment")))
    gone = good.select("network_id", F.col("_ord").alias("ord"))
    return state._replace(catchments=state.catchments.join(gone, ["network_id", "ord"], "left_anti")), bad


def _split(state: _State, edits: DataFrame):
    """At most one in a network: a junction at the nearest point of the pipe, which ends there."""
    ends = lambda e: state.nodes.select("network_id", F.col("id").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ("x", "y", "invert", "rim")])
    asked = edits.select("network_id", "seq", "op", "id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    rows = asked.join(state.pipes, _KEY, "left").join(ends("from"), ["network_id", "from"], "left").join(ends("to"), ["network_id", "to"], "left")
    good, bad = _checked(rows, _why((F.col("from").isNull(), "unknown pipe"), (F.col("x_from").isNull() | F.col("x_to").isNull(), "unknown node")))
    good = good.withColumn("at", ge.segment_projection("_x", "_y", "x_from", "y_from", "x_to", "y_to")).withColumnRenamed("id", "pipe")
    between = lambda c: F.col(f"{c}_from") + F.col("at.t") * (F.col(f"{c}_to") - F.col(f"{c}_from"))
    node = _named(good.withColumn("id", F.lit(None).cast("string")).drop("ord"), state.nodes, "N")
    zero = F.lit(0.0)
    made = _as(node.select("network_id", "ord", "id", "at", *[f"{c}_{e}" for c in ("invert", "rim") for e in ("from", "to")]), state.nodes, kind=F.lit("junction"), x=F.col("at.x"), y=F.col("at.y"), area_ac=zero, c=zero, tc_inlet=F.lit(10.0), invert=between("invert"), rim=between("rim"))
    cut = node.select("network_id", F.col("pipe").alias("id"), F.col("id").alias("_new"))
    first = state.pipes.join(cut, _KEY, "left")
    halves = first.withColumn("to", F.coalesce("_new", "to")).select(state.pipes.columns)
    second = first.filter("_new is not null").withColumns({"from": F.col("_new"), "id": F.lit(None).cast("string"), "seq": F.lit(1)}).drop("ord", "_new")
    pipes = halves.unionByName(_as(_named(second, state.pipes, "P"), state.pipes))
    nodes = state.nodes.unionByName(made)
    return state._replace(nodes=nodes, pipes=_synced(nodes, pipes, good)), bad


def _merge(state: _State, edits: DataFrame):
    """At most one in a network: pipes and catchments of `id` move to `a`; loops go, and of equal pipes
    of the network the first stays."""
    rows = _has(_has(edits, state.nodes, "id", "there"), state.nodes, "a", "other")
    good, bad = _checked(rows, _why((~F.col("there") | ~F.col("other"), "unknown node"), (F.col("id") == F.col("a"), "a node cannot be merged with itself")))
    told = good.select("network_id", F.col("id").alias("_gone"), F.col("a").alias("_into"))
    moved = lambda c: F.when(F.col(c) == F.col("_gone"), F.col("_into")).otherwise(F.col(c))
    own = state.pipes.join(told, "network_id").withColumns({"from": moved("from"), "to": moved("to")}).filter(F.col("from") != F.col("to"))
    own = own.withColumn("_k", F.row_number().over(W.partitionBy("network_id", "from", "to").orderBy("ord"))).filter("_k = 1")
    pipes = state.pipes.join(told.select("network_id"), "network_id", "left_anti").unionByName(own.select(state.pipes.columns))
    nodes = state.nodes.join(told.select("network_id", F.col("_gone").alias("id")), _KEY, "left_anti")
    catchments = state.catchments.join(told, "network_id", "left").withColumn("inlet", moved("inlet")).select(state.catchments.columns)
    return _State(nodes, pipes, catchments), bad


def _duplicate(state: _State, edits: DataFrame):
    """At most one in a network: a copy of a node beside it."""
    good, bad = _known(edits, state.nodes, "node")
    copy = good.select(*_KEY, "seq").join(state.nodes.drop("ord"), _KEY).withColumns({"id": F.lit(None).cast("string"), "x": F.col("x") + 20.0, "y": F.col("y") - 20.0})
    return state._replace(nodes=state.nodes.unionByName(_as(_named(copy, state.nodes, "N"), state.nodes))), bad


_STEPS = {
    ("place_structure",): _place_structures, ("place_pipe",): _place_pipes, ("move_node", "set_kind", "set_tc", "set_diameter", "set_roughness"): _settings, ("reverse_pipe",): _reverse,
    ("delete_pipe",): _delete_pipes, ("delete_node",): _delete_nodes, ("relink_catchment",): _relink, ("delete_catchment",): _delete_catchments, ("split_pipe",): _split, ("merge_node",): _merge,
    ("duplicate_node",): _duplicate,
}


def apply_edits(nodes: DataFrame, pipes: DataFrame, catchments: DataFrame, edits: DataFrame, upto: int | None = None) -> Edited:
    """Networks after the edits of a log (see EDITS), or after those with seq up to `upto`: an earlier
    version, as undo gives it. Networks without edits stay as they are; edits of one network with the
    same seq are rejected, as are unknown ones."""
    log = edits if upto is None else edits.filter(F.col("seq") <= upto)
    clear = (F.count("*").over(W.partitionBy("network_id", "seq")) == 1) & F.col("seq").isNotNull()
    ranked, odd = _checked(log.withColumn("_clear", clear), _why((~F.col("_clear"), "no place in the order"), (F.col("op").isNull() | ~F.col("op").isin(*OPS), "unknown edit")))
    ranked = kept(in_rounds(ranked.drop("_clear")))
    state, rejected = _State(nodes, pipes, catchments), [odd]
    # A row a round: which edits it holds.
    for row in ranked.groupBy("round").agg(F.collect_set("op").alias("ops")).orderBy("round").collect():
        now = ranked.filter(F.col("round") == row["round"]).drop("round")
        # In a round a network has edits of one step alone, so the steps work side by side.
        parts, bad = [_State(*(df.join(now.select("network_id").distinct(), "network_id", "left_anti").select(df.columns) for df in state))], []
        for ops, step in _STEPS.items():
            if set(ops) & set(row.ops):
                mine = now.filter(F.col("op").isin(*ops))
                nets = mine.select("network_id").distinct()
                made, odd = step(_State(*(df.join(nets, "network_id", "left_semi").select(df.columns) for df in state)), mine)
                parts.append(made)
                bad.append(odd)
        rejected.append(kept(reduce(DataFrame.unionByName, bad)))
        state = _State(*(kept(reduce(DataFrame.unionByName, dfs)) for dfs in zip(*parts, strict=True)))
    version = log.groupBy("network_id").agg(F.max("seq").alias("version"))
    return Edited(*state, version, reduce(DataFrame.unionByName, rejected))
