"""Analysis of storm networks: flows downstream, hydraulic grade lines upstream.

Time of concentration, flow, depth and velocity depend on each other from reach to reach, so a
network is solved as a whole; networks and scenarios are independent. Rows of nodes, pipes and
scenarios are dealt by network_id in one shuffle, sorted, and solved in Arrow batches: thousands
of networks at a time, one level of all of them after the other, with NumPy on whole levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.functions import solvers
from culvert.functions.hydrology import frequency_factor
from culvert.schema import G_US, Options

#: Rows that are solved together at least; whole networks are never cut.
CHUNK_ROWS = 150_000
#: Pipes of a task, beyond the number of tasks that the session asks for.
TASK_PIPES = 500_000
_KINDS = {"inlet": 0, "junction": 1, "outfall": 2}
OUTFALL = 2
NUMBERS = 11
_TAGGED = "network_id bigint, tag int, ord int, id string, s1 string, s2 string, " + ", ".join(f"v{k} double" for k in range(NUMBERS))
_PIPE_OUT = (
    "slope", "manning_slope", "total_ca", "intensity", "tc", "travel_time", "design_q", "capacity", "max_capacity", "normal_depth",
    "critical_depth", "velocity", "velocity_full", "pct_full", "hgl_up", "hgl_dn",
)
_SOLVED = (
    "network_id bigint, rp_years int, kind string, ord int, id string, `from` string, `to` string, surcharged boolean, "
    + ", ".join(f"{c} double" for c in _PIPE_OUT)
    + ", hgl double, rim double, surcharge_to_surface boolean"
)
SCENARIO = ("a", "b", "c", "min_tc", "tailwater", "junction_k", "intensity_override", "min_slope", "bend_loss_coeff", "hec22", "access_hole_diam_ft", "bench_factor", "cf")


class Analysis(NamedTuple):
    """Lazy results. `solved` has both; cache() it to use both pipes and nodes without solving twice."""

    pipes: DataFrame
    nodes: DataFrame
    errors: DataFrame
    solved: DataFrame


class UnknownNode(ValueError):
    pass


class CyclicNetwork(ValueError):
    pass


def _tagged(tag: int, df: DataFrame, s1, s2, numbers: list, order="ord", id_="id") -> DataFrame:
    cols = [F.lit(None).cast("string") if s is None else F.col(s) for s in (s1, s2)]
    numbers = [F.col(x) if isinstance(x, str) else x for x in numbers]
    numbers += [F.lit(None)] * (NUMBERS - len(numbers))
    return df.select(
        F.col("network_id").cast("bigint").alias("network_id"), F.lit(tag).alias("tag"), F.col(order).cast("int").alias("ord"), F.col(id_).cast("string").alias("id"),
        cols[0].alias("s1"), cols[1].alias("s2"), *[x.cast("double").alias(f"v{k}") for k, x in enumerate(numbers)],
    )


def analyze(nodes: DataFrame, pipes: DataFrame, idf: DataFrame | None = None, options: Options = Options(), scenarios: DataFrame | None = None) -> Analysis:
    """Flows and grade lines of every network, for every row of `idf` (network_id, rp_years, a, b, c).

    Without idf, options.intensity_override gives the intensity. `scenarios` (network_id, rp_years
    and any of the options) overrides options by network and return period. A network without a
    row in idf is not solved. A network with a pipe to an unknown node, or with a cycle, gives no
    results but a row of `errors` (network_id, rp_years, error).
    """
    if idf is None:
        idf = nodes.select("network_id").distinct().select("network_id", F.lit(None).cast("int").alias("rp_years"), *[F.lit(0.0).alias(x) for x in "abc"])
    given = idf.withColumns(options.columns())
    if scenarios is not None:
        mine = [c for c in options.columns() if c in scenarios.columns]
        other = scenarios.select("network_id", "rp_years", *[F.col(c).cast("double").alias(f"_{c}") for c in mine])
        given = given.join(other, ["network_id", "rp_years"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in mine})
    return _analysis(nodes, pipes, given)


def _analysis(nodes: DataFrame, pipes: DataFrame, given: DataFrame) -> Analysis:
    """analyze() of rows of scenarios with all of their options."""
    pipes = with_sections(pipes)
    shape = F.coalesce(*[F.when(F.col("shape") == k, F.lit(float(v))) for k, v in solvers.SHAPES.items()], F.lit(0.0))
    rows = (
        _tagged(0, given.withColumn("sid", F.lit(None)), None, None, ["a", "b", "c", *SCENARIO[3:11]], "rp_years", "sid")
        .unionByName(_tagged(1, given.withColumn("sid", F.lit(None)), None, None, ["bench_factor", "cf"], "rp_years", "sid"))
        .unionByName(_tagged(2, nodes, "kind", None, ["invert", "rim", "area_ac", "c", "tc_inlet", "x", "y"]))
        .unionByName(_tagged(3, pipes, "from", "to", ["length", "n", "rise", "span", shape]))
    )
    # By a code of the id: Spark drops a repartition by the id itself where it holds all parts of the
    # union to be dealt by it, which adaptive coalescing of their shuffles can make untrue.
    # The number is given, as adaptive coalescing counts bytes and not the work of a solve.
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-pipes.select("network_id").count() // TASK_PIPES))
    dealt = rows.repartition(parts, F.xxhash64("network_id")).sortWithinPartitions("network_id", "tag", "ord")
    solved = dealt.mapInArrow(_solve_all, _SOLVED)
    pipe_cols = ["network_id", "rp_years", "ord", "id", "from", "to", *_PIPE_OUT, "surcharged"]
    return Analysis(
        solved.filter("kind = 'pipe'").select(*pipe_cols),
        solved.filter("kind = 'node'").select("network_id", "rp_years", "ord", "id", "tc", "hgl", "rim", "surcharge_to_surface"),
        solved.filter("kind = 'error'").select("network_id", "rp_years", F.col("id").alias("error")),
        solved,
    )


def analyze_rational(nodes: DataFrame, pipes: DataFrame, intensity: float, options: Options = Options()) -> Analysis:
    """analyze with one intensity for all reaches."""
    from dataclasses import replace

    return analyze(nodes, pipes, None, replace(options, intensity_override=intensity))


def analyze_all_periods(nodes: DataFrame, pipes: DataFrame, idf: DataFrame, options: Options = Options()) -> Analysis:
    """analyze for all return periods of idf in one job, each with its frequency factor."""
    # The factor follows from the row itself: a join of idf with itself may be planned as a broadcast of all networks.
    given = idf.withColumns(options.columns())
    return _analysis(nodes, pipes, given.withColumn("cf", F.coalesce(frequency_factor("rp_years"), "cf")))


def check(analysis: Analysis) -> Analysis:
    """Raises the first error of any network (an action), else returns the analysis."""
    if row := analysis.errors.first():
        raise (CyclicNetwork if row.error == "cycle" else UnknownNode)(f"network {row.network_id}: {row.error}")
    return analysis


def with_sections(pipes: DataFrame) -> DataFrame:
    """Pipes with shape, rise and span filled: a section without both sizes is a circle."""
    cols = set(pipes.columns)
    size = lambda c: F.col(c) if c in cols else F.lit(None).cast("double")
    shape = F.col("shape") if "shape" in cols else F.lit(None).cast("string")
    other = shape.isin("rectangular", "elliptical", "arch") & (size("rise") > 0) & (size("span") > 0)
    circle = F.col("diameter")
    return pipes.withColumns({"shape": F.when(other, shape).otherwise("circular"), "rise": F.when(other, size("rise")).otherwise(circle), "span": F.when(other, size("span")).otherwise(circle)})


class _Chunk:
    """Columns of whole networks in order of network, tag and ord."""

    def __init__(self, batch: pa.Table) -> None:
        self.network = batch.column("network_id").to_numpy()
        self.tag = batch.column("tag").to_numpy()
        self.ord = batch.column("ord").fill_null(-1).to_numpy()
        self.id, self.s1, self.s2 = (batch.column(c) for c in ("id", "s1", "s2"))
        self.v = np.stack([batch.column(f"v{k}").to_numpy(zero_copy_only=False) for k in range(NUMBERS)])


def _solve_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("network_id").to_numpy()
            cut = int(np.searchsorted(ids, ids[-1]))  # the last network may go on
            if cut:
                yield from solve_tables(table.slice(0, cut))
            rest = table.slice(cut)
            held, rows = rest.to_batches(), rest.num_rows
    if held:
        yield from solve_tables(pa.Table.from_batches(held))


def solve_tables(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Results of whole networks, sorted by network, tag and ord (tags 0 and 1: scenarios, 2: nodes, 3: pipes)."""
    chunk = _Chunk(table.combine_chunks())
    at = [np.flatnonzero(chunk.tag == k) for k in range(4)]
    scen, more, node, pipe = at
    if not len(scen):
        return
    # Local indices of nodes by network and id; of repeated ids the last counts.
    index = {key: k for k, key in enumerate(zip(chunk.network[node].tolist(), chunk.id.take(pa.array(node)).to_pylist(), strict=True))}
    nets = chunk.network[pipe].tolist()
    ends = [np.array([index.get(key, -1) for key in zip(nets, side.take(pa.array(pipe)).to_pylist(), strict=True)], np.int64) for side in (chunk.s1, chunk.s2)]
    known = (ends[0] >= 0) & (ends[1] >= 0)
    errors: dict[int, str] = {}
    ids = chunk.id.take(pa.array(pipe)).to_pylist()
    for k in np.flatnonzero(~known)[::-1]:
        errors[nets[k]] = f"pipe {ids[k]} references an unknown node"
    level = _levels(len(node), ends[0][known], ends[1][known])
    for k in np.unique(chunk.network[node][level < 0]):
        errors.setdefault(int(k), "cycle")
    good = ~np.isin(chunk.network, list(errors)) if errors else np.ones(len(chunk.network), bool)

    keep_node, keep_pipe = good[node], good[pipe]
    place = np.cumsum(keep_node) - 1
    node, pipe, level = node[keep_node], pipe[keep_pipe], level[keep_node]
    u, v = place[ends[0][keep_pipe]], place[ends[1][keep_pipe]]
    keep_scen = good[scen]
    for k in np.flatnonzero(~keep_scen):
        yield _error(int(chunk.network[scen[k]]), int(chunk.ord[scen[k]]), errors[int(chunk.network[scen[k]])])
    scen, more = scen[keep_scen], more[keep_scen]
    if not len(node) or not len(scen):
        return

    # One copy of a network's nodes and pipes for each of its scenarios.
    node_net, pipe_net = chunk.network[node], chunk.network[pipe]
    first_node = np.searchsorted(node_net, chunk.network[scen])
    n_nodes = np.searchsorted(node_net, chunk.network[scen], side="right") - first_node
    first_pipe = np.searchsorted(pipe_net, chunk.network[scen])
    n_pipes = np.searchsorted(pipe_net, chunk.network[scen], side="right") - first_pipe
    of_node, of_pipe = np.repeat(np.arange(len(scen)), n_nodes), np.repeat(np.arange(len(scen)), n_pipes)
    start = np.cumsum(n_nodes) - n_nodes
    take_node = np.arange(n_nodes.sum()) - np.repeat(start - first_node, n_nodes)
    take_pipe = np.arange(n_pipes.sum()) - np.repeat(np.cumsum(n_pipes) - n_pipes - first_pipe, n_pipes)
    moved = (start - first_node)[of_pipe]
    opts = {name: chunk.v[k][scen] for k, name in enumerate(SCENARIO[:11])} | {name: chunk.v[k][more] for k, name in enumerate(SCENARIO[11:])}
    kinds = np.array([_KINDS.get(k, 1) for k in chunk.s1.take(pa.array(node)).to_pylist()])
    nv, pv = chunk.v[:, node[take_node]], chunk.v[:, pipe[take_pipe]]
    solved = solve_levels(kinds[take_node], nv, level[take_node], of_node, u[take_pipe] + moved, v[take_pipe] + moved, pv, of_pipe, opts)

    own = lambda where: pa.array(where)
    rp = pa.array(chunk.ord[scen], mask=chunk.ord[scen] < 0)
    p, w = own(pipe[take_pipe]), own(node[take_node])
    null = lambda n, kind: pa.nulls(n, kind)
    number = lambda x: pa.array(x, mask=np.isnan(x))
    n, m = len(take_pipe), len(take_node)
    yield _batch(
        [pa.array(chunk.network[pipe[take_pipe]]), rp.take(own(of_pipe)), pa.array(["pipe"] * n), pa.array(chunk.ord[pipe[take_pipe]]), _flat(chunk.id.take(p)), _flat(chunk.s1.take(p)), _flat(chunk.s2.take(p)), pa.array(solved["surcharged"])]
        + [number(solved[c]) for c in _PIPE_OUT]
        + [null(n, pa.float64()), null(n, pa.float64()), null(n, pa.bool_())]
    )
    node_cols = {"tc": number(solved["node_tc"])}
    yield _batch(
        [pa.array(chunk.network[node[take_node]]), rp.take(own(of_node)), pa.array(["node"] * m), pa.array(chunk.ord[node[take_node]]), _flat(chunk.id.take(w)), null(m, pa.string()), null(m, pa.string()), null(m, pa.bool_())]
        + [node_cols.get(c, null(m, pa.float64())) for c in _PIPE_OUT]
        + [number(solved["hgl"]), number(nv[1]), pa.array(solved["surcharge_to_surface"])]
    )


def _flat(x):
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


_NAMES = ["network_id", "rp_years", "kind", "ord", "id", "from", "to", "surcharged", *_PIPE_OUT, "hgl", "rim", "surcharge_to_surface"]
_TYPES = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), *[pa.float64()] * (len(_PIPE_OUT) + 2), pa.bool_()]


def _batch(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _error(network: int, rp: int, error: str) -> pa.RecordBatch:
    row = {"network_id": network, "rp_years": None if rp < 0 else rp, "kind": "error", "id": error}
    return _batch([pa.array([row.get(c)], t) for c, t in zip(_NAMES, _TYPES, strict=True)])


def _levels(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Longest path from a source to each node; -1 on and below cycles."""
    level, waits = np.full(n, -1, np.int64), np.bincount(v, minlength=n)
    order = np.argsort(u, kind="stable")
    bounds = np.searchsorted(u[order], np.arange(n + 1))
    front, depth = np.flatnonzero(waits == 0), 0
    while len(front):
        level[front] = depth
        size = bounds[front + 1] - bounds[front]
        out = np.repeat(bounds[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
        below = v[order[out]]
        np.subtract.at(waits, below, 1)
        front, depth = np.unique(below[waits[below] == 0]), depth + 1
    return level


def deflection_cos(ax, ay, jx, jy, bx, by):
    """Cosine of the turn at j from a to b; 1 where a leg has no length."""
    px, py, qx, qy = jx - ax, jy - ay, bx - jx, by - jy
    size = np.hypot(px, py) * np.hypot(qx, qy)
    return np.where(size > 1e-12, np.clip(np.divide(px * qx + py * qy, size, out=np.ones_like(size), where=size > 1e-12), -1.0, 1.0), 1.0)


def solve_levels(kind, nv, level, of_node, u, v, pv, of_pipe, opts) -> dict:
    """Results of pipes u -> v (in input order) and nodes, of many scenarios at once."""
    invert, rim, area, c, tc_in, x, y = nv[:7]
    length, n, rise, span, shape = pv[:5]
    sections = solvers.Sections(shape.astype(int), rise, span)
    N, P = len(kind), len(u)
    slope = np.divide(invert[u] - invert[v], length, out=np.zeros(P), where=length > 0)
    m_slope = np.where(np.abs(slope) < 1e-6, opts["min_slope"][of_pipe], slope)
    q_max, y_max = solvers.max_capacity(n, m_slope, sections)
    full_area, full_radius = sections.full()
    total = np.minimum(c * opts["cf"][of_node], 1.0) * area
    tc = np.where(kind == OUTFALL, 0.0, tc_in)
    i, q, yn, velocity, travel = (np.zeros(P) for _ in range(5))
    surcharged = np.zeros(P, bool)
    by_level = np.argsort(level[u], kind="stable")
    bounds = np.searchsorted(level[u][by_level], np.arange(level.max() + 2))
    floors, a, b, cc, fixed = opts["min_tc"], opts["a"], opts["b"], opts["c"], opts["intensity_override"]
    nodes_by_level = np.argsort(level, kind="stable")
    node_bounds = np.searchsorted(level[nodes_by_level], np.arange(level.max() + 2))

    for k in range(level.max() + 1):
        own = nodes_by_level[node_bounds[k] : node_bounds[k + 1]]
        tc[own] = np.maximum(tc[own], floors[of_node[own]])
        p = by_level[bounds[k] : bounds[k + 1]]
        if not len(p):
            continue
        up, s = u[p], of_pipe[p]
        i[p] = np.where(np.isnan(fixed[s]), a[s] / (np.maximum(tc[up], 0.0) + b[s]) ** cc[s], fixed[s])
        q[p] = i[p] * total[up]
        surcharged[p] = q[p] > q_max[p]
        yn[p] = solvers.normal_depth(q[p], n[p], m_slope[p], sections[p], (q_max[p], y_max[p]))
        wet = np.where(surcharged[p], full_area[p], sections[p].geometry(np.where(np.isnan(yn[p]), rise[p], yn[p]))[0])
        velocity[p] = np.divide(q[p], wet, out=np.zeros(len(p)), where=wet > 0)
        travel[p] = np.divide(length[p], velocity[p] * 60.0, out=np.zeros(len(p)), where=velocity[p] > 0)
        np.maximum.at(tc, v[p], tc[up] + travel[p])
        np.add.at(total, v[p], total[up])

    yc = solvers.critical_depth(q, sections)
    capacity = solvers.full_capacity(n, m_slope, sections)
    hgl, hgl_up, hgl_dn = np.full(N, np.nan), np.full(P, np.nan), np.full(P, np.nan)
    first_out, first_in = np.full(N, P), np.full(N, P)
    np.minimum.at(first_out, u, np.arange(P))
    np.minimum.at(first_in, v, np.arange(P))
    into = np.argsort(level[v], kind="stable")
    bounds = np.searchsorted(level[v][into], np.arange(level.max() + 2))
    turn = lambda p_in, p_out: deflection_cos(x[u[p_in]], y[u[p_in]], x[v[p_in]], y[v[p_in]], x[v[p_out]], y[v[p_out]])
    for k in range(level.max(), -1, -1):
        own = nodes_by_level[node_bounds[k] : node_bounds[k + 1]]
        seed = np.where((kind[own] == OUTFALL) & ~np.isnan(opts["tailwater"][of_node[own]]), opts["tailwater"][of_node[own]], invert[own])
        hgl[own] = np.where(np.isnan(hgl[own]), seed, hgl[own])
        p = into[bounds[k] : bounds[k + 1]]
        if not len(p):
            continue
        hgl_dn[p] = hgl[v[p]]
        p = p[slope[p] >= -1e-6]  # an adverse reach takes no grade line upstream
        if not len(p):
            continue
        d, up, s, sec = v[p], u[p], of_pipe[p], sections[p]
        depth = np.where(np.isnan(yn[p]), rise[p], yn[p])
        crown = invert[d] + rise[p]
        steep = ~surcharged[p] & (depth < yc[p] * 0.98) & (hgl[d] <= crown)
        conv = np.where(n[p] > 0, np.divide(solvers.K_US, n[p], out=np.zeros(len(p)), where=n[p] > 0) * full_area[p] * full_radius[p] ** (2.0 / 3.0), 0.0)
        friction = np.divide(q[p], conv, out=np.zeros(len(p)), where=conv > 0) ** 2
        level_up = np.where(surcharged[p], np.maximum(hgl[d], crown) + friction * length[p], invert[up] + depth)
        calm = ~surcharged[p] & ~steep
        if calm.any():
            r = p[calm]
            surface = np.maximum(hgl[v[r]], invert[v[r]] + np.maximum(yc[r], 1e-4))
            level_up[calm] = solvers.backwater(sections[r], n[r], q[r], invert[v[r]], invert[u[r]], length[r], surface, yc[r], depth[calm])
        follows = first_out[d] < P
        bend = np.where(follows, opts["bend_loss_coeff"][s] * (1.0 - turn(p, np.minimum(first_out[d], P - 1))) / 2.0, 0.0)
        loss = (opts["junction_k"][s] + np.where(opts["bend_loss_coeff"][s] > 0, bend, 0.0)) * velocity[p] ** 2 / (2.0 * G_US)
        if (opts["hec22"][s] > 0).any():
            has = first_in[up] < P
            before = np.minimum(first_in[up], P - 1)
            cos, d_in = np.where(has, turn(before, p), 1.0), np.where(has, rise[before], 0.0)
            hole = solvers.access_hole_loss(velocity[p], sec.rise, opts["access_hole_diam_ft"][s], cos, np.maximum(level_up - invert[up], 0.0), d_in, opts["bench_factor"][s])
            loss = np.where(opts["hec22"][s] > 0, hole, loss)
        hgl_up[p] = level_up + np.where(steep, 0.0, loss)
        np.fmax.at(hgl, up, hgl_up[p])
    return {
        "slope": slope, "manning_slope": m_slope, "total_ca": total[u], "intensity": i, "tc": tc[u], "travel_time": travel, "design_q": q, "capacity": capacity,
        "max_capacity": q_max, "normal_depth": yn, "critical_depth": yc, "velocity": velocity,
        "velocity_full": np.divide(capacity, full_area, out=np.zeros(P), where=full_area > 0),
        "pct_full": np.divide(q, capacity, out=np.zeros(P), where=capacity > 0), "hgl_up": hgl_up, "hgl_dn": hgl_dn, "surcharged": surcharged,
        "node_tc": tc, "hgl": hgl, "surcharge_to_surface": (kind != OUTFALL) & (hgl > rim),
    }


def with_hydraulics(analysis: Analysis) -> DataFrame:
    """Pipe results with regime, report_surcharged and status."""
    from culvert.functions import hydraulics as hy

    return analysis.pipes.withColumns(
        {
            "regime": hy.regime("normal_depth", "critical_depth"),
            "report_surcharged": hy.report_surcharged("surcharged", "slope"),
            "status": hy.capacity_label("surcharged", "slope"),
        }
    )


def peak_flow_pivot(pipes: DataFrame, periods: list[int] | None = None) -> DataFrame:
    """Peak flow of each pipe by return period, ascending: one column a period."""
    found = pipes.groupBy("network_id", "id").pivot("rp_years", periods) if periods else pipes.groupBy("network_id", "id").pivot("rp_years")
    return found.agg(F.max("design_q"))


def first_of(df: DataFrame, keys: list[str], order: Column | str) -> DataFrame:
    """The first row of each key by an order."""
    from pyspark.sql import Window as W

    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("_rank = 1").drop("_rank")
