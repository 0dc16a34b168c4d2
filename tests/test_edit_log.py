import random
import re

from culvert.operators.edit_log import EDITS, apply_edits, in_rounds
from culvert.operators.editing import NEW_NODE
from culvert.schema import CATCHMENTS, NODES, PIPES


class Plain:
    """A network's edits one after the other."""

    def __init__(self, nodes, pipes, catchments):
        self.nodes, self.pipes, self.catchments, self.rejected = nodes, pipes, catchments, []

    def next(self, rows, prefix):
        return f"{prefix}{max([int(m[1]) for r in rows if (m := re.fullmatch(prefix + '([0-9]+)', r['id']))], default=0) + 1}"

    def add(self, rows, row):
        rows.append(row | {"ord": max([r["ord"] for r in rows], default=0) + 1})

    def of(self, rows, id_):
        return next((r for r in rows if r["id"] == id_), None)

    def length(self, p):
        a, b = self.of(self.nodes, p["from"]), self.of(self.nodes, p["to"])
        return max(1.0, ((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2) ** 0.5) if a and b else p["length"]

    def sync(self):
        for p in self.pipes:
            p["length"] = self.length(p)

    def apply(self, e):
        if reason := getattr(self, e["op"])(e):
            self.rejected.append((e["seq"], e["op"], reason))

    def place_structure(self, e):
        if e["a"] not in ("inlet", "junction", "outfall"):
            return "unknown kind"
        if e["id"] and self.of(self.nodes, e["id"]):
            return "this id is taken"
        row = NEW_NODE | ({"area_ac": 0.0, "c": 0.0, "tc_inlet": 0.0} if e["a"] == "outfall" else {})
        self.add(self.nodes, row | {"id": e["id"] or self.next(self.nodes, "N"), "kind": e["a"], "x": e["x"], "y": e["y"]})

    def place_pipe(self, e):
        a, b = self.of(self.nodes, e["a"]), self.of(self.nodes, e["b"])
        if e["a"] == e["b"]:
            return "a pipe needs two nodes"
        if not a or not b:
            return "unknown node"
        if any((p["from"], p["to"]) == (e["a"], e["b"]) for p in self.pipes):
            return "these nodes have a pipe"
        if e["id"] and self.of(self.pipes, e["id"]):
            return "this id is taken"
        d = e["value"] or 1.5
        row = {"id": e["id"] or self.next(self.pipes, "P"), "from": e["a"], "to": e["b"], "length": 0.0, "diameter": d, "n": 0.013, "shape": "circular", "rise": d, "span": d}
        self.add(self.pipes, row | {"length": self.length(row)})

    def move_node(self, e):
        if not (n := self.of(self.nodes, e["id"])):
            return "unknown node"
        n.update(x=e["x"], y=e["y"])
        self.sync()

    def set_kind(self, e):
        if not (n := self.of(self.nodes, e["id"])):
            return "unknown node"
        n["kind"] = e["a"]

    def set_tc(self, e):
        if not (n := self.of(self.nodes, e["id"])):
            return "unknown node"
        n["tc_inlet"] = e["value"]

    def set_diameter(self, e):
        for p in self.pipes:
            if (p["shape"] or "circular") == "circular":
                p.update(diameter=e["value"], rise=e["value"], span=e["value"])

    def set_roughness(self, e):
        for p in self.pipes:
            p["n"] = e["value"]

    def reverse_pipe(self, e):
        if not (p := self.of(self.pipes, e["id"])):
            return "unknown pipe"
        p["from"], p["to"] = p["to"], p["from"]

    def delete_pipe(self, e):
        if not (p := self.of(self.pipes, e["id"])):
            return "unknown pipe"
        self.pipes.remove(p)

    def delete_node(self, e):
        if not (n := self.of(self.nodes, e["id"])):
            return "unknown node"
        self.nodes.remove(n)
        self.pipes = [p for p in self.pipes if e["id"] not in (p["from"], p["to"])]

    def merge_node(self, e):
        if not (n := self.of(self.nodes, e["id"])) or not self.of(self.nodes, e["a"]):
            return "unknown node"
        if e["id"] == e["a"]:
            return "a node cannot be merged with itself"
        self.nodes.remove(n)
        kept, seen = [], set()
        for p in self.pipes:
            p["from"], p["to"] = (e["a"] if x == e["id"] else x for x in (p["from"], p["to"]))
            if p["from"] != p["to"] and (p["from"], p["to"]) not in seen:
                seen.add((p["from"], p["to"]))
                kept.append(p)
        self.pipes = kept
        for c in self.catchments:
            c["inlet"] = e["a"] if c["inlet"] == e["id"] else c["inlet"]

    def split_pipe(self, e):
        if not (p := self.of(self.pipes, e["id"])):
            return "unknown pipe"
        a, b = self.of(self.nodes, p["from"]), self.of(self.nodes, p["to"])
        if not a or not b:
            return "unknown node"
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        t = min(1.0, max(0.0, ((e["x"] - a["x"]) * dx + (e["y"] - a["y"]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        new = self.next(self.nodes, "N")
        mid = {"id": new, "kind": "junction", "x": a["x"] + t * dx, "y": a["y"] + t * dy, "area_ac": 0.0, "c": 0.0, "tc_inlet": 10.0}
        self.add(self.nodes, mid | {k: a[k] + t * (b[k] - a[k]) for k in ("invert", "rim")})
        self.add(self.pipes, p | {"id": self.next(self.pipes, "P"), "from": new})
        p["to"] = new
        self.sync()

    def duplicate_node(self, e):
        if not (n := self.of(self.nodes, e["id"])):
            return "unknown node"
        self.add(self.nodes, n | {"id": self.next(self.nodes, "N"), "x": n["x"] + 20.0, "y": n["y"] - 20.0})

    def relink_catchment(self, e):
        if not (c := next((c for c in self.catchments if c["ord"] == int(e["value"])), None)):
            return "unknown catchment"
        n = self.of(self.nodes, e["a"])
        if e["a"] is not None and not (n and n["kind"] == "inlet"):
            return "no such inlet"
        c["inlet"] = e["a"]

    def delete_catchment(self, e):
        if not (c := next((c for c in self.catchments if c["ord"] == int(e["value"])), None)):
            return "unknown catchment"
        self.catchments.remove(c)


OPS = [
    "place_structure", "place_structure", "place_pipe", "place_pipe", "move_node", "set_kind", "set_tc", "set_diameter", "set_roughness", "reverse_pipe", "delete_pipe", "delete_node", "merge_node", "split_pipe",
    "duplicate_node", "relink_catchment", "delete_catchment",
]
OWN = {"id": None, "a": None, "b": None, "x": None, "y": None, "value": None}


def some_edit(rng, seq):
    node = lambda: rng.choice(["N1", "N2", "N3", "N4", "N5", "A", "B", "Q"])
    pipe, at = f"P{rng.randrange(1, 8)}", {"x": float(rng.randrange(9)), "y": float(rng.randrange(9))}
    op = rng.choice(OPS)
    given = {
        "place_structure": {"id": rng.choice([None, None, "A", "N7"]), "a": rng.choice(["inlet", "outfall", "junction", "pond"]), **at}, "place_pipe": {"id": rng.choice([None, None, pipe]), "a": node(), "b": node(), "value": rng.choice([None, 2.0])},
        "move_node": {"id": node(), **at}, "set_kind": {"id": node(), "a": rng.choice(["inlet", "junction"])}, "set_tc": {"id": node(), "value": float(rng.randrange(40))}, "set_diameter": {"value": rng.choice([1.0, 3.0])},
        "set_roughness": {"value": rng.choice([0.011, 0.015])}, "reverse_pipe": {"id": pipe}, "delete_pipe": {"id": pipe}, "delete_node": {"id": node()}, "merge_node": {"id": node(), "a": node()}, "split_pipe": {"id": pipe, **at},
        "duplicate_node": {"id": node()}, "relink_catchment": {"value": float(rng.randrange(1, 4)), "a": rng.choice([None, node()])}, "delete_catchment": {"value": float(rng.randrange(1, 4))},
    }
    return {"seq": seq, "op": op, **OWN, **given[op]}


def network(rng):
    nodes = [{"ord": k, "id": f"N{k}", "kind": "inlet", "invert": 100.0 + k, "rim": 110.0, "area_ac": 1.0, "c": 0.5, "tc_inlet": 10.0, "x": float(rng.randrange(9)), "y": float(rng.randrange(9))} for k in range(1, 5)]
    nodes.append(nodes[0] | {"ord": 5, "id": "B", "kind": "outfall"})
    pipes = []
    for k, (a, b) in enumerate((("N1", "N2"), ("N2", "N3"), ("N4", "N3"), ("N3", "B")), 1):
        box = {"shape": "rectangular", "rise": 2.0, "span": 4.0} if k == 2 else {"shape": "circular", "rise": 1.0, "span": 1.0}
        pipes.append({"ord": k, "id": f"P{k}", "from": a, "to": b, "length": 50.0, "diameter": 1.0, "n": 0.013, **box})
    catchments = [{"ord": k, "id": f"C{k}", "vertices": None, "c": 0.5, "slope": 0.01, "flow_length_ft": 10.0, "inlet": rng.choice([None, "N1", "N2"])} for k in (1, 2)]
    return nodes, pipes, catchments


def table(spark, rows, schema):
    names = [c.strip().split()[0].strip("`") for c in re.split(r",(?![^<]*>)", schema)]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)


def shown(rows):
    return sorted(repr(sorted((k, round(v, 6) if isinstance(v, float) else v) for k, v in r.items() if k != "vertices")) for r in rows)


def test_logs_against_one_edit_after_the_other(spark):
    rng = random.Random(12)
    nets = {i: network(rng) for i in range(1, 31)}
    logs = {i: [some_edit(rng, 10 * k) for k in range(rng.choice([0, 1, 3]))] for i in nets}
    every = lambda kind: [r | {"network_id": i} for i, net in nets.items() for r in net[kind]]
    frames = [table(spark, every(k), schema) for k, schema in enumerate((NODES, PIPES, CATCHMENTS))]
    edits = table(spark, [e | {"network_id": i} for i, log in logs.items() for e in log], EDITS)
    done = apply_edits(*frames, edits.repartition(3))
    first = apply_edits(*frames, edits, upto=0)
    for result, upto in ((done, 10**6), (first, 0)):
        plain = {i: Plain(*([dict(r) for r in rows] for rows in nets[i])) for i in nets}
        for i, log in logs.items():
            for e in log:
                if e["seq"] <= upto:
                    plain[i].apply(e)
        for name in ("nodes", "pipes", "catchments"):
            assert shown(r.asDict() for r in getattr(result, name).collect()) == shown(r | {"network_id": i} for i, p in plain.items() for r in getattr(p, name)), name
        assert sorted((r.network_id, r.seq, r.op, r.reason) for r in result.rejected.collect()) == sorted((i, *r) for i, p in plain.items() for r in p.rejected)
        assert {r.network_id: r.version for r in result.version.collect()} == {i: max(e["seq"] for e in log if e["seq"] <= upto) for i, log in logs.items() if log}


def test_odd_logs(spark):
    rng = random.Random(1)
    frames = [table(spark, [r | {"network_id": 1} for r in rows], schema) for rows, schema in zip(network(rng), (NODES, PIPES, CATCHMENTS), strict=True)]
    rows = [(1, 1, "set_tc", "N1", 5.0), (1, 1, "set_tc", "N1", 6.0), (1, None, "set_tc", "N1", 7.0), (1, 2, "paint", "N1", 8.0), (1, 3, None, "N1", 8.0), (9, 1, "delete_node", "N1", None)]
    edits = spark.createDataFrame(rows, "network_id bigint, seq int, op string, id string, value double").selectExpr("*", *[f"cast(null as {t}) as {c}" for c, t in (("a", "string"), ("b", "string"), ("x", "double"), ("y", "double"))])
    done = apply_edits(*frames, edits)
    assert shown(r.asDict() for r in done.nodes.collect()) == shown(r.asDict() for r in frames[0].collect())
    assert sorted(r.reason for r in done.rejected.collect()) == ["no place in the order"] * 3 + ["unknown edit"] * 2 + ["unknown node"]
    none = apply_edits(*frames, edits.limit(0))
    assert none.pipes.count() == 4 and none.rejected.count() == 0 and none.version.count() == 0


def test_rounds(spark):
    ops = ["set_tc", "move_node", "place_pipe", "place_pipe", "merge_node", "merge_node", "delete_pipe", "delete_node", "delete_node"]
    edits = spark.createDataFrame([(1, k, op) for k, op in enumerate(ops)] + [(2, 0, "set_tc")], "network_id bigint, seq int, op string")
    assert [r["round"] for r in in_rounds(edits).orderBy("network_id", "seq").collect()] == [1, 1, 2, 2, 3, 4, 5, 6, 6, 1]
