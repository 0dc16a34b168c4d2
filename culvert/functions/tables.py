"""A table function for SQL: analyze_ssn, over a table of `.ssn` texts.

    SELECT * FROM analyze_ssn(TABLE(files) PARTITION BY network_id)

files has a column text with a whole network, and may have others. The texts of a partition are analysed
together, by operators.network on all of their rows, so larger partitions (PARTITION BY network_id % 64, or
none) take less time a network than one partition for each.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from culvert.operators import network
from culvert.schema import Options
from culvert.sinks.report import CLEAR, NODE_HEAD, PIPE_HEAD, TITLE
from culvert.sources import ssn
from culvert.sources.formats import Piece, SsnReader


#: Texts of a partition that are solved at a time.
TOGETHER = 1000


def _number(words: list[str], k: int) -> float | None:
    try:
        return None if "_" in words[k] else float(words[k])
    except (IndexError, ValueError):
        return None


def _problem(key: str, t: list[str]) -> str | None:
    """What is wrong with a line, in the words of sources.ssn."""
    if key not in ("NODE", *ssn.NEEDED):
        return f"unknown keyword {t[0]}"
    needed = ssn.NEEDED.get(key, ())
    if key == "NODE":
        if len(t) < 3:
            return "NODE needs an id and a kind"
        if (kind := t[2].lower()) not in ("inlet", "junction", "outfall"):
            return f"unknown node kind {kind}"
        needed = (3, 4, 5, 6) + ((7, 8) if kind != "outfall" else ()) + ((9,) if len(t) > 9 else ())
    if key == "PIPE" and len(t) < 4:
        return "PIPE needs an id and two nodes"
    for k in needed:
        if _number(t, k) is None:
            return f"missing value {k}" if k >= len(t) else f"{t[k]} is not a number"
    return None


def _rows(lines: list[tuple]) -> list[tuple]:
    """A network's lines as the rows that the solver takes: (tag, ord, id, s1, s2, numbers)."""
    curve, options = (120.0, 10.0, 0.8), {k: None if v is None else float(v) for k, v in vars(Options()).items()}
    nodes, pipes = [], []
    for number, key, t in lines:
        value = lambda k, t=t: _number(t, k)
        if key == "IDF":
            curve = tuple(map(value, (1, 2, 3)))
        elif key in ssn.SETTINGS:
            options[ssn.SETTINGS[key]] = value(1)
        elif key == "NODE":
            kind = t[2].lower()
            area, c = (0.0, 0.0) if kind == "outfall" else (value(7), value(8))
            late = value(9) if value(9) is not None else 0.0 if kind == "outfall" else 10.0
            nodes.append((2, number, t[1], kind, None, [value(5), value(6), area, c, late, value(3), value(4)]))
        elif key == "PIPE":
            pipes.append((3, number, t[1], t[2], t[3], [value(4), value(6), value(5), value(5), 0.0]))
    scenario = [*curve, *(options[k] for k in network.SCENARIO[3:11])]
    return [(0, 10, None, None, None, scenario), (1, 10, None, None, None, [options["bench_factor"], options["cf"]]), *nodes, *pipes]


def _table(rows: list[tuple]) -> pa.Table:
    """Rows (network, tag, ord, id, s1, s2, numbers), in order of network, tag and ord."""
    count = network.NUMBERS
    numbers = [[r[6][k] if k < len(r[6]) else None for r in rows] for k in range(count)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * count]
    columns = [*([r[k] for r in rows] for k in range(6)), *numbers]
    names = ["network_id", "tag", "ord", "id", "s1", "s2", *(f"v{k}" for k in range(count))]
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)


def _shown(value: float | None, digits: int, width: int, none: str = "null") -> str:
    """As Spark's format_string shows a number: halves of its shortest decimals go up."""
    text = none if value is None else str(Decimal(repr(value)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return text.rjust(width)


def _label(row: dict) -> str:
    return "N/A" if row["slope"] < -1e-6 else "SURCHARGED" if row["surcharged"] else "ok"


def report_text(pipes: list[dict], nodes: list[dict]) -> str:
    """The plain report of solved rows, as sinks.report.text_reports writes it."""
    cut = lambda s, n: (s or "")[:n].ljust(n)
    out = [TITLE + "\n\n" + PIPE_HEAD]
    for r in sorted(pipes, key=lambda r: r["ord"]):
        share = _shown(r["pct_full"] * 100.0, 1, 6) if r["capacity"] > 0 else "    --"
        cells = [*(cut(r[c], 8) for c in ("id", "from", "to")), _shown(r["design_q"], 2, 9), _shown(r["capacity"], 2, 9), share, _shown(r["velocity"], 2, 8)]
        cells += [_shown(r["normal_depth"], 3, 8, "full"), _shown(r["hgl_up"], 2, 9, "--"), _shown(r["hgl_dn"], 2, 9, "--"), _label(r)]
        out.append(" ".join(cells) + "\n")
    out.append("\n" + NODE_HEAD)
    for r in sorted(nodes, key=lambda r: r["ord"]):
        numbers = (r["tc"], r["rim"], r["hgl"], r["rim"] - r["hgl"])
        out.append(" ".join([cut(r["id"], 8), *(_shown(x, 2, 9) for x in numbers), "FLOODING" if r["surcharge_to_surface"] else "ok"]) + "\n")
    named = lambda rows, flag: ", ".join(r["id"] for r in sorted(rows, key=lambda r: (r["ord"], r["id"])) if r[flag])
    full, wet = named(pipes, "surcharged"), named(nodes, "surcharge_to_surface")
    found = (f"Surcharged pipes: {full}\n" if full else "") + (f"Structures flooding: {wet}\n" if wet else "")
    return "".join(out) + "\n" + (found or CLEAR + "\n")


def analyze_texts(texts: list[str | None]) -> Iterator[tuple[int | None, str]]:
    """(rp_years, report) of each `.ssn` text; (None, its first error) of one that has any."""
    errors: dict[int, str] = {}
    rows: list[tuple] = []
    for i, text in enumerate(texts):
        data = (text or "").encode()
        lines = [x for x in SsnReader({"path": ""}).lex(io.BytesIO(data), Piece("", 0, len(data))) if x[0]]
        wrong = ((number, _problem(key, words)) for number, key, words in lines)
        if first := next((x for x in wrong if x[1]), None):
            errors[i] = f"line {first[0]}: {first[1]}"
        else:
            rows += [(i, *row) for row in _rows(lines)]
    found: dict[str, dict[int, list[dict]]] = {"pipe": {}, "node": {}}
    for batch in network.solve_tables(_table(rows)) if rows else ():
        for row in batch.to_pylist():
            if row["kind"] == "error":
                errors[row["network_id"]] = row["id"]
            else:
                found[row["kind"]].setdefault(row["network_id"], []).append(row)
    for i in range(len(texts)):
        yield (None, f"error: {errors[i]}") if i in errors else (10, report_text(*(found[kind].get(i, []) for kind in ("pipe", "node"))))


@udtf
class AnalyzeSsn:
    """Reports of `.ssn` texts: the columns of PARTITION BY, rp_years and text; errors are rows too."""

    @staticmethod
    def analyze(files: AnalyzeArgument) -> AnalyzeResult:
        if not files.isTable:
            raise ValueError("analyze_ssn takes TABLE(...)")
        kinds = {f.name: f.dataType for f in files.dataType.fields}
        if not isinstance(kinds.get("text"), StringType):
            raise ValueError("analyze_ssn needs a table with a string column text")
        schema = StructType()
        for name, kind in kinds.items():
            if name == "network_id":
                schema = schema.add(name, kind)
        return AnalyzeResult(schema.add("rp_years", IntegerType()).add("text", StringType()))

    def __init__(self) -> None:
        self.leads: list[tuple] = []
        self.texts: list[str | None] = []

    def eval(self, row) -> Iterator[tuple]:
        known = row.asDict()
        self.leads.append((known["network_id"],) if "network_id" in known else ())
        self.texts.append(known["text"])
        if len(self.texts) >= TOGETHER:
            yield from self.terminate()

    def terminate(self) -> Iterator[tuple]:
        leads, texts = self.leads, self.texts
        self.leads, self.texts = [], []
        for lead, found in zip(leads, analyze_texts(texts), strict=True):
            yield (*lead, *found)


def register_tables(spark: SparkSession) -> None:
    spark.udtf.register("analyze_ssn", AnalyzeSsn)
