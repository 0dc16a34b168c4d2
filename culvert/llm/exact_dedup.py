"""Exact deduplication by Grace hashing.

Map tasks join equal contents of a batch, so a hot text leaves a task once per batch. Records are
then dealt to tasks by a hash of the content. A task keeps contents in an open-addressing table
that compares complete contents; when the table outgrows its memory, the task deals it and the
rest of its input to spill files by further hash bits and goes on with each file alone.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert.llm.exchange import bounded_batches, groups_for

#: Bytes of distinct content that a task holds before it spills, and bytes of text for each reduce task.
TABLE_BYTES, TASK_BYTES = 48 << 20, 48 << 20
FANOUT_BITS = 4
_BLANKS = b" \t\n\x0b\x0c\r"
_RECORD = "part bigint, sha binary, content binary, points bigint, id bigint, n bigint"


def better(a: tuple, b: tuple) -> tuple:
    """Of two (code points, id), the one to keep: more code points, then the smaller id, null last."""
    rank = lambda x: (-x[0], x[1] is None, x[1] or 0)
    return a if rank(a) <= rank(b) else b


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One record for each content of a batch, with the best row and the number of rows."""
    for batch in batches:
        text = batch.column("text").fill_null("")
        points, ids = pc.utf8_length(text).to_pylist(), batch.column("doc_id").to_pylist()
        found: dict[bytes, list] = {}
        for raw, p, i in zip(text.cast(pa.binary()), points, ids, strict=True):
            content = raw.as_py().translate(None, _BLANKS)
            if (seen := found.get(content)) is None:
                found[content] = [(p, i), 1]
            else:
                seen[0], seen[1] = better(seen[0], (p, i)), seen[1] + 1
        shas = [hashlib.sha256(c).digest() for c in found]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([int.from_bytes(s[:8], "little", signed=True) for s in shas], pa.int64()),
                pa.array(shas, pa.binary()),
                pa.array(found, pa.binary()),
                pa.array([v[0][0] for v in found.values()], pa.int64()),
                pa.array([v[0][1] for v in found.values()], pa.int64()),
                pa.array([v[1] for v in found.values()], pa.int64()),
            ],
            names=["part", "sha", "content", "points", "id", "n"],
        )


class ContentTable:
    """Open addressing with linear probing; an entry is [sha, content, (points, id), rows]."""

    def __init__(self) -> None:
        self.slots: list[list | None] = [None] * 1024
        self.used = self.held = 0

    def _slot(self, sha: bytes, content: bytes) -> int:
        mask = len(self.slots) - 1
        at = int.from_bytes(sha[8:16], "little") & mask
        while (entry := self.slots[at]) is not None and entry[1] != content:
            if entry[0] == sha:
                raise RuntimeError("two different texts have one SHA-256")
            at = (at + 1) & mask
        return at

    def add(self, sha: bytes, content: bytes, best: tuple, n: int) -> None:
        at = self._slot(sha, content)
        if (entry := self.slots[at]) is not None:
            entry[2], entry[3] = better(entry[2], best), entry[3] + n
            return
        self.slots[at] = [sha, content, best, n]
        self.used, self.held = self.used + 1, self.held + len(content) + 300
        if 3 * self.used > 2 * len(self.slots):
            entries = list(self)
            self.slots = [None] * (2 * len(self.slots))
            for e in entries:
                self.slots[self._slot(e[0], e[1])] = e

    def __iter__(self):
        return (e for e in self.slots if e is not None)


def grace(records: Iterator[tuple], limit: int, level: int = 0) -> Iterator[list]:
    """Entries with distinct contents of records (sha, content, best, rows), in bounded memory."""
    table = ContentTable()
    for record in records:
        table.add(*record)
        # 16 bytes of the hash are for the levels; two contents that share them are told apart in the table
        if table.held > limit and (level + 1) * FANOUT_BITS <= 128:
            break
    else:
        yield from table
        return
    bits = lambda sha: int.from_bytes(sha[16:], "little") >> (level * FANOUT_BITS) & ((1 << FANOUT_BITS) - 1)
    with tempfile.TemporaryDirectory(prefix="culvert-grace-") as folder:
        files = [open(f"{folder}/{k}", "w+b") for k in range(1 << FANOUT_BITS)]  # noqa: SIM115
        try:
            for entry in table:
                pickle.dump(tuple(entry), files[bits(entry[0])])
            del table
            for record in records:
                pickle.dump(tuple(record), files[bits(record[0])])
            for k, f in enumerate(files):
                f.seek(0)
                yield from grace(_stored(f), limit, level + 1)
                f.close()
                files[k].close()
        finally:
            for f in files:
                f.close()


def _stored(f) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _groups(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for batch in batches:
                cols = [batch.column(c) for c in ("sha", "content", "points", "id", "n")]
                for sha, content, points, i, n in zip(*cols, strict=True):
                    yield sha.as_py(), content.as_py(), (points.as_py(), i.as_py()), n.as_py()

        out: list[tuple] = []
        for sha, _, best, n in grace(stream(), limit):
            out.append((sha.hex(), best[1], n))
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["text_sha256", "keep_id", "group_size"])


def text_key(text: str = "text"):
    """Lowercase hex SHA-256 of a text without blanks `[\\x20\\x09-\\x0D]`."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]", ""), 256)


def content_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each distinct content: text_sha256, keep_id, group_size."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    n = groups_for(docs, "text", TASK_BYTES)
    records = docs.mapInArrow(_records, _RECORD)
    return records.repartition(n, "part").mapInArrow(_groups(table_bytes), "text_sha256 string, keep_id bigint, group_size bigint")


def exact_dedup(docs: DataFrame, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """All columns of docs (doc_id, text, ...) and keep_id, group_size, kept, text_sha256.

    Texts are equal when equal without blanks; null counts as empty. Of equal texts the row with
    the most code points stays, then the smallest doc_id; a null doc_id ranks last. Rows of one
    doc_id with equal texts (repeated, or different in blanks alone) each count in group_size and are
    kept or dropped together. Contents of any length are compared whole. An empty table gives an
    empty table. Columns of docs with the names of results are replaced.
    """
    results = ("keep_id", "group_size", "kept", "text_sha256")
    keyed = docs.drop(*results).withColumn("text_sha256", text_key())
    # The groups have one row a key; Spark's skew join splits the rows of a hot key.
    joined = keyed.join(content_groups(docs, table_bytes), "text_sha256")
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
