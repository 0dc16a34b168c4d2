"""Helpers to size, split, pack and deal what operators shuffle.

Python operators send packed entries: a row holds many entries of one group, a column of numbers in
one binary cell. A sender has about as many entries whatever the table's size, while the groups grow
with the table, so a row for each sender and group would shrink to an entry. `entry_rows` therefore
makes at most FANOUT rows, one for each band of groups, and `dealt` deals bands to groups in a second
step where there are more groups than that: rows stay large, at one more shuffle of the entries.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside tasks: nulls rank after every number.
NO_ID = np.iinfo(np.int64).max
#: Rows in an Arrow batch. Spark's 10,000 whole texts at a time need much memory in small workers.
BATCH_ROWS = 1000
#: Rows that one sender makes at most: bands of groups.
FANOUT = 4096


def bounded_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch, unless the session or its context has a number of its own,
    10,000 included. Spark reads it when a frame runs, so it stays set for the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share.

    That is spark.checkpoint.dir. Where it is unset a local folder is set if all tasks run on this
    machine (a local master); on a cluster that is an error, as executors could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "culvert-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Where written() notes the tables of the settled() call that runs.
_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def written(df: DataFrame, **options: str) -> DataFrame:
    """The frame written as Parquet in the shared folder and read again: a cut of the lineage that
    every executor can read, whichever are lost. The table stays until its owner deletes it; see
    settled()."""
    spark = df.sparkSession
    path = shared_dir(spark)
    if (tables := _tables.get()) is not None:
        tables.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes a table that written() made, by the file system that Spark writes it with."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Lets go of frames that are done with, so that Spark removes their shuffle files now: it does so
    when the driver's memory is collected, which a large driver may put off for long."""
    gc.collect()
    spark._jvm.System.gc()


def settled(make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
    """The frame of make(), written, with its path. All other tables that make() wrote on the way are
    deleted then: the result needs them no more, whichever executors are lost."""
    token = _tables.set(tables := [])
    try:
        result = written(make())
    finally:
        _tables.reset(token)
    for path in tables[:-1]:
        deleted(result.sparkSession, path)
    released(result.sparkSession)
    return result, tables[-1]


def groups_for(df: DataFrame, column: str, *group_bytes: int):
    """How many groups hold about group_bytes of a text column each, for each size given; odd, so
    that it shares no factor with ids that step by an even number."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    counts = tuple(int(total // size + 1) | 1 for size in group_bytes)
    return counts if len(counts) > 1 else counts[0]


def bucket_of(codes: np.ndarray, n: int) -> np.ndarray:
    """Deals 64-bit codes to n buckets; ascending codes give ascending buckets."""
    return ((codes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def slices(sorted_keys: np.ndarray):
    """(key, from, to) of each run of equal keys."""
    if len(sorted_keys):
        cuts = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sorted_keys)], strict=True):
            yield int(sorted_keys[a]), a, b


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal sorted keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def packed(values: np.ndarray) -> bytes:
    """Fixed-width numbers with all first bytes, then all second bytes and so on: the shuffle's
    compression then removes the bytes that barely change."""
    values = np.ascontiguousarray(values)
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def unpacked(blob: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(blob, np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def unpacked_all(column, dtype) -> np.ndarray:
    parts = [unpacked(x.as_buffer(), dtype) for x in column]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


class Groups(NamedTuple):
    """How many groups entries are dealt to, and how many of them make a band."""

    n: int
    width: int


def groups(n: int) -> Groups:
    return Groups(n, -(-n // FANOUT))


def entry_rows(group: np.ndarray, to: Groups, *columns: np.ndarray) -> pa.Table:
    """Entries (parallel columns of numbers) and their groups as packed rows, one for each band."""
    group = group.astype(np.int64)
    return _packed_rows(group // to.width, group, columns)


def _packed_rows(key: np.ndarray, group: np.ndarray, columns) -> pa.Table:
    order = np.argsort(key, kind="stable")
    key, columns = key[order], [np.ascontiguousarray(c)[order] for c in (group, *columns)]
    cuts = list(slices(key))
    blobs = [pa.array([packed(c[i:j]) for _, i, j in cuts], pa.binary()) for c in columns]
    names = ["band", "groups", *(f"c{k}" for k in range(len(columns) - 1))]
    return pa.Table.from_arrays([pa.array([k for k, _, _ in cuts], pa.int64()), *blobs], names=names)


def entry_schema(columns: int) -> str:
    return "band bigint, groups binary" + "".join(f", c{k} binary" for k in range(columns))


def entries_of(table: pa.Table, *kinds) -> list[np.ndarray]:
    """The columns of entry_rows() of some rows, one after the other."""
    return [unpacked_all(table.column(f"c{k}"), kind) for k, kind in enumerate(kinds)]


def dealt(rows: DataFrame, to: Groups, *kinds) -> DataFrame:
    """Rows of entry_rows() with columns of these kinds, so that `band` is the group.

    Up to FANOUT groups they are that already. Beyond, the rows of a band are shared out to as many
    tasks as the band has groups, and each task deals its entries to the groups.
    """
    if to.width == 1:
        return rows

    def run(table: pa.Table) -> pa.Table:
        group = unpacked_all(table.column("groups"), np.int64)
        return _packed_rows(group, group, entries_of(table, *kinds))

    part = F.pmod(F.xxhash64("groups", "c0"), F.lit(to.width)).alias("part")
    return rows.groupBy("band", part).applyInArrow(run, entry_schema(len(kinds)))


#: A key with fewer rows than this is never hot; a key with more than a ten-thousandth of all rows
#: is, so that there are at most 10,000 hot keys.
_WARM, _HOT_SHARE = 1000, 10_000


def hot_limit(total: int) -> int:
    return max(_WARM, total // _HOT_SHARE)


def join_hot(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """left joined with right, which has one row a key and in `rows` how many rows of left have it.

    Rows of hot keys, at most 10,000, are broadcast and meet left where it stands, so that no key
    gathers more than its share in one task; the others are joined by a shuffle.
    """
    limit = hot_limit(left.count())
    hot = F.broadcast(right.filter(F.col(rows) > limit).drop(rows))
    cold = right.filter(F.col(rows) <= limit).drop(rows)
    others = left.join(hot.select(key), key, "left_anti")
    return left.join(hot, key).unionByName(others.join(cold, key))
