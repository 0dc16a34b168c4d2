"""Compression of vectors by product codes: four parts a vector, a codebook of 256 entries a part.

Codebooks are integers and small (4 x 256 entries of a quarter of a vector each), so they travel with
the tasks. Every round, Arrow batches hold all parts against all entries by norms and one matrix
product a part, and each task adds up the parts of each entry; those sums are merged by a grouped
shuffle into the next codebooks. All arithmetic is on integers and exact, whatever the order of rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from culvert.llm.exchange import join_hot, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Products of a batch at a time: rows x 256 entries of eight bytes.
BLOCK_ROWS = 8192
#: Whole numbers up to here are exact in float64, and so are sums of products that stay below it.
_EXACT = 1 << 53
_MOST = (1 << 63) - 1


def largest_component(dims: int) -> int:
    """Integer components are held to this in size, so that no squared distance passes 64 bits."""
    return math.isqrt(_MOST // dims) // 2


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose vector has no null and only finite components (true), each row's length, and the
    components of all rows as float64, one after the other."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid())
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    items = column.flatten().cast(pa.float64())  # of rows that are not null
    bad = np.asarray(items.is_null()).copy()
    values = np.asarray(items.fill_null(0.0), dtype=np.float64)
    bad |= ~np.isfinite(values)
    ends = np.cumsum(sizes)
    n_bad = np.concatenate([[0], np.cumsum(bad)])
    return valid & (n_bad[ends] == n_bad[ends - sizes]), sizes, values


def integers(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept (whole, of `dims` components) and their integer components, a row each."""
    whole, sizes, values = whole_vectors(column)
    kept = whole & (sizes == dims)
    most = float(largest_component(dims))
    chosen = values[np.repeat(kept, sizes)].reshape(-1, dims)
    return kept, np.clip(np.floor(chosen * SCALE), -most, most).astype(np.int64)


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the first nearest entry and the squared distance to it, exactly:
    |x - c|^2 = |x|^2 - 2 x.c + |c|^2 in 64-bit integers. The product is taken in float64, which is
    faster, where all of its sums are whole numbers below 2^53; else in integers."""
    size = int(max(np.abs(part).max(initial=0), np.abs(entries).max(initial=0)))
    best, error = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    norms = (entries * entries).sum(axis=1)
    in_floats = size * size * part.shape[1] < _EXACT
    turned = np.ascontiguousarray(entries.T, np.float64 if in_floats else np.int64)
    for lo in range(0, len(part), BLOCK_ROWS):
        x = part[lo : lo + BLOCK_ROWS]
        products = (x.astype(np.float64) @ turned).astype(np.int64) if in_floats else x @ turned
        apart = norms - 2 * products
        found = apart.argmin(axis=1)
        best[lo : lo + len(x)] = found
        error[lo : lo + len(x)] = apart[np.arange(len(x)), found] + (x * x).sum(axis=1)
    return best, error


def _parts(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), PARTS, x.shape[1] // PARTS).transpose(1, 0, 2)


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(length, n) of the whole vectors of a task whose length parts can share."""
    counts: Counter[int] = Counter()
    for batch in batches:
        whole, sizes, _ = whole_vectors(batch.column("vector"))
        counts.update(sizes[whole & (sizes > 0) & (sizes % PARTS == 0)].tolist())
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["length", "n"])


def _smallest(dims: int):
    """The rows of a batch that can be among the ENTRIES smallest ids: a row more than those is
    let through only where its id equals the last of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, values = integers(batch.column("vector"), dims)
            ids = batch.column("vec_id").filter(pa.array(kept))
            rank = np.asarray(ids.fill_null(_MOST), dtype=np.int64)
            if len(rank) > ENTRIES:
                least = rank <= np.partition(rank, ENTRIES - 1)[ENTRIES - 1]
                ids, values = ids.filter(pa.array(least)), values[least]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * dims), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["vec_id", "x"])

    return run


def _sums(books: np.ndarray, dims: int):
    """(slot, at, total) of a task: for each entry in use the sum of its parts by position, and their
    number at position -1. slot is part x ENTRIES + entry."""
    width = dims // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((PARTS * ENTRIES, width + 1), np.int64)
        for batch in batches:
            _, values = integers(batch.column("vector"), dims)
            for p, part in enumerate(_parts(values)):
                best, _ = nearest(part, books[p])
                order = np.argsort(best, kind="stable")
                used, first = np.unique(best[order], return_index=True)
                if len(used):
                    totals[p * ENTRIES + used, 1:] += np.add.reduceat(part[order], first, axis=0)
                    totals[p * ENTRIES + used, 0] += np.diff([*first, len(order)])
        used = np.flatnonzero(totals[:, 0])
        columns = [np.repeat(used, width + 1), np.tile(np.arange(-1, width), len(used)), totals[used].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["slot", "at", "total"])

    return run


def _codes(books: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, values = integers(batch.column("vector"), dims)
            codes, error = np.empty((len(values), PARTS), np.uint8), np.zeros(len(values), np.int64)
            for p, part in enumerate(_parts(values)):
                best, apart = nearest(part, books[p])
                codes[:, p] = best
                error += apart
            rows = pa.array(kept)
            texts = codes.tobytes().hex()
            step = 2 * PARTS
            code = pa.array([texts[i : i + step] for i in range(0, len(texts), step)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").filter(rows), batch.column("label").filter(rows), code, pa.array(error)], names=["vec_id", "label", "code", "error"]
            )

    return run


def train(rows: DataFrame) -> tuple[list[np.ndarray], int]:
    """The codebooks of rows (vec_id, vector), an array of entries for each part, and the number of
    components of a vector; ([], 0) without vectors. What comes to the driver is of the size of the
    codebooks: the first 256 vectors, then a sum for each entry."""
    lengths = rows.mapInArrow(_lengths, "length bigint, n bigint").groupBy("length").agg(F.sum("n").alias("n"))
    if (most := lengths.orderBy(F.desc("n"), "length").first()) is None:
        return [], 0
    dims = most["length"]
    first = rows.mapInArrow(_smallest(dims), "vec_id bigint, x array<bigint>").orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES)
    books = list(_parts(np.array([r.x for r in first.collect()], np.int64)).copy())
    for _ in range(ROUNDS):
        sums = rows.mapInArrow(_sums(books, dims), "slot bigint, at bigint, total bigint")
        totals = np.zeros((PARTS * ENTRIES, dims // PARTS + 1), np.int64)
        for r in sums.groupBy("slot", "at").agg(F.sum("total").alias("total")).collect():
            totals[r.slot, r.at + 1] = r.total
        for p, book in enumerate(books):
            own = totals[p * ENTRIES : p * ENTRIES + len(book)]
            used = own[:, 0] > 0
            book[used] = own[used, 1:] // own[used, :1]
    return books, dims


def books_sha256(books: list[np.ndarray]) -> str:
    """Of all entries' components as decimals, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for v in book.ravel().tolist()).encode()).hexdigest()


def _label_key(label: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), label.cast("string")), F.lit(""))


def vector_codes(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """Codes of embeddings (vec_id, vector, label): vec_id, code (an index of two hex digits for each
    of the four parts), error (squared distance to the coded vector), label_error (errors summed over
    equal labels, nulls together), codebooks_sha256, label.

    A component x becomes floor(1024 x), held to +-largest_component(length) (185,363 for x where
    vectors have 64 components). Codebooks start as the parts of the 256 smallest vec_ids, nulls last
    and repeated ids by their components; four rounds of assignment (ties to the lower index) and
    floored means follow; an unused entry stays. With fewer vectors there are fewer entries.

    Left out: rows whose vector is null or has null or non-finite components, and rows whose
    vector cannot be cut like the others: of another length than most kept vectors have (ties: the
    shorter), which is a multiple of four above zero. Repeated rows each get a row; a table without
    vectors gives none. A label_error beyond 64 bits is the largest of them. Other columns are
    ignored, whatever their names.
    """
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).alias("vector"), F.col("label").alias("label"))
    rows = rows.filter("vector IS NOT NULL")
    kind = rows.schema["label"].dataType.simpleString()
    books, dims = train(rows.drop("label"))
    schema = f"vec_id bigint, label {kind}, code string, error bigint"
    made = rows.mapInArrow(_codes(books, dims), schema) if dims else rows.sparkSession.createDataFrame([], schema)
    found = written(made.withColumn("key", _label_key(F.col("label"))))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(_MOST))).cast("bigint")
    sums = found.groupBy("key").agg(F.count("*").alias("n"), total.alias("label_error"))
    joined = join_hot(found, sums, "key", "n")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"), "label")
