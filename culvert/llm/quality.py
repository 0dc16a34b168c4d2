"""Quality classifier: logistic regression on hashed word n-grams, fitted by FTRL-proximal steps.

Tokens are runs of letters and digits and runs of marks, case kept; features are hashed token
1-grams to n-grams with their relative frequencies as values. Two more features stand for any
2-gram, and any 3-gram, whose outer words are equal: words that are said again and again. Shards of a bounded sample of
labelled rows are fitted in parallel, each by follow-the-regularised-leader steps (McMahan and
others, 2013), and the shards' weights are averaged. A text's score is the logistic function of
one sparse dot product, over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from culvert.llm import words as wd
from culvert.llm.exchange import bounded_batches, packed, unpacked

#: Bits of the feature hash: 8 bytes a weight, 2 MB in all, whatever the input.
BITS = 18
#: Labelled rows that are fitted at most (in expectation: rows are chosen by a hash of their id).
MAX_LABELLED = 16_000
_SHARDS, _EPOCHS, _SCALE = 4, 4, 8.0
_ALPHA, _BETA, _L1, _L2 = 0.3, 1.0, 0.0005, 0.001
#: Features beside the hashed n-grams: words said again at once and after one other.
_AGAIN = 2


def size_of(bits: int) -> int:
    """The number of weights: n-gram cells, features beside them, and the intercept."""
    return (1 << bits) + _AGAIN + 1


def _features(column: pa.Array, orders: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature cells of all n-grams of a batch, the row of each, and the n-grams of each row."""
    buf, at = wd.text_buffer(column)
    starts, ends, bounds = wd.find_runs(buf, at)
    codes, row = wd.word_codes(buf, starts, ends), wd.owner(bounds)
    cells, rows = [], []
    for width in range(1, orders + 1):
        fits = wd.within_rows(bounds, width)
        cells.append((wd.window_codes(codes, width)[fits] >> np.uint64(64 - bits)).astype(np.int32))
        rows.append(row[: len(fits)][fits])
    letters = wd.ALNUM[wd.lowered(buf[starts])]
    for apart in (1, 2):
        again = np.flatnonzero((codes[apart:] == codes[:-apart]) & (row[apart:] == row[:-apart]) & letters[apart:])
        cells.append(np.full(len(again), (1 << bits) + apart - 1, np.int32))  # cells of their own
        rows.append(row[again])
    cells, rows = np.concatenate(cells), np.concatenate(rows)
    return cells, rows, np.bincount(rows, minlength=len(column))


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression; the last weight is the intercept."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - _L1, 0.0)
        return -shrunk / ((_BETA + np.sqrt(n)) / _ALPHA + _L2)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (_logistic(float(w @ x)) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / _ALPHA * w
        self.n[at] = n + g * g


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _fit(orders: int, bits: int):
    """One shard's examples to its weights."""

    def run(table: pa.Table) -> pa.Table:
        examples = []
        # The order of examples matters for the steps; it is fixed by the ids, not by arrival.
        table = table.sort_by([("id", "ascending"), ("y", "ascending")])
        for batch in table.to_batches(max_chunksize=200):
            cells, rows, n = _features(batch.column("text"), orders, bits)
            order = np.argsort(rows, kind="stable")
            cells, bounds = cells[order], np.concatenate([[0], np.cumsum(n)])
            for k, y in enumerate(batch.column("y").to_numpy()):
                at, count = np.unique(cells[bounds[k] : bounds[k + 1]], return_counts=True)
                examples.append((np.append(at, size_of(bits) - 1), np.append(_SCALE * count / max(1, n[k]), 1.0), float(y)))
        model = Ftrl(size_of(bits))
        for epoch in range(_EPOCHS):
            for k in np.random.default_rng(epoch).permutation(len(examples)):
                model.learn(*examples[k])
        return pa.table({"n": pa.array([len(examples)], pa.int64()), "weights": pa.array([packed(model.weights())], pa.binary())})

    return run


def fit(docs: DataFrame, labels: DataFrame, orders: int = 2, bits: int = BITS, max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """Weights from documents (doc_id, text) and labels (doc_id, quality 0/1), the intercept last.

    Rows with a null id or a label other than 0 and 1 are left out. With more than max_labelled
    labels, those with the smallest hashes of their doc_id are used, about that many. Several
    labels of one document, and several documents of one label, are examples each. Without any
    example all weights are 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    labels = labels.filter("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("y"))
    share = max_labelled / max(max_labelled, labels.count())
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = F.broadcast(labels.filter(place < share))  # about max_labelled rows of 12 bytes
    examples = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(chosen, "id")
    shards = examples.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(_SHARDS)))
    total, n = np.zeros(size_of(bits)), 0
    for row in shards.groupBy("shard").applyInArrow(_fit(orders, bits), "n bigint, weights binary").collect():  # one row a shard
        total, n = total + row.n * unpacked(row.weights, np.float64), n + row.n
    return total / max(1, n)


def _score(orders: int, bits: int, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            cells, rows, n = _features(batch.column("text"), orders, bits)
            sums = np.bincount(rows, weights=w[cells], minlength=len(n))
            score = _logistic(_SCALE * sums / np.maximum(n, 1) + w[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray, orders: int = 2) -> DataFrame:
    """All columns of docs (text, ...) with `score`: how likely quality 1 is, from 0 to 1.

    Texts of any length count whole. Null and empty texts get the intercept's score. A column of docs with the name score is
    replaced; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(weights)
    docs = docs.drop("score")
    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_score(orders, (len(weights) - _AGAIN - 1).bit_length() - 1, shared), schema)


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """crc32 of the id as text modulo `parts` is `part`; a null id counts as the empty text."""
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return crc % F.lit(parts) == F.lit(part)
