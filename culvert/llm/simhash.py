"""SimHash near-duplicates by a Gray-order hierarchical index.

Distinct fingerprints are sorted by their rank in the Gray code, so that neighbours share most bits,
and cut into blocks. A node of the index holds the bits that all fingerprints under it share and
their pattern; blocks are the leaves of a tree whose upper nodes factor what their children share.
The index meets itself from the root down: of each pair of nodes that is still open, the pairs of
children are kept whose shared bits differ in at most `distance` places, adding to the differences
found above only those at bits that the parents did not share. Inside a block the same goes on with
smaller runs, down to fingerprints. At one depth a run meets at most the runs whose common leading
bits differ from its own in `distance` places (2,081 for 64 bits and two), however the fingerprints
lie; so work is in proportion to the fingerprints, also inside a dense family.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from culvert.llm.components import components
from culvert.llm.exchange import bounded_batches, join_hot, written
from culvert.llm.words import SPACED, find_words, lowered, text_buffer

#: Fingerprints in a block, blocks (or nodes) in a node, and parts of a run inside a block.
BLOCK, FAN, SPLIT = 4096, 64, 8
#: Words hashed at a time, and pairs of runs opened at a time.
WORDS, OPEN = 100_000, 8192
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one space after each, and where each begins and ends there."""
    sizes = ends - starts
    new_ends = np.cumsum(sizes + 1) - 1
    new_starts = new_ends - sizes
    out = np.full(int(new_ends[-1]) + 1 if len(sizes) else 0, 0x20, np.uint8)
    shift = np.repeat(starts - new_starts, sizes)
    at = np.arange(len(shift)) + np.repeat(np.arange(len(sizes)), sizes)
    out[at] = buf[at + shift]
    return out.tobytes(), new_starts, new_ends


def fingerprints(column: pa.Array, width: int, seed: int) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is set where more than half of the hashes of its
    `width`-word shingles, repeats included, have it; zero without words."""
    buf, at = text_buffer(column)
    buf = lowered(buf)
    starts, ends, bounds = find_words(buf, at, SPACED)
    n_words = np.diff(bounds)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    # Shingle k of a row begins at its word k and ends `width` words on, or with the row.
    first = np.repeat(bounds[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    row = np.repeat(np.arange(len(n)), n)
    last = np.minimum(first + width, bounds[1:][row]) - 1
    counts = np.zeros((len(n), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(first), WORDS):
        f, e, r = first[lo : lo + WORDS], last[lo : lo + WORDS], row[lo : lo + WORDS]
        a = f[0]
        text, s, t = _joined(buf, starts[a : e[-1] + 1], ends[a : e[-1] + 1])
        hashes = np.array([digest(text[i:j], seed) for i, j in zip(s[f - a].tolist(), t[e - a].tolist(), strict=True)], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        counts[r[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _fingerprint(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = fingerprints(batch.column("text"), width, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "code"])

    return run


def gray_rank(code: Column) -> Column:
    """The place of a 64-bit code in the Gray sequence, as a signed number of the same order."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a sorted partition: part, seq, low (bits that all members have), high (bits that
    any has), members."""
    from pyspark import TaskContext

    part, seq, held = TaskContext.get().partitionId(), 0, np.empty(0, np.int64)

    def row(codes: np.ndarray) -> pa.RecordBatch:
        low, high = np.bitwise_and.reduce(codes), np.bitwise_or.reduce(codes)
        cells = [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([low]), pa.array([high]), pa.array([codes.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(cells, names=["part", "seq", "low", "high", "members"])

    for batch in batches:
        held = np.concatenate([held, np.asarray(batch.column("code"), dtype=np.int64)])
        while len(held) >= BLOCK:
            yield row(held[:BLOCK])
            held, seq = held[BLOCK:], seq + 1
    if len(held):
        yield row(held)


def _shared(node: str) -> Column:
    """The bits that all fingerprints under a node share."""
    return F.bitwise_not(F.col(f"{node}.low").bitwiseXOR(F.col(f"{node}.high")))


def open_pairs(blocks: DataFrame, parts: int, distance: int) -> DataFrame:
    """(a, b) of the pairs of blocks, each once, that the index cannot tell to be further apart."""
    key = F.col("part") * (1 << 32) + F.col("seq")
    levels = [blocks.select(key.alias("id"), F.col("part").alias("parent"), "low", "high")]
    grouped = blocks.groupBy("part").agg(F.bit_and("low").alias("low"), F.bit_or("high").alias("high"))
    levels.append(grouped.select(F.col("part").alias("id"), F.floor(F.col("part") / FAN).alias("parent"), "low", "high"))
    width = FAN
    while width < parts:
        up = levels[-1].groupBy("parent").agg(F.bit_and("low").alias("low"), F.bit_or("high").alias("high"))
        levels.append(up.select(F.col("parent").alias("id"), F.floor(F.col("parent") / FAN).alias("parent"), "low", "high"))
        width *= FAN
    pairs = blocks.sparkSession.createDataFrame([(0, 0, 0, 0)], "a bigint, b bigint, known bigint, apart int")
    for nodes in reversed(levels):
        down = pairs.join(nodes.alias("x"), F.col("a") == F.col("x.parent")).join(nodes.alias("y"), F.col("b") == F.col("y.parent"))
        known = _shared("x").bitwiseAND(_shared("y"))
        new = F.col("x.low").bitwiseXOR(F.col("y.low")).bitwiseAND(known).bitwiseAND(F.bitwise_not("known"))
        apart = F.col("apart") + F.bit_count(new)
        down = down.filter((F.col("x.id") <= F.col("y.id")) & (apart <= distance))
        pairs = down.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), known.alias("known"), apart.cast("int").alias("apart"))
    return pairs.select("a", "b")


class _Runs:
    """A block's fingerprints in runs of SPLIT, SPLIT * SPLIT and so on, each with its low and high;
    the last fingerprint is repeated to fill the last runs."""

    def __init__(self, codes: np.ndarray, depth: int) -> None:
        self.n = len(codes)
        low = high = np.concatenate([codes, np.repeat(codes[-1:], -len(codes) % SPLIT**depth)])
        self.levels = [(low, high)]
        for _ in range(depth):
            low, high = np.bitwise_and.reduce(low.reshape(-1, SPLIT), axis=1), np.bitwise_or.reduce(high.reshape(-1, SPLIT), axis=1)
            self.levels.append((low, high))


def _depth(n: int) -> int:
    depth = 1
    while SPLIT**depth < n:
        depth += 1
    return depth


def near_pairs(a: np.ndarray, b: np.ndarray, distance: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j) of fingerprints of a and b that differ in at most `distance` bits, lot by lot;
    each pair once, and only i < j where a and b are the same block. Both are in Gray order."""
    depth = _depth(max(len(a), len(b)))
    x, y = _Runs(a, depth), _Runs(b, depth)
    i_of, j_of = (g.ravel() for g in np.meshgrid(np.arange(SPLIT), np.arange(SPLIT), indexing="ij"))
    zero = np.zeros(1, np.int64)
    stack = [(depth, zero, zero, np.zeros(1, np.uint64), np.zeros(1, np.uint8))]
    while stack:
        level, i, j, known, apart = stack.pop()
        if len(i) > OPEN:
            stack += [(level, *(c[k : k + OPEN] for c in (i, j, known, apart))) for k in range(0, len(i), OPEN)]
            continue
        i, j = (i[:, None] * SPLIT + i_of).ravel(), (j[:, None] * SPLIT + j_of).ravel()
        (low_x, high_x), (low_y, high_y) = x.levels[level - 1], y.levels[level - 1]
        both = ~(low_x[i] ^ high_x[i]) & ~(low_y[j] ^ high_y[j])
        new = (low_x[i] ^ low_y[j]) & both & ~np.repeat(known, SPLIT * SPLIT)
        apart = np.repeat(apart, SPLIT * SPLIT) + np.bitwise_count(new)
        kept = apart <= distance
        if same:
            kept &= i <= j
        if level == 1:
            kept &= (i < x.n) & (j < y.n)
            if same:
                kept &= i < j
            yield i[kept], j[kept]
        elif kept.any():
            stack.append((level - 1, i[kept], j[kept], both[kept], apart[kept]))


def _joined_roots(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches once the links (i, j) are added to roots."""
    while len(i):
        least = np.minimum(roots[i], roots[j])
        open_ = roots[i] != roots[j]
        i, j, least = i[open_], j[open_], least[open_]
        np.minimum.at(roots, roots[i], least)
        np.minimum.at(roots, roots[j], least)
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots = up
    return roots


def _links(distance: int):
    """Of a block and those it meets: (a, b), a forest of the links between them. Its members are
    joined partner by partner, so that a family gives a row a member and not all its pairs."""

    def run(table: pa.Table) -> pa.Table:
        own_id = table.column("a")[0].as_py()
        blocks = {b: np.frombuffer(m.as_buffer(), np.uint64) for b, m in zip(table.column("b").to_pylist(), table.column("members"), strict=True)}
        own, left, right = blocks[own_id], [], []
        for other_id, other in blocks.items():
            same = other_id == own_id
            codes = own if same else np.concatenate([own, other])
            roots = np.arange(len(codes))
            for i, j in near_pairs(own, other, distance, same):
                if len(i):
                    roots = _joined_roots(roots, i, j if same else j + len(own))
            moved = np.flatnonzero(roots != np.arange(len(codes)))
            left.append(codes[moved])
            right.append(codes[roots[moved]])
        columns = [pa.array(np.concatenate(c).view(np.int64)) for c in (left, right)]
        return pa.Table.from_arrays(columns, names=["a", "b"])

    return run


def near_links(codes: DataFrame, distance: int) -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fingerprints (code) that
    differ in at most `distance` bits. Every pair is found; a forest of them is returned."""
    spark = codes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), codes.count() // (BLOCK * FAN) + 1)
    ranked = codes.select("code", gray_rank(F.col("code")).alias("rank")).repartitionByRange(parts, "rank").sortWithinPartitions("rank")
    blocks = written(ranked.select("code").mapInArrow(_blocks, "part bigint, seq bigint, low bigint, high bigint, members binary"))
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    pairs = open_pairs(blocks, parts, distance)
    met = pairs.join(blocks.select((F.col("part") * (1 << 32) + F.col("seq")).alias("b"), "members"), "b")
    return met.groupBy("a").applyInArrow(_links(distance), "a bigint, b bigint")


def simhash_components(docs: DataFrame, width: int = 3, distance: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of documents (doc_id, text), a row each.

    fingerprint: 16 hex digits of the SimHash over XXH64 (UTF-8, `seed`) of the `width`-word shingles
    of the text with A-Z lower-cased; words are parted by ASCII blanks. A text of fewer words is one
    shingle; one without words, null included, has fingerprint zero and is linked like any other.
    component_id: the smallest doc_id of the rows reachable over fingerprints that differ in at most
    `distance` bits; null ids count as largest, so it is null where no row has an id.

    Rows with one fingerprint are one node of the index, whatever their ids; repeated rows get a
    row each. Texts are hashed whole, a run of words at a time. An empty table gives no rows; other
    columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = written(texts.mapInArrow(_fingerprint(width, seed), "doc_id bigint, code bigint"))
    codes = written(prints.groupBy("code").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = components(near_links(codes, distance))
    rooted = written(codes.join(found, F.col("code") == F.col("node"), "left").select("code", "least", "n", F.coalesce("component", "code").alias("root")))
    roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_codes"))
    named = written(join_hot(rooted.select("code", "n", "root"), roots, "root", "n_codes").select("code", "n", "component_id"))
    joined = join_hot(prints, named, "code", "n")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
