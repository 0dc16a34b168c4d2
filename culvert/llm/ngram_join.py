"""Components of an exact Jaccard self-join of word n-gram sets by vertical partitioning.

Documents with equal sets form one class; classes are joined. All n-grams have one global order:
by a hashed count of their documents, then by code, so common ones come last. The order's codes
are cut into fragments. A class sends the first part of its set, in that order, to the fragments;
each fragment counts the overlaps of the pairs it sees, and the counts are summed per pair. Of the
set whose part ends first in the order, all n-grams that the pair shares outside the counted ones lie
after its part: a pair whose sum and the longer rest don't reach the overlap that its sizes ask for
can't link. Pairs that remain are verified on whole sets.

An n-gram that many classes share (`crowd` and more) makes no pairs in its fragment. Its hub is the
class that stands in the most such n-grams: among near copies, the one nearest to all others, as
own words of a copy take the first places of its set. Each class is verified with the hub that it
shares most with. That leaves few classes under a hub outside its largest component. They are held
against the hub's classes in blocks: a task has a block of the few and a slice of the hub's classes
that stand in enough such n-grams to link, counts whole overlaps, and gives one link for each
component met. So no component is lost, no pair is written that doesn't link, and a large group of
near copies costs about one pair a member. Pairs that already share a component are not verified: links
inside a component are not part of the result; ngram_jaccard_links() gives all of them.

The hashed counts also tell which n-grams very many documents hold. The entries of such an n-gram
are spread over several lists by their class, so that no fragment gathers them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert.llm import words as wd
from culvert.llm.components import components
from culvert.llm.exchange import NO_ID, Groups, bounded_batches, bucket_of, dealt, entries_of, entry_rows, entry_schema, groups, groups_for, hot_limit, join_hot, packed, released, run_starts, unpacked, written

#: Bits of the table of hashed counts: 4 bytes a cell, 16 MB in all, whatever the input.
COUNT_BITS = 22
#: Bytes of text for each fragment.
FRAGMENT_BYTES = 16 << 20
#: Entries that a task gathers before it sends them to the fragments.
FLUSH_ENTRIES = 1 << 19
#: Documents of an n-gram for each list that its entries are spread over.
LIST_DOCUMENTS = 4096
#: Few classes and classes of a hub that one task holds against each other.
FEW_BLOCK, HUB_SLICE = 256, 256
_SLICE = 1 << 16
_SET = "id bigint, n int, set_id bigint"
_ENTRY = (np.uint64, np.int64, np.int32, np.int32, np.int32)  # code, class, its size, list, lists of the n-gram
_FOUND = "a bigint, b bigint, na int, nb int, shared bigint, crowd bigint, list int, lists int, members binary, sizes binary"


class _Sets:
    """The distinct n-gram codes of each row of a batch: codes (sorted in a row), row, n, set_id."""

    def __init__(self, text: pa.Array, width: int) -> None:
        buf, at = wd.text_buffer(text)
        buf = wd.lowered(buf)
        starts, ends, bounds = wd.find_words(buf, at, wd.SPACED)
        codes = wd.word_codes(buf, starts, ends)
        n_words, owner = np.diff(bounds), wd.owner(bounds)
        fits = wd.within_rows(bounds, width)
        grams, row = wd.window_codes(codes, width)[fits], owner[: len(fits)][fits]
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        whole = [wd.window_codes(codes[bounds[r] : bounds[r + 1]], int(n_words[r]))[0] for r in short]
        grams = np.concatenate([grams, np.array(whole, np.uint64)])
        row = np.concatenate([row, short])
        order = np.lexsort((grams, row))
        grams, row = grams[order], row[order]
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (row[1:] != row[:-1])
        self.codes, self.row = grams[new], row[new]
        self.n = np.bincount(self.row, minlength=len(text)).astype(np.int32)
        ends = np.cumsum(self.n)
        self.bounds = np.concatenate([[0], ends])
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(wd.mix(self.codes ^ np.uint64(k)))]) for k in (0x51ED, 0xC0FFEE)]
        one, two = (s[self.bounds[1:]] - s[self.bounds[:-1]] for s in sums)
        self.set_id = wd.mix(one ^ wd.mix(two + self.n.astype(np.uint64))).view(np.int64)


def _describe(width: int, bits: int):
    """One row a document, and the partition's hashed counts of n-grams in slices."""
    cells = 1 << bits
    size = min(_SLICE, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.uint32)
        for batch in batches:
            sets = _Sets(batch.column("text"), width)
            np.add(counts, np.bincount((sets.codes >> np.uint64(64 - bits)).astype(np.int64), minlength=cells), out=counts, casting="unsafe")
            none = pa.nulls(len(batch), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets.n), pa.array(sets.set_id), none], names=["id", "n", "set_id", "counts"])
        used = [k for k in range(0, cells, size) if counts[k : k + size].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int64()), pa.nulls(len(used), pa.int32()), pa.nulls(len(used), pa.int64()), pa.array([packed(counts[k : k + size]) for k in used], pa.binary())],
            names=["id", "n", "set_id", "counts"],
        )

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, total = None, None
    for batch in batches:
        for k, blob in zip(batch.column("id"), batch.column("counts"), strict=True):
            at, part = k.as_py(), unpacked(blob.as_buffer(), np.uint32).astype(np.uint64)
            total = part if total is None else total + part
    capped = np.minimum(total, np.iinfo(np.uint32).max).astype(np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([packed(capped)], pa.binary())], names=["id", "counts"])


def _least(percent: int, n):
    """The overlap that a set of n n-grams has at least with any set it links with."""
    return -(-percent * n // 100)


def _spare(n):
    """N-grams of a first part beyond the fewest that find all links: they sharpen the counts."""
    return np.maximum(1, n // 20)


def needed(a: str, b: str, percent: int):
    """How many n-grams of their first parts sets of two sizes share at least if they link."""
    a, b = F.col(a), F.col(b)
    overlap = F.ceil(percent * (a + b) / F.lit(100 + percent))
    rest = lambda n: F.ceil(percent * n / F.lit(100)) - F.greatest(F.lit(1), F.floor(n / F.lit(20)))
    return F.greatest(F.lit(1), overlap - F.greatest(rest(a), rest(b)))


def _first_parts(width: int, percent: int, fragments: Groups, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        shift = np.uint64(64 - int(len(table)).bit_length() + 1)
        held: list[tuple] = []
        for batch in batches:
            sets = _Sets(batch.column("text"), width)
            once = np.zeros(len(batch), bool)
            once[np.unique(sets.set_id, return_index=True)[1]] = True
            seen = table[(sets.codes >> shift).astype(np.int64)]
            order = np.lexsort((sets.codes, seen, sets.row))
            codes, row, seen = sets.codes[order], sets.row[order], seen[order]
            place = np.arange(len(codes)) - sets.bounds[row]
            n = sets.n[row].astype(np.int64)
            keep = once[row] & (place < n - _least(percent, n) + _spare(n))
            held.append((codes[keep], sets.set_id[row[keep]], sets.n[row[keep]], (1 + seen[keep] // LIST_DOCUMENTS).astype(np.int32)))
            if sum(len(x[0]) for x in held) >= FLUSH_ENTRIES:
                yield from _sent(held, fragments)
                held = []
        if held:
            yield from _sent(held, fragments)

    return run


def _sent(held: list[tuple], fragments: Groups) -> list[pa.RecordBatch]:
    codes, sets, sizes, lists = (np.concatenate(x) for x in zip(*held, strict=True))
    part = (wd.mix(sets.view(np.uint64)) % lists.astype(np.uint64)).astype(np.int32)
    spread = np.where(part > 0, wd.mix(codes + part.astype(np.uint64)), codes)
    return entry_rows(bucket_of(spread, fragments.n), fragments, codes, sets, sizes, part, lists).to_batches()


def _found(a, b, na, nb, shared, crowds: list[tuple]) -> pa.Table:
    """Rows of pairs, then rows of crowds (code, list, lists, members, sizes)."""
    k = len(crowds)
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    pairs = ((a, pa.int64()), (b, pa.int64()), (na, pa.int32()), (nb, pa.int32()), (shared, pa.int64()))
    cols = [pa.concat_arrays([pa.array(x, t), pa.nulls(k, t)]) for x, t in pairs]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    cols += [pa.concat_arrays([pa.nulls(len(a), t), pa.array([c[i] for c in crowds], t)]) for i, t in enumerate(kinds)]
    return pa.Table.from_arrays(cols, names=["a", "b", "na", "nb", "shared", "crowd", "list", "lists", "members", "sizes"])


def _overlaps(percent: int, crowd: int):
    """A fragment's overlap of each pair of classes, and its n-grams that a crowd shares."""

    def run(table: pa.Table) -> pa.Table:
        codes, sets, sizes, part, lists = entries_of(table, *_ENTRY)
        order = np.argsort(codes, kind="stable")
        twice = np.zeros(len(codes), bool)
        twice[1:] = codes[order[1:]] == codes[order[:-1]]
        twice[:-1] |= twice[1:]
        order = order[twice | (lists[order] > 1)]
        codes, sets, sizes, part, lists = (x[order] for x in (codes, sets, sizes, part, lists))
        order = np.lexsort((sets, sizes, part, codes))
        codes, sets, sizes, part, lists = (x[order] for x in (codes, sets, sizes, part, lists))
        head = np.ones(len(codes), bool)  # of a list
        head[1:] = (codes[1:] != codes[:-1]) | (part[1:] != part[:-1])
        new = head.copy()
        new[1:] |= sets[1:] != sets[:-1]
        codes, sets, sizes, part, lists, head = (x[new] for x in (codes, sets, sizes, part, lists, head))
        at = np.flatnonzero(head)
        length = np.diff([*at, len(codes)])
        crowded = (length >= crowd) | (lists[at] > 1)
        own = np.repeat(np.where(crowded, -1, np.arange(len(at))), length)
        pairs = [np.empty((2, 0), np.int64)]
        alike = lambda i, j: 100 * sizes[i].astype(np.int64) >= percent * sizes[j].astype(np.int64)
        for k in range(1, crowd):
            i = np.flatnonzero((own[k:] == own[:-k]) & (own[k:] >= 0))
            if not len(i):
                break
            pairs.append(np.stack([i, i + k])[:, alike(i, i + k)])
        i, j = np.concatenate(pairs, axis=1)
        a, b, na, nb, shared = _counted(sets[i], sets[j], sizes[i], sizes[j])
        ids = codes.view(np.int64)
        crowds = [(int(ids[s]), int(part[s]), int(lists[s]), packed(sets[s : s + k]), packed(sizes[s : s + k])) for s, k in zip(at[crowded], length[crowded], strict=True)]
        return _found(a, b, na, nb, shared, crowds)

    return run


def _counted(a, b, na, nb):
    """Distinct unordered pairs with the number of times each is given."""
    swap = a > b
    a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
    order = np.lexsort((b, a))
    a, b, na, nb = a[order], b[order], na[order], nb[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    return a[at], b[at], na[at], nb[at], np.diff([*at, len(a)]).astype(np.int64)


def _whole_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _Sets(batch.column("text"), width)
            blobs = [packed(sets.codes[i:j]) for i, j in zip(sets.bounds[:-1], sets.bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(sets.set_id), pa.array(blobs, pa.binary())], names=["set_id", "codes"])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = unpacked(x.as_buffer(), np.uint64), unpacked(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _unlist(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            sets, n = unpacked(row["members"], np.int64), unpacked(row["sizes"], np.int32)
            same = [pa.array(np.full(len(sets), row[c], t)) for c, t in (("crowd", np.int64), ("list", np.int32), ("lists", np.int32))]
            yield pa.RecordBatch.from_arrays([*same, pa.array(sets), pa.array(n)], names=["crowd", "list", "lists", "set_id", "n"])


def _under_hubs(crowds: DataFrame, degrees: DataFrame) -> DataFrame:
    """(hub, hub_n, set_id, n, degree, shared): each class under the hubs of its crowds, with its
    number of crowds, of this hub and of all."""
    best = crowds.join(degrees, "set_id").groupBy("crowd", "lists").agg(F.max(F.struct("degree", "n", "set_id")).alias("h"), F.count("*").alias("k"))
    hubs = best.filter("k > 1").select("crowd", F.col("h.set_id").alias("hub"), F.col("h.n").alias("hub_n"), F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("list"))
    # An n-gram's members meet its hub list by list, not all in one task.
    found = crowds.join(hubs, ["crowd", "list"]).groupBy("hub", "hub_n", "set_id", "n").agg(F.count("*").alias("shared"))
    return found.join(degrees, "set_id")


def _grid(percent: int):
    """Links of a block of few classes with a slice of their hub's: one for each component met."""

    def run(few: pa.Table, slice_: pa.Table) -> pa.Table:
        x, xc, y, yc = (t.column(c).to_numpy() for t in (few, slice_) for c in ("set_id", "component"))
        own, other = ([unpacked(c.as_buffer(), np.uint64) for c in t.column("codes")] for t in (few, slice_))
        n, m = np.array([len(c) for c in own], np.int64), np.array([len(c) for c in other], np.int64)
        grams, holder = np.concatenate([*own, np.empty(0, np.uint64)]), np.repeat(np.arange(len(own)), n)
        order = np.argsort(grams, kind="stable")
        grams, holder = grams[order], holder[order]
        links: dict[tuple[int, int], tuple[int, int]] = {}
        for k, codes in enumerate(other if len(own) else ()):
            lo, hi = np.searchsorted(grams, codes), np.searchsorted(grams, codes, side="right")
            held = hi > lo
            lo, size = lo[held], (hi - lo)[held]
            at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
            both = np.bincount(holder[at], minlength=len(own))
            for i in np.flatnonzero((100 * both >= percent * (n + m[k] - both)) & (xc != yc[k])):
                links.setdefault((int(x[i]), int(yc[k])), (int(x[i]), int(y[k])))
        pairs = sorted(links.values())
        return pa.table({"a": pa.array([min(p) for p in pairs], pa.int64()), "b": pa.array([max(p) for p in pairs], pa.int64())})

    return run


def _across(under: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links of classes under one hub that are in different components. A hub whose classes are all
    in one component has none; None if no hub has any."""
    placed = under.join(parts.withColumnRenamed("node", "set_id"), "set_id", "left").select("hub", "set_id", "n", "degree", F.coalesce("component", "set_id").alias("component"))
    # Classes in fewer crowds can't link by crowds alone.
    placed = written(placed.filter(F.col("degree") >= F.greatest(F.lit(1), F.floor(F.col("n") / F.lit(20)))).select("hub", "set_id", "component"))
    sizes = placed.groupBy("hub", "component").agg(F.count("*").alias("k"))
    hubs = sizes.groupBy("hub").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most")).filter("most < all")
    cut = lambda size, part: F.ceil(size / F.lit(part)).cast("int")
    hubs = written(hubs.select("hub", "main", "all", cut(F.col("all") - F.col("most"), FEW_BLOCK).alias("blocks"), cut(F.col("all"), HUB_SLICE).alias("slices")))
    if hubs.isEmpty():
        return None
    placed = written(join_hot(placed, hubs, "hub", "all").join(sets, "set_id"))
    return _in_cells(placed.filter("component <> main"), placed, percent)


def _all_under(under: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """All links of classes under one hub; None without hubs."""
    placed = written(under.filter(F.col("degree") >= F.greatest(F.lit(1), F.floor(F.col("n") / F.lit(20)))).select("hub", "set_id", F.col("set_id").alias("component")))
    hubs = placed.groupBy("hub").agg(F.count("*").alias("all"))
    hubs = written(hubs.select("hub", "all", F.ceil(F.col("all") / F.lit(FEW_BLOCK)).cast("int").alias("blocks"), F.ceil(F.col("all") / F.lit(HUB_SLICE)).cast("int").alias("slices")))
    if hubs.isEmpty():
        return None
    placed = written(join_hot(placed, hubs, "hub", "all").join(sets, "set_id"))
    return _in_cells(placed, placed, percent)


def _in_cells(few: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """_grid() of each block of few classes with each slice of their hub's."""
    some = lambda of, seed: F.pmod(F.xxhash64("set_id", F.lit(seed)), of).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    few = few.withColumn("block", some(F.col("blocks"), 1)).withColumn("slice", each("slices"))
    rest = placed.withColumn("slice", some(F.col("slices"), 2)).withColumn("block", each("blocks"))
    few, rest = (x.select("hub", "block", "slice", "set_id", "component", "codes") for x in (few, rest))
    cell = ["hub", "block", "slice"]
    return few.groupBy(cell).cogroup(rest.groupBy(cell)).applyInArrow(_grid(percent), "a bigint, b bigint").distinct()


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that link. Many pairs may have one b: its rows are split by a salt, and
    its set is sent once for each."""
    limit = hot_limit(pairs.count())
    hot = pairs.groupBy("b").agg(F.count("*").alias("k")).filter(F.col("k") > limit)  # at most 10,000 rows
    hot = F.broadcast(hot.select("b", F.ceil(F.col("k") / F.lit(limit)).alias("salts")))
    salted = lambda df: df.join(hot, "b", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    left = sets.select(F.col("set_id").alias("a"), F.col("codes").alias("x"))
    right = salted(sets.select(F.col("set_id").alias("b"), F.col("codes").alias("y"))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)))
    own = salted(pairs.select("a", "b")).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts"))).drop("salts")
    return own.join(left, "a").join(right.drop("salts"), ["b", "salt"]).select("a", "b", "x", "y").mapInArrow(_verified(percent), "a bigint, b bigint")


class _Prepared(NamedTuple):
    """What both entries start from: members (id, n, set_id), classes (set_id, least, copies), under
    (classes under hubs), pairs (a, b, shared) that may link outside crowds, sets (set_id, codes)."""

    members: DataFrame
    classes: DataFrame
    under: DataFrame
    pairs: DataFrame
    sets: DataFrame


def _prepared(docs: DataFrame, width: int, percent: int, crowd: int, count_bits: int) -> _Prepared:
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col("text").cast("string"))
    fragments = groups(groups_for(docs, "text", FRAGMENT_BYTES))

    described = written(docs.mapInArrow(_describe(width, count_bits), _SET + ", counts binary"))
    members = described.filter("set_id is not null").select("id", "n", "set_id")
    counts = np.zeros(1 << count_bits, np.uint32)
    for row in described.filter("set_id is null").select("id", "counts").groupBy("id").applyInArrow(_summed, "id bigint, counts binary").toLocalIterator():
        part = unpacked(row.counts, np.uint32)
        counts[row.id : row.id + len(part)] = part
    shared_counts = spark.sparkContext.broadcast(counts)
    classes = members.filter("n > 0").groupBy("set_id").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes)

    lists = docs.mapInArrow(_first_parts(width, percent, fragments, shared_counts), entry_schema(5))
    found = written(dealt(lists, fragments, *_ENTRY).groupBy("band").applyInArrow(_overlaps(percent, crowd), _FOUND))
    released(spark)  # the entries
    crowds = written(
        found.filter("members is not null").select("crowd", "list", "lists", "members", "sizes").mapInArrow(_unlist, "crowd bigint, list int, lists int, set_id bigint, n int")
    )
    degrees = crowds.groupBy("set_id").agg(F.count("*").alias("degree"))
    under = written(_under_hubs(crowds, degrees))
    summed = found.filter("a is not null").groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    # What a pair shares in crowds is not counted; it is at most what either has in them.
    for end in "ab":
        summed = summed.join(degrees.select(F.col("set_id").alias(end), F.col("degree").alias(f"{end}_degree")), end, "left")
    most = F.col("shared") + F.least(F.coalesce("a_degree", F.lit(0)), F.coalesce("b_degree", F.lit(0)))
    pairs = written(summed.filter(most >= needed("na", "nb", percent)).select("a", "b", "shared"))

    # Whole sets of the classes in pairs: from one document of each class.
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).unionByName(crowds.select("set_id")).distinct()
    chosen = classes.join(ends, "set_id", "left_semi").select(F.col("least").alias("id")).distinct()
    sets = docs.join(chosen, "id", "left_semi").select("text").mapInArrow(_whole_sets(width), "set_id bigint, codes binary")
    sets = written(sets.groupBy("set_id").agg(F.first("codes").alias("codes")))
    return _Prepared(members, classes, under, pairs, sets)


def ngram_jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, crowd: int = 10, count_bits: int = COUNT_BITS) -> DataFrame:
    """Components of documents (doc_id, text) whose n-gram sets have a Jaccard similarity of at
    least percent / 100. One row for each row of docs: doc_id, n_shingles, component_id (smallest
    doc_id reachable by links, itself included).

    Words are `[^\\x20\\x09-\\x0D]+` after A-Z become a-z. A text of fewer than `width` words is one
    n-gram; null and blank texts have an empty set and link with nothing. A null doc_id is passed
    over as component_id, unless its component has no other. Repeated rows are linked as equal
    texts are. A text of any length is one set. An empty table gives an empty table; other columns of docs are ignored. N-grams are
    64-bit codes of their words, and sets 64-bit codes of their n-grams.
    """
    members, classes, under, pairs, sets = _prepared(docs, width, percent, crowd, count_bits)

    # First each class with the partner and the hub that it shares most with: (class, partner).
    top = lambda end, other: pairs.groupBy(end).agg(F.max_by(other, "shared").alias("partner")).select(F.col(end).alias("a"), F.col("partner").alias("b"))
    alike = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    spokes = under.filter((F.col("set_id") != F.col("hub")) & alike).groupBy(F.col("set_id").alias("a")).agg(F.max_by("hub", "shared").alias("b"))
    first = written(top("a", "b").unionByName(top("b", "a")).unionByName(spokes).distinct())
    links = written(_verify(first, sets, percent))
    parts = written(components(links))
    part = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    apart = pairs.join(part("a"), "a", "left").join(part("b"), "b", "left").filter(F.coalesce("a_part", "a") != F.coalesce("b_part", "b")).select("a", "b")
    rest = written(apart)
    more = [] if rest.isEmpty() else [_verify(rest, sets, percent)]
    if (across := _across(under, parts, sets, percent)) is not None:
        more.append(across)
    if more:
        for new in more:
            links = links.unionByName(new)
        parts = written(components(links))

    # Class by class, and then their documents: rows of a hot component or class stay where they are.
    placed = classes.join(parts.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("part", F.coalesce("component", "set_id"))
    placed = written(placed.select("set_id", "least", "copies", "part"))
    smallest = written(placed.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("k")))
    known = written(join_hot(placed, smallest, "part", "k").select("set_id", "component_id", "copies"))
    linked = join_hot(members.filter("n > 0"), known, "set_id", "copies").select("id", "n", "component_id")
    alone = members.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return linked.unionByName(alone).select(real("id").alias("doc_id"), F.col("n").cast("bigint").alias("n_shingles"), real("component_id").alias("component_id"))


class Links(NamedTuple):
    """pairs (a, b): ids of the representatives of two classes that link, a < b in the order of their
    codes. members (doc_id, class_id, n_links): each document with its class's representative, the
    smallest doc_id of the class, and the number of classes that it links with."""

    pairs: DataFrame
    members: DataFrame


def ngram_jaccard_links(docs: DataFrame, width: int = 5, percent: int = 75, crowd: int = 10, count_bits: int = COUNT_BITS) -> Links:
    """All links between different sets of n-grams, once for each two classes of documents with equal
    sets: what ngram_jaccard_components() leaves out. Links are verified on whole sets. Under a hub
    classes are held against each other in blocks, which give links alone; a family whose members all
    link has as many links as pairs.

    Nulls, empty texts, ties and repeated rows are as there: an empty set is a class of its own
    without links. Null doc_ids stay null, as class_id only where the class has no other.
    """
    members, classes, under, pairs, sets = _prepared(docs, width, percent, crowd, count_bits)
    found = _verify(written(pairs.select("a", "b")), sets, percent)
    if (crowded := _all_under(under, sets, percent)) is not None:
        found = found.unionByName(crowded)
    links = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    counts = links.select(F.explode(F.array("a", "b")).alias("set_id")).groupBy("set_id").agg(F.count("*").alias("n_links"))
    known = written(classes.join(counts, "set_id", "left").select("set_id", "least", "copies", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    linked = join_hot(members.filter("n > 0"), known, "set_id", "copies").select(real("id").alias("doc_id"), real("least").alias("class_id"), "n_links")
    alone = members.filter("n = 0").select(real("id").alias("doc_id"), real("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    end = lambda e, name: known.select(F.col("set_id").alias(e), real("least").alias(name))
    named = links.join(end("a", "_a"), "a").join(end("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    return Links(named, linked.unionByName(alone))
