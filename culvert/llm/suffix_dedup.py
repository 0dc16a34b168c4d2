"""Repeated passages by sparse suffix arrays over minimiser positions.

A suffix is kept where the code of its first words is the smallest of `width - prefix + 1`
neighbours. Two equal runs of `width` words choose the same place, so each has a kept suffix with
the same first `prefix` words. Suffixes are ordered by their words, each word by a 16-bit code, and
compared with their neighbours in that order: one that shares its first `prefix` words with no other
document lies in no match and is done with. They are dealt by those words, as an order across tasks
would tell nothing more.

The matched suffixes are sent again, with all words that a match may reach to their left and right.
Sorted by the words to the right, neighbours tell how far each two suffixes agree to the right;
sorted by the words to the left, how far they agree to the left. Suffixes that agree on k words to
the left and on `width - k` to the right hold the same run of codes there. Codes of 16 bits order the
suffixes and tell how far they agree; two runs are the same only if a code of all their words, which
is made of 64 bits for each, is the same too. The smallest document that holds a run keeps it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert.llm import words as wd
from culvert.llm.exchange import Groups, bounded_batches, bucket_of, dealt, entries_of, entry_rows, entry_schema, groups, groups_for, run_starts
from culvert.llm.passages import BATCH, CLEANED, Known, Texts, batches_of, cleaned_rows, cleaned_table, in_chunks

#: Bytes of text for each chunk of documents and each bucket of suffixes.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Bytes of a run's code that travel. A word in another's place is taken for it with a chance of one in
#: 2^(16 + 8 RUN_BYTES): its own code must be equal, and its run's.
RUN_BYTES = 5
_MANY = np.random.default_rng(20240912).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_for(width: int) -> int:
    """Words of a suffix that are compared first: two fifths of a match."""
    return max(1, 2 * width // 5)


def kept_suffixes(texts: Texts, width: int) -> np.ndarray:
    """Places (words of the batch) of the kept suffixes: of each window of neighbours the place with
    the smallest (code, place), so that equal runs keep equal places."""
    prefix = prefix_for(width)
    span = width - prefix + 1
    codes, fits = wd.window_codes(texts.codes, prefix), wd.within_rows(texts.bounds, width)
    n = len(fits)
    if not n:
        return np.empty(0, np.int64)
    # The smallest of `span` neighbours: of two runs whose lengths are powers of two.
    best, at, reach = codes.copy(), np.arange(len(codes)), 1
    while 2 * reach <= span:
        best, at = _smaller(best[:-reach], at[:-reach], best[reach:], at[reach:])
        reach *= 2
    rest = span - reach
    _, place = _smaller(best[:n], at[:n], best[rest : rest + n], at[rest : rest + n])
    return np.unique(place[fits])


def _smaller(a, i, b, j):
    take = b < a  # the left one on ties
    return np.where(take, b, a), np.where(take, j, i)


def _letters(texts: Texts) -> np.ndarray:
    """A 16-bit code for each word, never 0: the alphabet of the suffix order."""
    return np.maximum(texts.codes >> np.uint64(48), np.uint64(1)).astype(np.uint16)


def _around(letters: np.ndarray, bounds: np.ndarray, places: np.ndarray, left: int, right: int) -> np.ndarray:
    """The codes of `left` words before and `right` words from each place; 0 beyond its document."""
    row = np.searchsorted(bounds, places, side="right") - 1
    at = places[:, None] + np.arange(-left, right)
    inside = (at >= bounds[row][:, None]) & (at < bounds[row + 1][:, None])
    return np.where(inside, letters[np.clip(at, 0, max(0, len(letters) - 1))], np.uint16(0))


def _runs(texts: Texts, places: np.ndarray, width: int, left: int) -> np.ndarray:
    """RUN_BYTES of a code of the run of `width` words that begins k words to the left of each place, for each
    k up to `left`; 0 where it would leave the document."""
    row = np.searchsorted(texts.bounds, places, side="right") - 1
    start = places[:, None] - np.arange(left + 1)
    whole = (start >= texts.bounds[row][:, None]) & (start + width <= texts.bounds[row + 1][:, None])
    codes = wd.window_codes(texts.codes, width)
    if not len(codes):
        return np.zeros(start.shape, np.uint64)
    found = codes[np.clip(start, 0, len(codes) - 1)] >> np.uint64(64 - 8 * RUN_BYTES)
    return np.where(whole, found, np.uint64(0))


def _run_cells(runs: np.ndarray) -> np.ndarray:
    cells = np.ascontiguousarray(runs.astype("<u8").view(np.uint8).reshape(*runs.shape, 8)[:, :, :RUN_BYTES])
    return cells.reshape(len(runs), RUN_BYTES * runs.shape[1]).view(f"V{RUN_BYTES * runs.shape[1]}").ravel()


def _as_runs(cells: np.ndarray) -> np.ndarray:
    n = cells.dtype.itemsize // RUN_BYTES
    out = np.zeros((len(cells), n, 8), np.uint8)
    out[:, :, :RUN_BYTES] = cells.view(np.uint8).reshape(len(cells), n, RUN_BYTES)
    return out.view("<u8").reshape(len(cells), n)


def _context_code(words: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """A 64-bit code of the words around a suffix, by their own codes and by those of their runs."""
    total = _code(words)
    for k in range(runs.shape[1]):
        total = wd.mix(total * _MANY[0] + runs[:, k])
    return total


def _code(words: np.ndarray) -> np.ndarray:
    """A 64-bit code for each row of word codes."""
    total = np.zeros(len(words), np.uint64)
    for k in range(words.shape[1]):
        total += words[:, k].astype(np.uint64) * _MANY[k % len(_MANY)]
        total = wd.mix(total) if k % 8 == 7 else total
    return wd.mix(total)


def _as_cells(words: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(words).view(f"V{2 * words.shape[1]}").ravel()


def _as_words(cells: np.ndarray) -> np.ndarray:
    return cells.view(np.uint16).reshape(len(cells), cells.dtype.itemsize // 2)


def suffix_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows of words, and how many first words each row shares with the one before it
    in that order (0 for the first)."""
    order = np.argsort(words.astype(">u2").view(f"S{2 * words.shape[1]}").ravel(), kind="stable")
    shared = np.zeros(len(words), np.int64)
    if len(words) > 1:
        same = words[order[1:]] == words[order[:-1]]
        shared[1:] = np.where(same.all(axis=1), words.shape[1], same.argmin(axis=1))
    return order, shared


def _several(agree: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Members of runs of agreeing neighbours that have more than one owner."""
    if not len(owners):
        return np.zeros(0, bool)
    at = np.flatnonzero(~agree)
    run = np.repeat(np.arange(len(at)), np.diff([*at, len(owners)]))
    return (np.minimum.reduceat(owners, at) != np.maximum.reduceat(owners, at))[run]


def _distinct(codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct code a place, the smallest id, and whether there are several ids."""
    order = np.lexsort((ids, codes))
    at = run_starts(codes[order])
    last = np.append(at[1:], len(codes)) - 1 if len(at) else at
    return order[at], ids[order][at], ids[order][last] != ids[order][at]


def _suffixes(width: int, buckets: Groups):
    """The distinct first words of a chunk's kept suffixes, and whether several of its documents have them."""
    prefix = prefix_for(width)

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        found = []
        for texts in batches_of(docs):
            places = kept_suffixes(texts, width)
            words = _around(_letters(texts), texts.bounds, places, 0, prefix)
            found.append((words, texts.ids[wd.owner(texts.bounds)[places]]))
        words, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        codes = _code(words)
        at, _, several = _distinct(codes, ids)
        return entry_rows(bucket_of(codes[at], buckets.n), buckets, _as_cells(words[at]), several.view(np.uint8), np.full(len(at), key[0].as_py(), np.int64))

    return run


def _neighbours(prefix: int, chunks: Groups):
    """Sorts a bucket's suffixes and tells the chunks which of them agree on all first words with a
    neighbour of another document."""

    def run(table: pa.Table) -> pa.Table:
        cells, several, chunk = entries_of(table, f"V{2 * prefix}", np.uint8, np.int64)
        words = _as_words(cells)
        order, shared = suffix_order(words)
        kept = _several(shared == prefix, chunk[order]) | (several[order] > 0)
        return entry_rows(chunk[order][kept], chunks, _code(words[order][kept]))

    return run


def _contexts(width: int, buckets: Groups):
    """A chunk's matched suffixes with the words that a match may reach: each distinct one with its
    smallest document and whether there are others."""
    prefix = prefix_for(width)
    left = width - prefix

    def run(key: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        matched = Known(entries_of(back, np.uint64)[0])
        found = [(np.empty((0, left + width), np.uint16), np.empty((0, left + 1), np.uint64), np.empty(0, np.int64))]
        for texts in batches_of(docs) if len(matched.codes) else ():
            places, letters = kept_suffixes(texts, width), _letters(texts)
            places = places[matched.where(_code(_around(letters, texts.bounds, places, 0, prefix)))]
            found.append((_around(letters, texts.bounds, places, left, width), _runs(texts, places, width, left), texts.ids[wd.owner(texts.bounds)[places]]))
        words, runs, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        at, least, several = _distinct(_context_code(words, runs), ids)
        words, runs = words[at], runs[at]
        group = bucket_of(_code(words[:, left : left + prefix]), buckets.n)
        return entry_rows(group, buckets, _as_cells(words), _run_cells(runs), least, several.view(np.uint8), np.full(len(at), key[0].as_py(), np.int64))

    return run


def late_runs(words: np.ndarray, runs: np.ndarray, ids: np.ndarray, width: int) -> np.ndarray:
    """For each suffix (words to its left and right, codes of the runs around it, smallest document) and
    each k, whether a smaller document has the run of `width` words that begins k words to the left of it."""
    left = words.shape[1] - width
    out = np.zeros((len(words), left + 1), bool)
    if len(words) < 2:
        return out
    n_right, n_left = (words[:, left:] > 0).sum(axis=1), (words[:, :left] > 0).sum(axis=1)
    right_order, right_shared = suffix_order(words[:, left:])
    left_order, left_shared = suffix_order(words[:, :left][:, ::-1]) if left else (np.arange(len(words)), np.zeros(len(words), np.int64))
    classes = np.empty((2, len(words)), np.int64)
    for k in range(left + 1):
        whole = np.flatnonzero((n_left >= k) & (n_right >= width - k))
        if len(whole) < 2:
            continue
        classes[0, right_order] = np.cumsum(right_shared < width - k)
        classes[1, left_order] = np.cumsum(left_shared < k)
        same = classes[0, whole] * (len(words) + 1) + classes[1, whole]
        own = runs[whole, k]
        order = np.lexsort((ids[whole], own, same))
        at = np.flatnonzero(np.concatenate([[True], (same[order][1:] != same[order][:-1]) | (own[order][1:] != own[order][:-1])]))
        least = np.repeat(ids[whole][order][at], np.diff([*at, len(order)]))
        out[whole[order], k] = least < ids[whole][order]
    return out


def _extended(width: int, chunks: Groups):
    """Extends a bucket's matched suffixes, prefix by prefix, and tells the chunks the runs of
    `width` words around each that a smaller document has."""
    left = width - prefix_for(width)

    def run(table: pa.Table) -> pa.Table:
        cells, run_cells, ids, several, chunk = entries_of(table, f"V{2 * (left + width)}", f"V{RUN_BYTES * (left + 1)}", np.int64, np.uint8, np.int64)
        words, runs = _as_words(cells), _as_runs(run_cells)
        late = late_runs(words, runs, ids, width)
        told = late.any(axis=1) | (several > 0)
        masks = np.packbits(late[told], axis=1)
        return entry_rows(chunk[told], chunks, _context_code(words[told], runs[told]), masks.view(f"V{masks.shape[1]}").ravel())

    return run


def _cleaned(width: int, keep_text: bool):
    """A chunk's documents without the runs that a smaller document has."""
    left = width - prefix_for(width)

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        codes, cells = entries_of(back, np.uint64, f"V{-(-(left + 1) // 8)}")
        order = np.argsort(codes)
        codes = codes[order]
        late = np.unpackbits(cells[order].view(np.uint8).reshape(len(codes), cells.dtype.itemsize), axis=1)[:, : left + 1] > 0
        known, parts, hits = Known(codes), list(batches_of(docs)), []
        for texts in parts:
            places = kept_suffixes(texts, width) if len(codes) else np.empty(0, np.int64)
            words = _around(_letters(texts), texts.bounds, places, left, width)
            own = _context_code(words, _runs(texts, places, width, left))
            at = known.where(own)
            lengths = np.stack([(words[at, :left] > 0).sum(axis=1), (words[at, left:] > 0).sum(axis=1)], axis=1)
            hits.append((places[at], np.searchsorted(codes, own[at]), texts.ids[wd.owner(texts.bounds)[places[at]]], lengths))
        # A document that is not the chunk's smallest with this suffix loses all whole runs around it.
        least = np.full(len(codes), np.iinfo(np.int64).max)
        for _, entry, ids, _ in hits:
            np.minimum.at(least, entry, ids)
        steps, rows = np.arange(left + 1), []
        for texts, batch, (places, entry, ids, n) in zip(parts, docs.to_batches(max_chunksize=BATCH), hits, strict=True):
            whole = (n[:, :1] >= steps) & (n[:, 1:] >= width - steps)
            gone = whole & (late[entry] | (ids > least[entry])[:, None])
            suffix, k = np.nonzero(gone)
            change = np.zeros(len(texts.codes) + 1, np.int64)
            np.add.at(change, places[suffix] - k, 1)
            np.add.at(change, places[suffix] - k + width, -1)
            rows += cleaned_rows(texts, batch, np.cumsum(change[:-1]) == 0, keep_text)
        return cleaned_table(rows)

    return run


def suffix_dedup(docs: DataFrame, width: int = 50, keep_text: bool = True) -> DataFrame:
    """Documents (doc_id, text) without passages of `width` words or more of smaller documents.

    A word `[^\\x20\\x09-\\x0D]+` goes if it lies in a run of `width` words that a document with a
    smaller doc_id has, too; runs are judged on the input. One row for each row of docs: doc_id,
    n_words, n_removed, kept_sha256 (of the kept words joined by one space), kept_text (null unless
    keep_text).

    Null and empty texts have no words. A null doc_id ranks after every number. Rows with the same
    doc_id, repeated ones too, take nothing from each other. A text of any length is one row of its
    chunk; one beyond CHUNK_BYTES makes the chunk as large. An empty table gives an empty table;
    other columns of docs are ignored. Runs are compared by `width` 16-bit codes of their words and a
    40-bit code of the run.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    chunks, buckets = map(groups, groups_for(docs, "text", CHUNK_BYTES, BUCKET_BYTES))
    by_chunk = in_chunks(docs, chunks.n)
    prefix = prefix_for(width)
    suffixes = by_chunk.groupBy("chunk").applyInArrow(_suffixes(width, buckets), entry_schema(3))
    suffixes = dealt(suffixes, buckets, f"V{2 * prefix}", np.uint8, np.int64)
    matched = dealt(suffixes.groupBy("band").applyInArrow(_neighbours(prefix, chunks), entry_schema(1)), chunks, np.uint64)
    contexts = by_chunk.groupBy("chunk").cogroup(matched.groupBy("band")).applyInArrow(_contexts(width, buckets), entry_schema(5))
    contexts = dealt(contexts, buckets, f"V{2 * (2 * width - prefix)}", f"V{RUN_BYTES * (width - prefix + 1)}", np.int64, np.uint8, np.int64)
    late = contexts.groupBy("band").applyInArrow(_extended(width, chunks), entry_schema(2))
    late = dealt(late, chunks, np.uint64, f"V{-(-(width - prefix + 1) // 8)}")
    return by_chunk.groupBy("chunk").cogroup(late.groupBy("band")).applyInArrow(_cleaned(width, keep_text), CLEANED)
