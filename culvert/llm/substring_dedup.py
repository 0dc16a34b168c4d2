"""Removal of repeated word windows, found by difference-cover anchors.

A difference cover D of period v has, for any two places i and j, a shift k < v with i + k and
j + k both in D modulo v. So if windows of v - 1 + a words at i and j are equal, they hold equal
anchors of a words at cover places: only anchors at places in D are hashed and shuffled. An anchor
that stands in one document alone rules out every window that could contain it; the windows around
shared anchors are hashed whole, and the smallest document of each window's words decides.

Documents are dealt to chunks. Anchors and then windows go from chunks to buckets by code, and what a
bucket finds goes back. A chunk sends and gets a code once, however many of its documents hold it,
so a passage that very many documents share costs one entry for each chunk. Only windows that a
smaller document may have come back, so that the last pass looks up each window and sorts none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert.llm import words as wd
from culvert.llm.exchange import NO_ID, Groups, bounded_batches, bucket_of, dealt, entries_of, entry_rows, entry_schema, groups, groups_for, run_starts
from culvert.llm.passages import BATCH, CLEANED, Known, Texts, batches_of, cleaned_rows, cleaned_table, in_chunks

#: Difference covers: (period, cover). The anchor has width - period + 1 words.
COVERS = ((7, (0, 1, 3)), (3, (0, 1)), (1, (0,)))
#: Bytes of text for each chunk of documents and each bucket of codes.
CHUNK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: The bits of an anchor's code that are sent. Anchors only choose windows to compare, so that two
#: anchors with one code cost some windows and change no result.
_ANCHOR_BITS = np.uint64((1 << 64) - (1 << 16))
_ANCHOR = (np.uint64, np.uint8, np.int64)  # code, several, chunk
_WINDOW = (np.uint64, np.uint64, np.int64, np.uint8, np.int64)  # two codes, id, several, chunk


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The sparsest cover whose anchor for windows of `width` words is at least half a window."""
    return next((v, d) for v, d in COVERS if 2 * (width - v + 1) >= width)


def anchors(texts: Texts, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (words of the batch), codes and rows of the anchors for windows of `width` words."""
    period, cover = cover_for(width)
    size = width - period + 1
    row = wd.owner(texts.bounds)
    fits = wd.within_rows(texts.bounds, size)
    inside = (np.arange(len(fits)) - texts.bounds[row[: len(fits)]]) % period
    places = np.flatnonzero(fits & np.isin(inside, cover))
    return places, wd.window_codes(texts.codes, size)[places] & _ANCHOR_BITS, row[places]


def windows(texts: Texts, width: int, near: np.ndarray | None = None):
    """Places, two codes and rows of windows; with `near`, only those that hold such an anchor."""
    period, _ = cover_for(width)
    fits = wd.within_rows(texts.bounds, width)
    if near is not None:
        mark = np.zeros(len(fits) + 1, np.int64)
        np.add.at(mark, np.minimum(np.maximum(near - period + 1, 0), len(fits)), 1)
        np.add.at(mark, np.minimum(near + 1, len(fits)), -1)
        fits &= np.cumsum(mark[:-1]) > 0
    places = np.flatnonzero(fits)
    return places, wd.window_codes(texts.codes, width)[places], wd.window_codes(texts.codes, width, 2)[places], wd.owner(texts.bounds)[places]


def smallest(codes: np.ndarray, more: np.ndarray, ids: np.ndarray):
    """Each distinct (code, more) with its smallest id and whether it has several, in order of code."""
    order = np.lexsort((ids, more, codes))
    codes, more, ids = codes[order], more[order], ids[order]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (more[1:] != more[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(codes)) - 1 if len(at) else at
    return codes[at], more[at], ids[at], ids[last] != ids[at]


def in_chunk(codes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's distinct codes, in order, and whether more than one of its documents has each."""
    order = np.argsort(codes, kind="stable")
    codes, ids = codes[order], ids[order]
    at = run_starts(codes)
    several = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at) if len(at) else np.zeros(0, bool)
    return codes[at], several


def _anchors(width: int, buckets: Groups):
    """A chunk's distinct anchors: one entry each, however many of its documents hold it."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        found = []
        for texts in batches_of(docs):
            _, codes, row = anchors(texts, width)
            found.append((codes, texts.ids[row]))
        codes, several = in_chunk(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return entry_rows(bucket_of(codes, buckets.n), buckets, codes, several.view(np.uint8), np.full(len(codes), key[0].as_py(), np.int64))

    return run


def _shared(chunks: Groups):
    """Of a bucket's anchors those in at least two documents, sent back to the chunks that hold them."""

    def run(table: pa.Table) -> pa.Table:
        codes, several, chunk = entries_of(table, *_ANCHOR)
        order = np.argsort(codes)
        codes, several, chunk = codes[order], several[order], chunk[order]
        at = run_starts(codes)
        size = np.diff([*at, len(codes)])
        kept = several > 0
        if len(at):
            kept |= np.repeat(size > 1, size)  # more than one chunk
        return entry_rows(chunk[kept], chunks, codes[kept])

    return run


def _candidates(width: int, buckets: Groups):
    """Windows around a chunk's shared anchors, extended to their whole width: each distinct one
    with the chunk's smallest document and whether the chunk has others."""

    def run(key: tuple, docs: pa.Table, back: pa.Table) -> pa.Table:
        shared = Known(entries_of(back, np.uint64)[0])
        found: list[tuple] = [(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64))]
        for texts in batches_of(docs) if len(shared.codes) else ():
            places, codes, _ = anchors(texts, width)
            _, a, b, row = windows(texts, width, places[shared.where(codes)])
            # Both codes together name a window; rows of the batch with it are joined here already.
            one, two, ids, several = smallest(a, b, texts.ids[row])
            found.append((one, two, ids))
            if several.any():  # stands for the others: any other id makes the window one of several
                found.append((one[several], two[several], _another(ids[several])))
        a, b, ids, several = smallest(*(np.concatenate(x) for x in zip(*found, strict=True)))
        return entry_rows(bucket_of(a, buckets.n), buckets, a, b, ids, several.view(np.uint8), np.full(len(a), key[0].as_py(), np.int64))

    return run


def _another(ids: np.ndarray) -> np.ndarray:
    """A larger id than each, which never is the smallest."""
    return np.where(ids < NO_ID, ids + 1, NO_ID)


def _owners(chunks: Groups):
    """The smallest document of a bucket's windows, sent to the chunks that have it from a larger
    one, or from several."""

    def run(table: pa.Table) -> pa.Table:
        a, b, ids, several, chunk = entries_of(table, *_WINDOW)
        order = np.lexsort((ids, b, a))
        a, b, ids, several, chunk = (x[order] for x in (a, b, ids, several, chunk))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = ids[np.flatnonzero(new)][np.cumsum(new) - 1] if len(ids) else ids
        told = (ids > least) | (several > 0)
        return entry_rows(chunk[told], chunks, a[told], b[told], least[told])

    return run


def _removed(texts: Texts, width: int, hit: np.ndarray) -> np.ndarray:
    """For each word of a batch whether it stays, given the places of the windows to remove."""
    mark = np.zeros(len(texts.codes) + 1, np.int64)
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + width, -1)
    return np.cumsum(mark[:-1]) == 0


def _cleaned(width: int, keep_text: bool):
    """A chunk's documents without the words of windows that a smaller document has."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        a, b, least = entries_of(back, np.uint64, np.uint64, np.int64)
        keys = a ^ wd.mix(b)
        order = np.argsort(keys)
        keys, least = keys[order], least[order]
        known, rows = Known(a), []
        for texts, batch in zip(batches_of(docs), docs.to_batches(max_chunksize=BATCH), strict=True):
            hit = np.empty(0, np.int64)
            if len(keys):  # only the windows around shared anchors have been sent: look for them alone
                one = wd.window_codes(texts.codes, width)
                at = known.where(one)
                at = at[wd.within_rows(texts.bounds, width)[at]]
                if len(at):
                    own = one[at] ^ wd.mix(wd.window_codes(texts.codes, width, 2)[at])
                    place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    late = (keys[place] == own) & (least[place] < texts.ids[wd.owner(texts.bounds)[at]])
                    hit = at[late]
            rows += cleaned_rows(texts, batch, _removed(texts, width, hit), keep_text)
        return cleaned_table(rows)

    return run


def substring_dedup(docs: DataFrame, width: int = 13, keep_text: bool = True) -> DataFrame:
    """Documents (doc_id, text) without repeated windows of `width` words `[^\\x20\\x09-\\x0D]+`.

    A word goes if it lies in a window whose words also start in a document with a smaller doc_id;
    windows are judged on the input. One row for each row of docs: doc_id, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space), kept_text (null unless keep_text).

    Null and empty texts have no words. A null doc_id ranks after every number. Rows with the same
    doc_id, repeated ones too, take nothing from each other. A text of any length is one row of its
    chunk; one beyond CHUNK_BYTES makes the chunk as large. An empty table gives an empty table;
    other columns of docs are ignored. Windows are compared by two 64-bit codes.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    chunks, buckets = map(groups, groups_for(docs, "text", CHUNK_BYTES, BUCKET_BYTES))
    by_chunk = in_chunks(docs, chunks.n)
    sent = by_chunk.groupBy("chunk").applyInArrow(_anchors(width, buckets), entry_schema(3))
    shared = dealt(sent, buckets, *_ANCHOR).groupBy("band").applyInArrow(_shared(chunks), entry_schema(1))
    shared = dealt(shared, chunks, np.uint64)
    around = by_chunk.groupBy("chunk").cogroup(shared.groupBy("band")).applyInArrow(_candidates(width, buckets), entry_schema(5))
    kept_by = dealt(around, buckets, *_WINDOW).groupBy("band").applyInArrow(_owners(chunks), entry_schema(3))
    kept_by = dealt(kept_by, chunks, np.uint64, np.uint64, np.int64)
    return by_chunk.groupBy("chunk").cogroup(kept_by.groupBy("band")).applyInArrow(_cleaned(width, keep_text), CLEANED)
