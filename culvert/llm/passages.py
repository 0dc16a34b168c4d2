"""Helpers of the operators that remove repeated passages: batches of texts as word codes, sets of
codes, and texts written again without some of their words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert.llm import words as wd
from culvert.llm.exchange import NO_ID

#: Documents of a chunk that are read together.
BATCH = 500
CLEANED = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"


class Texts:
    """Words and codes of a batch of documents."""

    def __init__(self, ids: pa.Array, text: pa.Array) -> None:
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        buf, at = wd.text_buffer(text)
        starts, ends, self.bounds = wd.find_words(buf, at, wd.SPACED)
        self.codes = wd.word_codes(buf, starts, ends)
        self.n = np.diff(self.bounds)


def batches_of(docs: pa.Table) -> Iterator[Texts]:
    return (Texts(x.column("doc_id"), x.column("text")) for x in docs.to_batches(max_chunksize=BATCH))


class Known:
    """A set of codes that very many codes are held against; most are turned away by a table of bits."""

    def __init__(self, codes: np.ndarray, bits: int = 22) -> None:
        self.codes, self.shift = np.sort(codes), np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.codes >> self.shift).astype(np.int64)] = True

    def where(self, codes: np.ndarray) -> np.ndarray:
        """Places of the codes that are in the set."""
        maybe = np.flatnonzero(self.seen[(codes >> self.shift).astype(np.int64)]) if len(self.codes) else np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.codes, codes[maybe]), len(self.codes) - 1)
        return maybe[self.codes[at] == codes[maybe]] if len(maybe) else maybe


def cleaned_rows(texts: Texts, batch: pa.RecordBatch, keep: np.ndarray, keep_text: bool) -> list[tuple]:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of a batch, given which words stay."""
    lost = np.concatenate([[0], np.cumsum(~keep)])[texts.bounds]
    raws, rows = batch.column("text").fill_null("").cast(pa.binary()), []
    for k, (i, raw) in enumerate(zip(batch.column("doc_id"), raws, strict=True)):
        gone = int(lost[k + 1] - lost[k])
        kept = raw.as_py().split()
        if gone:
            kept = compress(kept, keep[texts.bounds[k] : texts.bounds[k + 1]])
        out = b" ".join(kept)
        rows.append((i.as_py(), int(texts.n[k]), gone, hashlib.sha256(out).hexdigest(), out.decode() if keep_text else None))
    return rows


def cleaned_table(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def in_chunks(docs: DataFrame, chunks: int) -> DataFrame:
    """Documents (doc_id, text) with their chunk: by id and text, as ids may be null or repeated."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
