"""Packing of tokenised documents into fixed windows: concatenate and cut.

Pass one tokenises each document once, writes the ids to the shared folder with the document's
offset in its partition, and sums the tokens of each partition. Prefix sums of those sums give
every document a place in one long stream of ids. Pass two cuts the stream at multiples of the
window; a document that lies across a cut gives one piece on each side. All sequences are full
but the last.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from culvert.llm.exchange import bounded_batches, written

#: About how many bytes a worker's memory of words takes, in each of two generations of whole words
#: and two of their parts, and the longest word (bytes) that it keeps.
MEMORY_BYTES, MEMORY_WORD = 80 << 20, 64
#: Bytes of a remembered word beside its own and its ids.
_ENTRY = 160
#: Partitions of the input whose offsets (16 bytes each) are broadcast at most; more are joined by a shuffle.
BROADCAST_PARTS = 500_000
_TOKENS = "doc_id bigint, doc_tokens bigint, ids binary, part int, part_start bigint"
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: printable bytes stand for
    themselves, the others for the letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordTokenizer:
    """Ids of whole texts by a lower-casing byte-level BPE whose pre-tokenizer drops blanks.

    Such a tokenizer never joins text across blanks, so ids of blank-separated words are
    remembered. An unseen word of Latin letters with ASCII marks after it is two pre-tokens, which
    go to the BPE model alone; any other unseen word goes through the whole tokenizer. Words of more
    than MEMORY_WORD bytes are remembered for their own text only.
    """

    _made: dict[str, WordTokenizer] = {}
    _MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        self.held = self.held_parts = 0

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """One for each worker process."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def encode(self, texts: list[bytes], end: int) -> Iterator[bytes]:
        """For each UTF-8 text its ids and the end id, as little-endian unsigned 32-bit numbers."""
        last = int(end).to_bytes(4, "little")
        for text in texts:
            words = text.split()
            known, long = self.known, {}
            for word in set(words).difference(known):
                ids = self.old.get(word) or self._word(word)
                if len(word) > MEMORY_WORD:
                    long[word] = ids
                else:
                    known[word] = ids
                    self.held += len(word) + len(ids) + _ENTRY
            found = map(known.__getitem__, words) if not long else (long[w] if w in long else known[w] for w in words)
            yield b"".join(found) + last
            if self.held > MEMORY_BYTES:
                self.known, self.old, self.held = {}, known, 0
            if self.held_parts > MEMORY_BYTES:
                self.parts, self.old_parts, self.held_parts = {}, self.parts, 0

    def _word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if word.isascii():
            low = word.lower()
        elif max(word) < "\u0250":  # none of them has a lower case that depends on its neighbours
            low = unicodedata.normalize("NFC", word).lower()
        else:
            low = ""
        core = low.rstrip(self._MARKS)
        if not core.isalpha():
            return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
        ids = self.parts.get(core) or self._part(core)
        if len(core) == len(low):
            return ids
        marks = low[len(core) :]
        return ids + (self.parts.get(marks) or self._part(marks))

    def _part(self, text: str) -> bytes:
        if (ids := self.old_parts.get(text)) is None:
            spelt = text if text.isascii() else text.encode().decode("latin-1").translate(self.letters)
            made = [t.id for t in self.model.tokenize(spelt)]
            ids = struct.pack(f"<{len(made)}I", *made)
        if len(text) <= MEMORY_WORD:
            self.parts[text] = ids
            self.held_parts += 2 * len(text) + len(ids) + _ENTRY
        return ids


def _tokenise(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, at, part = WordTokenizer.of(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            texts = [x.as_py() for x in batch.column("text").fill_null("").cast(pa.binary())]
            ids = list(tokenizer.encode(texts, end))
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            narrow = [_narrow(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n), pa.array(narrow, pa.binary()), pa.array(np.full(len(n), part, np.int32)), pa.array(starts)],
                names=["doc_id", "doc_tokens", "ids", "part", "part_start"],
            )

    return run


def _narrow(ids: bytes) -> bytes:
    """Ids in two bytes each where they fit; a first byte tells the width."""
    wide = np.frombuffer(ids, dtype="<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if wide.max(initial=0) < 1 << 16 else b"\x04" + ids


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<u{blob[0]}", offset=1).astype("<u4")


def _cut(window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "base", "part_start")]
            for blob, doc, n, base, start in zip(batch.column("ids"), *cols, strict=True):
                ids, first = memoryview(_wide(blob.as_buffer()).tobytes()), base + start
                at = 0
                while at < n:
                    k = min(n - at, window - (first + at) % window)
                    piece = ids[4 * at : 4 * (at + k)]
                    rows.append((doc, at, k, zlib.crc32(piece), n, (first + at) // window, (first + at) % window, bytes(piece) if with_ids else None))
                    at += k
            kinds = [*[pa.int64()] * 7, pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end: int = 2, with_ids: bool = True) -> DataFrame:
    """Pieces of documents (doc_id, text) in sequences of at most `window` ids.

    One row a piece: doc_id, start (ids of its document before it), length, ids_crc32 (of its ids
    as little-endian unsigned 32-bit numbers), doc_tokens (ids of the document with the end id),
    sequence_id, offset (in the sequence, gapless from 0) and ids (those numbers; null unless
    with_ids). Each id lies in exactly one piece; every sequence but the last is full.

    A null or empty text is the end id alone. A text of any length is tokenised whole. Repeated rows are packed each; a null doc_id stays
    null. An empty table gives no pieces. Other columns of docs are ignored.
    `tokenizer` is the path of a tokenizer file of the kind that WordTokenizer describes.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    tokens = written(docs.mapInArrow(_tokenise(tokenizer, end), _TOKENS), compression="zstd")
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
    # One row for each partition of the input, not for each document.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = written(totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base")))
    few = bases.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS
    return tokens.join(F.broadcast(bases) if few else bases, "part").mapInArrow(_cut(window, with_ids), _PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences of pack(..., with_ids=True): sequence_id, n_ids, ids (binary, in order)."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), joined.alias("ids"))
