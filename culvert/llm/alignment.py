"""Alignment of the tokens of two tokenizers by an event sweep.

Every document gives two runs of events, the ends of its A and of its B tokens. The union of both is
dealt by document and sorted by document and offset, and each task streams its partition through a
machine whose state is the open group: tokens since the last offset at which both sides ended. Where
both end again, the group closes; each distinct end between is a link of the A and the B token that
cover it. The machine takes events a lot at a time, as arrays.

Links of an id pair are counted over the corpus, and every document's links looked up again: a task
numbers the pairs it meets, writes each document's links as numbers, and asks for the count of each
of its pairs once, so what travels is pairs by task and not links.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from culvert.llm.exchange import bounded_batches, packed, unpacked, written
from culvert.llm.packing import _byte_letters

#: Characters of a piece of a text: pieces end where no token of either side can cross.
PIECE = 1 << 16
#: Tokens in a lot, pairs that a task numbers, and bytes of links by number, before it begins anew.
LOT, MAX_PAIRS, MAX_CELLS = 400_000, 1 << 20, 64 << 20
#: Pairs in a row.
PAIR_ROWS = 1 << 16
#: Characters of texts, and unseen words, that are encoded at a time.
LOT_CHARS, TOGETHER = 2 << 20, 20_000
#: Fixed value: the pattern of pre-tokens of GPT-2's byte-level BPE.
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_RUN = re.compile(r"\S{1000}|\s{1000}|[\x1c-\x1f\x85\xa0]")
#: About how many bytes of known words a worker holds, in each of two generations; longest known word.
MEMORY_BYTES, MEMORY_WORD, _ENTRY = 64 << 20, 48, 260
_NONE = 2
#: Blanks and marks before a space between which and the space a text is not cut.
_BLANKS = frozenset(chr(c) for a, b in ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)) for c in range(a, b + 1))
_BLANK = "".join(sorted(_BLANKS - {" "}))
_UNSAFE = re.compile(f"[{_BLANK}] ")
_CUT = re.compile(f"(?<=[^ {_BLANK}]) ")


class ByteBpe:
    """A byte-level BPE file of the tokenizers library, with GPT-2's pre-tokens. Special tokens'
    strings inside texts are plain text."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        own = {letter: byte for byte, letter in _byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(own[c] for c in token) if all(c in own for c in token) else token.encode()

        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        """The same vocabulary for tiktoken, which is faster, if ids are in the order of merges."""
        model = json.loads(Path(path).read_text())["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        place = {token: i for i, token in enumerate("".join(p) for p in pairs)}
        if any(model["vocab"][t] != 256 + i for t, i in place.items()):
            return None
        import tiktoken

        ranks = {self.bytes[i]: i for i in range(256 + len(place))}
        return tiktoken.Encoding("ranked", pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(place) else None

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with its space. tiktoken is for texts of letters whose kind is the
        same in every Unicode version, without runs that it may not get through."""
        if self.fast and max(text) < "\u0250" and not _LONG_RUN.search(text):
            return self.fast.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class PieceBpe:
    """A sentencepiece model without normalisation, which puts a space before its text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = [self._bytes(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size())]
        self.space = self.model.piece_to_id("\u2581")

    @staticmethod
    def _bytes(piece: str) -> bytes:
        if re.fullmatch("<0x[0-9A-F]{2}>", piece):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("\u2581", " ").encode()

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with a space, which stands for the one that the model puts there."""
        return self.model.encode(text[1:]) if len(text) > 1 else [self.space]


@cache
def encoder(path: str) -> Any:
    """One for each file and worker process."""
    return PieceBpe(path) if path.endswith(".model") else ByteBpe(path)


@cache
def lengths(path: str) -> np.ndarray:
    """Bytes of each token."""
    return np.array([len(b) for b in encoder(path).bytes], np.int64)


def pieces(text: str) -> Iterator[str]:
    """A text with a space before it, cut before spaces that follow no blank: neither side has
    tokens across such a place, so pieces can be encoded alone."""
    lo, n = 0, len(text)
    while lo < n:
        cut = _CUT.search(text, lo + PIECE) if n - lo > PIECE else None
        hi = cut.start() if cut else n
        yield ("" if lo else " ") + text[lo:hi]
        lo = hi


def segments(piece: str) -> list[str]:
    """Words of a piece, each without the space before it; of more spaces the others stay with the word.
    The whole piece where a blank stands before a space."""
    if _UNSAFE.search(piece):
        return [piece[1:]]
    words = piece.split(" ")[1:]
    if "" not in words:
        return words
    out, spaces = [], ""
    for w in words:
        if w:
            out.append(spaces + w)
            spaces = ""
        else:
            spaces += " "
    return [*out, spaces[1:]] if spaces else out


class PairEncoder:
    """Ids of both sides, word by word; words are remembered in two generations. New words of many
    pieces are encoded in one text, as no token crosses the space before a word."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.sides = tuple((encoder(p), encoder(p).bytes, lengths(p)) for p in (path_a, path_b))
        self.known: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.old: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})
        self.lossy: set[str] = set()
        self.held = 0

    def _alone(self, word: str) -> tuple[bytes, bytes] | None:
        """Ids of a word; None if a side's tokens have other bytes."""
        raw, found = (" " + word).encode(), []
        for side, table, _ in self.sides:
            ids = side.encode(" " + word)
            if b"".join(map(table.__getitem__, ids)) != raw:
                return None
            found.append(np.array(ids, "<u4").tobytes())
        return found[0], found[1]

    def _together(self, words: list[str]) -> list[tuple[bytes, bytes]] | None:
        """Ids of words, encoded as one text; None if its bytes or places do not come out."""
        text = " " + " ".join(words)
        raw, ends, found = text.encode(), np.cumsum([len(w.encode()) + 1 for w in words]), []
        for side, table, sizes in self.sides:
            ids = side.encode(text)
            if b"".join(map(table.__getitem__, ids)) != raw:
                return None
            array = np.array(ids, "<u4")
            token_ends = np.cumsum(sizes[array])
            last = np.searchsorted(token_ends, ends)
            if (token_ends[last] != ends).any():
                return None
            blob, cuts = array.tobytes(), (4 * (last + 1)).tolist()
            found.append([blob[i:j] for i, j in zip([0, *cuts[:-1]], cuts, strict=True)])
        return list(zip(*found, strict=True))

    def learn(self, lists: list[list[str]]) -> dict[str, tuple[bytes, bytes] | None]:
        """Ids of all words of the lists: the long ones, and in `known` the others."""
        long: dict[str, tuple[bytes, bytes] | None] = {}
        new: dict[str, None] = {}
        known, old = self.known[0], self.old[0]
        for words in lists:
            for w in set(words).difference(known):
                if len(w) > MEMORY_WORD:
                    long[w] = self._alone(w)
                elif w in old:
                    self._keep(w, (old[w], self.old[1][w]))
                else:
                    new[w] = None
        plain = [w for w in new if w and w[-1] not in _BLANKS and " " not in w and "\u2581" not in w]
        for lo in range(0, len(plain), TOGETHER):
            some = plain[lo : lo + TOGETHER]
            for w, ids in zip(some, self._together(some) or map(self._alone, some), strict=True):
                self._keep(w, ids)
        for w in set(new).difference(plain):
            self._keep(w, self._alone(w))
        return long

    def _keep(self, word: str, ids: tuple[bytes, bytes] | None) -> None:
        if ids is None:
            self.lossy.add(word)
            ids = b"", b""
        self.known[0][word], self.known[1][word] = ids
        self.held += _ENTRY + 2 * len(word) + len(ids[0]) + len(ids[1])

    def encode(self, lists: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """A and B ids of each list of segments; None if either side's bytes are not the text's."""
        long = self.learn(lists)
        a, b = (side.__getitem__ for side in self.known)
        for words in lists:
            if long and not long.keys().isdisjoint(words):
                found = [long[w] if w in long else None if w in self.lossy else (a(w), b(w)) for w in words]
                yield None if None in found else tuple(np.frombuffer(b"".join(x), "<u4") for x in zip(*found, strict=True))
            elif self.lossy and not self.lossy.isdisjoint(words):
                yield None
            else:
                yield np.frombuffer(b"".join(map(a, words)), "<u4"), np.frombuffer(b"".join(map(b, words)), "<u4")

    def forget(self) -> None:
        """Begins a new generation of words once this one is large."""
        if self.held > MEMORY_BYTES:
            self.known, self.old, self.held = ({}, {}), self.known, 0
            self.lossy.intersection_update(self.old[0])


@cache
def _pair_encoder(path_a: str, path_b: str) -> PairEncoder:
    return PairEncoder(path_a, path_b)


def _pack_ids(ids: np.ndarray, press: zstandard.ZstdCompressor) -> bytes:
    wide = ids.max(initial=0) >= 1 << 16
    return (b"\x04" if wide else b"\x02") + press.compress(ids.astype("<u4" if wide else "<u2").tobytes())


def _unpack_ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob[1:]), f"<u{blob[0]}").astype(np.int64)


EVENTS = "key bigint, doc_id bigint, at bigint, side int, ids binary"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())


def _lots(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """(key, doc_id, pieces) of the rows of a batch, in lots of about LOT_CHARS."""
    lot, held = [], 0
    for key, doc, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
        lot.append((key, doc, list(pieces(text or ""))))
        held += len(text or "")
        if held > LOT_CHARS:
            yield lot
            lot, held = [], 0
    if lot:
        yield lot


def _events(path_a: str, path_b: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, press = _pair_encoder(path_a, path_b), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for lot in _lots(batch):
                found = both.encode([segments(p) for _, _, cut in lot for p in cut])
                rows: list[tuple] = []
                for key, doc, cut in lot:
                    each = [next(found) for _ in cut]
                    if not each or None in each:
                        rows.append((key, doc, 0, _NONE, None))
                        continue
                    at = 0
                    for piece, sides in zip(cut, each, strict=True):
                        rows += [(key, doc, at, side, _pack_ids(ids, press)) for side, ids in enumerate(sides)]
                        at += len(piece.encode())
                both.forget()
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], names=["key", "doc_id", "at", "side", "ids"])

    return run


def token_events(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Events of documents (doc_id, text): key (a number for each row), doc_id, at (bytes before a
    run's first token), side (0: A, 1: B), ids (the run's tokens; their ends follow from their
    bytes). A text without tokens, or that either side does not give back, is one row of side 2."""
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return keyed.mapInArrow(_events(path_a, path_b), EVENTS)


class _Document:
    """Of a document, what the machine has seen so far."""

    def __init__(self, key: int, doc_id: int | None) -> None:
        self.key, self.doc_id = key, doc_id
        self.digest = None
        self.counts = np.zeros(4, np.int64)  # A tokens, B tokens, groups, links

    def row(self) -> tuple:
        return (self.key, self.doc_id, *self.counts.tolist(), self.digest.hexdigest() if self.digest else "")


class Machine:
    """Sweeps events in order of (document, offset). What it keeps between lots is the open group's
    tokens, the open document's counts and digest, and the numbers given to pairs."""

    def __init__(self, lengths_a: np.ndarray, lengths_b: np.ndarray, chunk: int) -> None:
        self.lengths, self.chunk = (lengths_a, lengths_b), chunk
        most = max(len(lengths_a), len(lengths_b))
        # Ids with what stands before them: nothing, another of the side, the other side, a group.
        words = [mark + str(i) for i in range(most) for mark in ("", ",", "|", ";")]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.letters = np.array(words, "S").view(np.uint8).reshape(len(words), -1)
        self.docs: list[_Document] = []
        self.ends: list[int] = []  # where each of docs ends, over all that has been read
        none = np.empty(0, np.int64)
        self.runs: tuple[list, list] = ([], [])
        self.read = [0, 0]  # bytes read on each side
        self.rest = [(none, none), (none, none)]  # ids and ends of the open group
        self.waiting = 0
        self._new_chunk()

    def _new_chunk(self) -> None:
        self.codes, self.numbers = np.empty(0, np.int64), np.empty(0, np.int64)  # sorted codes and their numbers
        self.order: list[np.ndarray] = []  # codes by number
        self.totals = np.empty(0, np.int64)
        self.cells = 0

    def add(self, key: int, doc_id: int | None, side: int, ids: bytes | None) -> None:
        if not self.docs or self.docs[-1].key != key:
            self.docs.append(_Document(key, doc_id))
            self.ends.append(0)
        if side == _NONE:
            self.ends[-1] = max(self.read)
            return
        run = _unpack_ids(ids)
        ends = self.read[side] + np.cumsum(self.lengths[side][run])
        self.runs[side].append((run, ends))
        self.read[side] = int(ends[-1])
        self.ends[-1] = max(self.read)
        self.waiting += len(run)

    def sweep(self, last: bool) -> Iterator[tuple[str, tuple]]:
        """("doc", row) of documents that are over and ("links", row) of what was swept; at the
        end of a chunk ("pairs", row)."""
        ids, ends = [], []
        for side in (0, 1):
            parts = [self.rest[side], *self.runs[side]]
            ids.append(np.concatenate([p[0] for p in parts]))
            ends.append(np.concatenate([p[1] for p in parts]))
        self.runs, self.waiting = ([], []), 0
        every = np.concatenate(ends)
        order = np.argsort(every, kind="stable")  # of two sorted runs; A stands before B
        every = every[order]
        again = np.concatenate([every[1:] == every[:-1], [False]]) if len(every) else np.empty(0, bool)
        closed = int(np.flatnonzero(again)[-1]) + 2 if again.any() else 0  # events up to the last common end
        cut = [int((order[:closed] < len(ends[0])).sum())]
        cut.append(closed - cut[0])
        self.rest = [(i[k:], e[k:]) for i, e, k in zip(ids, ends, cut, strict=True)]
        if closed:
            yield "links", self._groups(every[:closed], order[:closed] < len(ends[0]), again[:closed], [i[:k] for i, k in zip(ids, cut, strict=True)])
        over = len(self.docs) if last else len(self.docs) - 1
        for doc in self.docs[:over]:
            yield "doc", doc.row()
        del self.docs[:over], self.ends[:over]
        if last or len(self.codes) > MAX_PAIRS or self.cells > MAX_CELLS:
            order = np.concatenate(self.order) if self.order else np.empty(0, np.int64)
            for lo in range(0, len(order), PAIR_ROWS):
                yield "pairs", (self.chunk, lo, packed(order[lo : lo + PAIR_ROWS]), packed(self.totals[lo : lo + PAIR_ROWS]))
            self.chunk += 1
            self._new_chunk()

    def _groups(self, every: np.ndarray, of_a: np.ndarray, both: np.ndarray, ids: list[np.ndarray]) -> tuple:
        """Takes whole groups: the ends of their tokens in order, which of them are of A, and which are
        at the same place as the next (an A end and a B end)."""
        first = np.concatenate([[True], ~both[:-1]])  # one event for each distinct end
        segment, common = every[first], both[first]
        ends_a = of_a[first]
        ends_b = ~ends_a | common
        # Tokens that end before a segment's end are over; the next one of its side covers it.
        a, b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        group = np.cumsum(common) - common
        n = len(self.docs)
        upto = np.searchsorted(segment, np.array(self.ends, np.int64), side="right")
        links = np.diff(upto, prepend=0)
        doc = np.repeat(np.arange(n), links)
        counts = np.stack([np.bincount(doc[x], minlength=n) for x in (ends_a, ends_b, common)] + [links], axis=1)
        self._digests(ids, group[ends_a], group[ends_b], doc[common], counts)
        for own, more in zip(self.docs, counts, strict=True):
            own.counts += more
        return self._cells(doc, ids[0][a] << 32 | ids[1][b])

    def _digests(self, ids: list[np.ndarray], group_a: np.ndarray, group_b: np.ndarray, doc_of_group: np.ndarray, counts: np.ndarray) -> None:
        """Adds the groups, each with its A tokens and then its B tokens, to their documents' digests."""
        groups = len(doc_of_group)
        n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        place_a = np.arange(len(group_a)) + (np.cumsum(n_b) - n_b)[group_a]
        place_b = np.arange(len(group_b)) + np.cumsum(n_a)[group_b]
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        opens = np.concatenate([[True], doc_of_group[1:] != doc_of_group[:-1]])
        if self.docs[doc_of_group[0]].counts[2]:
            opens[0] = False  # the open document has groups already
        index = np.empty(len(group_a) + len(group_b), np.int64)
        index[place_a], index[place_b] = 4 * ids[0] + 1, 4 * ids[1] + 1
        index[place_a[first_a]] += np.where(opens, -1, 2)
        index[place_b[first_b]] += 1
        sizes = self.sizes[index]
        text = self.letters[index][np.arange(self.letters.shape[1]) < sizes[:, None]].tobytes()
        upto = np.concatenate([[0], np.cumsum(sizes)])
        tokens = counts[:, 0] + counts[:, 1]
        for doc, hi, k in zip(self.docs, np.cumsum(tokens).tolist(), tokens.tolist(), strict=True):
            if k:
                doc.digest = doc.digest or hashlib.sha256()
                doc.digest.update(text[upto[hi - k] : upto[hi]])

    def _cells(self, doc: np.ndarray, codes: np.ndarray) -> tuple:
        """Numbers for new pairs; each document's links as numbers and how often."""
        known, inverse, n = np.unique(codes, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.codes, known)
        old = np.zeros(len(known), bool)
        inside = at < len(self.codes)
        old[inside] = self.codes[at[inside]] == known[inside]
        number = np.empty(len(known), np.int64)
        number[old] = self.numbers[at[old]]
        fresh = known[~old]
        number[~old] = len(self.totals) + np.arange(len(fresh))
        self.order.append(fresh)
        self.totals = np.concatenate([self.totals, np.zeros(len(fresh), np.int64)])
        self.totals[number] += n
        self.codes, self.numbers = np.insert(self.codes, at[~old], fresh), np.insert(self.numbers, at[~old], number[~old])
        both, times = np.unique(doc << 32 | number[inverse], return_counts=True)
        doc, number = both >> 32, both & 0xFFFFFFFF
        keys, sizes = np.unique(doc, return_counts=True)
        step = np.diff(number, prepend=0)
        heads = np.cumsum(sizes) - sizes
        step[heads] = number[heads]
        press = zstandard.ZstdCompressor(level=1)
        blobs = [press.compress(packed(x)) for x in (np.array([self.docs[k].key for k in keys.tolist()], np.int64), sizes.astype("<u4"), step.astype("<u4"), times.astype("<u4"))]
        self.cells += sum(map(len, blobs))
        return (self.chunk, *blobs)


_SWEPT = "key bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, chunk bigint, lo bigint, c0 binary, c1 binary, c2 binary, c3 binary"
_PLACES = {"doc": (0, 1, 2, 3, 4, 5, 6), "links": (7, 9, 10, 11, 12), "pairs": (7, 8, 9, 10)}


def _sweep(lengths_a: np.ndarray, lengths_b: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(lengths_a, lengths_b, TaskContext.get().partitionId() << 32)
        kinds = [*[pa.int64()] * 6, pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        names = [c.split()[0] for c in _SWEPT.split(", ")]

        def rows(last: bool) -> pa.RecordBatch:
            found = []
            for kind, values in machine.sweep(last):
                row = [None] * len(kinds)
                for k, v in zip(_PLACES[kind], values, strict=True):
                    row[k] = v
                found.append(row)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], kind) for k, kind in enumerate(kinds)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "side", "ids")), strict=True):
                machine.add(*row)
                if machine.waiting > LOT:
                    yield rows(False)
        yield rows(True)

    return run


def swept(events: DataFrame, lengths_a: np.ndarray, lengths_b: np.ndarray) -> DataFrame:
    """What the machine makes of events (see token_events), each side's tokens having these bytes:
    rows of documents, of their links by number, and of the numbered pairs, by chunk."""
    return events.repartition("key").sortWithinPartitions("key", "at", "side").mapInArrow(_sweep(lengths_a, lengths_b), _SWEPT)


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, lo, codes, n in zip(*(batch.column(c).to_pylist() for c in ("chunk", "lo", "c0", "c1")), strict=True):
            code = unpacked(codes, np.int64)
            columns = [np.full(len(code), chunk), lo + np.arange(len(code)), code, unpacked(n, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["chunk", "number", "code", "n"])


def _scores(most: np.ndarray):
    """most: the largest count of each B id."""

    def run(links: pa.Table, told: pa.Table) -> pa.Table:
        """(key, n_best, count_sum) of the documents of a chunk's links."""
        number, total = np.asarray(told.column("number")), np.asarray(told.column("total"))
        counts, best = np.zeros(number.max(initial=-1) + 1, np.int64), np.zeros(number.max(initial=-1) + 1, np.int64)
        counts[number], best[number] = total, total == most[np.asarray(told.column("b"))]
        out: list[list[np.ndarray]] = [[], [], []]
        for row in zip(*(links.column(c) for c in ("c0", "c1", "c2", "c3")), strict=True):
            keys, sizes, step, times = (unpacked(zstandard.decompress(x.as_buffer()), kind).astype(np.int64) for x, kind in zip(row, (np.int64, "<u4", "<u4", "<u4"), strict=True))
            heads = np.cumsum(sizes) - sizes
            upto = np.cumsum(step)
            at = upto - np.repeat(upto[heads] - step[heads], sizes)
            for k, values in enumerate((keys, np.add.reduceat(best[at] * times, heads), np.add.reduceat(counts[at] * times, heads))):
                out[k].append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else np.empty(0, np.int64)) for c in out], names=["key", "n_best", "count_sum"])

    return run


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(chunk, number, b, total) of numbered pairs (chunk, number, code, n), a row each: the B id, and
    the links of the id pair over the corpus. A pair has at most a row a chunk."""
    total = F.sum("n").over(Window.partitionBy("code")).alias("total")
    return written(pairs.select("chunk", "number", F.col("code").bitwiseAND(0xFFFFFFFF).alias("b"), total))


def largest_counts(told: DataFrame, b_ids: int) -> np.ndarray:
    """The largest total of each B id, an array of the vocabulary's length."""
    most = np.zeros(b_ids, np.int64)
    for b, n in told.groupBy("b").agg(F.max("total")).collect():
        most[b] = n
    return most


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of documents (doc_id,
    text), a row each.

    A: a byte-level BPE file over a space and the text; B: a sentencepiece model, which puts that
    space itself. Offsets are bytes of the two together. Groups end where A and B tokens both end;
    links are the A-B token pairs whose bytes overlap. count_sum adds, over a document's links, how
    many links of the corpus have the same two ids; n_best counts links whose ids no other A id
    exceeds for that B id, ties included. groups_sha256 is of `a1,a2|b1;a3|b2,b3`.

    A text that is null or empty, or that either side's tokens do not give back byte by byte, has
    no tokens: zeros and ''. Repeated rows get a row each and count each; a null doc_id stays
    null. A text of any length is taken a piece at a time. No rows give none; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    bytes_a, bytes_b = lengths(path_a), lengths(path_b)
    found = written(swept(token_events(docs, path_a, path_b), bytes_a, bytes_b))
    numbered = found.filter("lo IS NOT NULL").select("chunk", "lo", "c0", "c1")
    pairs = numbered.mapInArrow(_pair_rows, "chunk bigint, number bigint, code bigint, n bigint")
    told = pair_counts(pairs)
    links = found.filter("c3 IS NOT NULL").select("chunk", "c0", "c1", "c2", "c3")
    scores = links.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_scores(largest_counts(told, len(bytes_b))), "key bigint, n_best bigint, count_sum bigint")
    rows = found.filter("key IS NOT NULL").select("key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    both = rows.unionByName(scores, allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")]
    return both.groupBy("key").agg(F.max("doc_id").alias("doc_id"), *sums, F.max("groups_sha256").alias("groups_sha256")).drop("key")
