"""Words of whole texts, as byte offsets and 64-bit codes, computed on Arrow buffers with numpy.

Every function works on one Arrow batch inside a task. Memory is a small multiple of the
batch; the wide temporaries (eight bytes for each byte of text) are made a segment at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 17
_U = np.uint64


def _table(is_word) -> np.ndarray:
    return np.array([bool(is_word(b)) for b in range(256)])


#: Words `[^\x20\x09-\x0D]+`.
SPACED = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for lower-cased text.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
_RUNS = np.array([0 if not SPACED[b] else 1 if ALNUM[b] or 0x41 <= b <= 0x5A else 2 for b in range(256)], dtype=np.uint8)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)

_draw = np.random.default_rng(20240607)
_BYTE = _draw.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASES = [int(x) | 1 for x in _draw.integers(1 << 62, 1 << 63, 3)]


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    up, down = np.full(n, base, dtype=np.uint64), np.full(n, pow(base, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_UP, _DOWN = zip(*(_powers(b, SEGMENT + 1) for b in _BASES), strict=True)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and each row's bounds in them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[buf]


def find_words(buf: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and the bounds of each row in them."""
    if not len(buf):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = kind[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    head = at[:-1][at[:-1] < at[1:]]
    tail = at[1:][at[:-1] < at[1:]] - 1
    first[head], last[tail] = inside[head], inside[tail]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, at)


def find_runs(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As find_words, of runs of letters and digits and runs of other marks; blanks separate."""
    if not len(buf):
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    kind = _RUNS[buf]
    change = np.empty(len(buf) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:-1])
    change[at] = True
    cuts = np.flatnonzero(change)
    own = kind[cuts[:-1]] > 0
    starts = cuts[:-1][own]
    return starts, cuts[1:][own], np.searchsorted(starts, at)


def word_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code for each word; equal words have equal codes."""
    n, lo = len(starts), 0
    out = np.empty(n, np.uint64)
    while lo < n:
        a = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, a + SEGMENT, side="right")))
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        if e[-1] > SEGMENT:  # one word longer than a segment
            out[lo] = int.from_bytes(hashlib.blake2b(buf[a : a + e[-1]].tobytes(), digest_size=8).digest(), "little")
        else:
            sums = np.zeros(e[-1] + 1, np.uint64)
            np.cumsum(_BYTE[buf[a : a + e[-1]]] * _UP[0][: e[-1]], out=sums[1:])
            out[lo:hi] = mix((sums[e] - sums[s]) * _DOWN[0][s] + (e - s).astype(np.uint64))
        lo = hi
    return out


def window_codes(codes: np.ndarray, width: int, which: int = 1) -> np.ndarray:
    """A code for each run of `width` words: entry i covers words i to i + width - 1.

    which (1 or 2) selects one of two independent codes. Runs that cross rows are not left out
    (see within_rows); there are max(0, n - width + 1) entries.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, step = np.empty(n, np.uint64), SEGMENT - width
    for lo in range(0, n, step):
        k = min(step, n - lo)
        sums = np.zeros(k + width, np.uint64)
        part = codes[lo : lo + k + width - 1]
        np.cumsum(part * _UP[which][: len(part)], out=sums[1:])
        out[lo : lo + k] = mix((sums[width:] - sums[:k]) * _DOWN[which][:k] + _U(width))
    return out


def within_rows(bounds: np.ndarray, width: int) -> np.ndarray:
    """For each of the entries of window_codes, whether all its words lie in one row."""
    n = max(0, int(bounds[-1]) - width + 1)
    row_end = np.repeat(bounds[1:], np.diff(bounds))[:n]
    return np.arange(n) + width <= row_end


def owner(bounds: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
