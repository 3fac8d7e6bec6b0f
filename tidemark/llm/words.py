"""Words of whole columns of text, cut and hashed in numpy straight from Arrow's buffers.

ASCII capitals are folded through the hash table, so no lower-cased copy of the text is made.  A word's hash is a
polynomial over random 64-bit values of its bytes, taken from prefix sums over slices of the buffer, then mixed.  What
is held beside the text is a few 8-byte values for each word, and a few for each byte of one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text that are cut at a time, about (whole rows); and bytes that are hashed at a time, whatever a row holds.
CHUNK, SLICE = 1 << 19, 1 << 16

_BYTES = np.arange(256)
#: Words between white space: every byte but 0x20 and 0x09 to 0x0D.
SPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
#: Words of digits, letters and everything beyond ASCII.
ALNUM = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
    | (_BYTES >= 0x80)
)

_VALUES = np.random.default_rng(90210).integers(1, 2**63, 256, dtype=np.int64).astype(U) | U(1)
_VALUES[0x41:0x5B] = _VALUES[0x61:0x7B]
_STEP = 0xD1342543DE82EF95


def _powers(base: int) -> np.ndarray:
    steps = np.full(SLICE + 1, base, U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers(_STEP), _powers(pow(_STEP, -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = (column if wide or pa.types.is_string(column.type) else column.cast(pa.string())).buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if column.null_count and (np.diff(off)[column.is_null().to_numpy(zero_copy_only=False)] > 0).any():
        return buffers(pc.fill_null(column, ""))
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive whole rows with about ``size`` bytes."""
    data, off = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def cut(data: np.ndarray, off: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, pointers): row r's words are starts[pointers[r]:pointers[r + 1]]."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = kind[data]
    edge = off[(off > 0) & (off < n)]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[edge] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[edge - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, off)


def _long(word: np.ndarray) -> int:
    """The sum of one word of any length, by slices."""
    total = 0
    for lo in range(0, len(word), SLICE):
        part = word[lo : lo + SLICE]
        total += int((_VALUES[part] * _UP[: len(part)]).sum(dtype=U)) * pow(_STEP, lo, 1 << 64)
    return total % (1 << 64)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes; the stretches are in order and do not overlap."""
    out, lo, sums = np.zeros(len(starts), U), 0, np.zeros(SLICE + 1, U)
    while lo < len(starts):
        at = int(starts[lo])
        hi = int(np.searchsorted(ends, at + SLICE, "right"))
        if hi <= lo:
            out[lo] = _long(data[at : ends[lo]])
            lo += 1
            continue
        part = data[at : ends[hi - 1]]
        np.cumsum(_VALUES[part] * _UP[: len(part)], out=sums[1 : len(part) + 1])
        first, last = starts[lo:hi] - at, ends[lo:hi] - at
        out[lo:hi] = (sums[last] - sums[first]) * _DOWN[first]
        lo = hi
    return mix(out)


def word_hashes(data: np.ndarray, off: np.ndarray, kind: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, pointers by row)."""
    starts, ends, pointers = cut(data, off, kind)
    return hashes(data, starts, ends), pointers


def text_hashes(words: list[str]) -> np.ndarray:
    """Hashes of single words, equal to those they get inside a text."""
    data, off = buffers(pa.array(words, pa.string()))
    return hashes(data[: off[-1]], off[:-1], off[1:]) if len(words) else np.zeros(0, U)
