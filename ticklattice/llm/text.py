"""Words and rolling hashes of whole Arrow batches, computed on UTF-8 bytes with numpy.

All separators are ASCII, so splitting bytes splits characters.  Words and windows are hashed through a scrambling of
64-bit values that is one-to-one and not linear, so no arrangement of equal parts cancels out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that one numpy pass handles; a longer text is a pass of its own.
PASS_BYTES = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of the benchmark words: every ASCII character but 0-9 and a-z.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[0x30:0x3A] = NOT_ALNUM[0x61:0x7B] = NOT_ALNUM[0x80:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary array; null rows are empty."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    if array.null_count:
        array = array.fill_null(b"" if pa.types.is_binary(array.type) or pa.types.is_large_binary(array.type) else "")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def passes(array: pa.Array, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    _, at = utf8(array)
    lo = 0
    while lo < len(array):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, at: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of each maximal run of bytes that are not separators; no word crosses a row."""
    inside = np.empty(len(raw) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~separator[raw]
    edges = np.unique(at[1:-1])
    edges = edges[(edges > 0) & (edges < len(raw))]
    starts = inside[1:-1] & ~inside[:-2]
    starts[edges] = inside[1:-1][edges]
    ends = inside[1:-1] & ~inside[2:]
    ends[edges - 1] = inside[1:-1][edges - 1]
    first, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return first, end, np.searchsorted(at, first, "right") - 1


#: Words of more bytes than this are hashed one by one with XXH64.
LONG_WORD = 64
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_hashes(raw: np.ndarray, first: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; hashes of different seeds are independent.

    Eight bytes at a time go through a one-to-one scrambling, so words of one length up to 8 never collide.
    """
    size = end - first
    padded = np.zeros(len(raw) + 16, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 9,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    # The length opens the chain; then eight bytes at a time, for fewer and fewer words.
    out = mix((eight[first] & _MASK[np.minimum(size, 8)]) ^ (size.astype(np.uint64) * np.uint64(_BASE)) + np.uint64((seed * _BASE) % (1 << 64)))
    at, own = 8, np.flatnonzero((size > 8) & (size <= LONG_WORD))
    while len(own):
        out[own] = mix((out[own] + np.uint64(_BASE)) ^ (eight[first[own] + at] & _MASK[np.minimum(size[own] - at, 8)]))
        at += 8
        own = own[size[own] > at]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(raw[first[k] : end[k]].tobytes(), seed)
    return out


def window_hashes(hashes: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of each ``length`` consecutive values, by its first position: a tree of scrambled pairs over powers of two."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = np.uint64(seed | 1)
    level, width, at, out = mix(hashes ^ np.uint64(seed)), 1, 0, None
    while True:
        if length & width:
            part = level[at : at + n]
            out = part if out is None else mix(out * odd + part)
            at += width
        if 2 * width > length:
            return mix(out + np.uint64(length))
        level = mix(level[:-width] * odd + level[width:])
        width *= 2


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from prefix and suffix minima of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    size = -(-n // width) * width
    padded = np.full(size, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])
