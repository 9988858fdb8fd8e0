"""Whole batches of texts as numpy arrays: bytes, words, rolling hashes.

A batch of texts is one byte array plus document starts and ends, taken from the
Arrow buffers without making Python strings.  Words are found with a byte table
and hashed eight bytes at a time side by side, so a batch costs a few array passes
whatever the number of its documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes worked on at a time; a longer document is a block of its own.
BLOCK = 1_000_000
# Spans longer than this are hashed one by one.
LONG = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _table(pattern_excluded: range | list[range]) -> np.ndarray:
    table = np.ones(256, bool)
    for part in pattern_excluded:
        table[part.start : part.stop] = False
    return table


# Byte tables of the two word patterns; bytes of 0x80 and above are word bytes,
# so a multi-byte character is never cut.
NOT_SPACE = _table([range(0x20, 0x21), range(0x09, 0x0E)])
ALNUM = _table([range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
ALNUM_FOLDED = ALNUM[LOWER]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting is several times faster than ``np.unique`` here."""
    values = np.sort(values)
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return values[fresh]


def flatten(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts (null: empty) and the n + 1 document bounds."""
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1]
    bounds = bounds.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def blocks(bounds: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes; every document whole."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, bounds) of each block of a batch's texts."""
    data, bounds = flatten(texts)
    for i, j in blocks(bounds):
        yield i, j, data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number; zeros after the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: eight bytes a step, mixed before the next.

    No sum of the spans' bytes, so spans of repeating structure don't cancel out; of n
    different spans about n * n / 2**65 pairs share a hash.
    """
    size, eight = ends - starts, _eights(data)
    h = eight[starts] & _LOW[np.minimum(size, 8)]
    h = mix(h ^ size.astype(np.uint64) * _STEP)
    live = np.flatnonzero((size > 8) & (size <= LONG))
    for at in range(8, LONG, 8):
        if at > 8:
            live = live[size[live] > at]
        if not len(live):
            break
        more = eight[starts[live] + at] & _LOW[np.minimum(size[live] - at, 8)]
        h[live] = mix(h[live] ^ more)
    long = np.flatnonzero(size > LONG)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        spans = zip(starts[long].tolist(), ends[long].tolist(), strict=True)
        h[long] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in spans]
    return h


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two adjoining stretches from theirs; neither order nor sums are lost."""
    out = a * _STEP
    out ^= b
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def window_hash(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit hashes of the ``length`` (8 at least) bytes from each position in ``at``.

    Stretches of 8, 16, 32, ... bytes are hashed at all positions, each from two halves,
    and those that make up ``length`` are joined.
    """
    eight = _eights(data)
    h, size, offset, out, left = mix(eight[: len(data)]), 8, 0, None, length // 8
    while left:
        if left & 1:
            part = h[at + offset]
            out = part if out is None else _join(out, part)
            offset += size
        left >>= 1
        if left:
            h = _join(h[:-size], h[size:]) if len(h) > size else h[:0]
            size *= 2
    return _join(out, eight[at + length - 8]) if length % 8 else out


def words(
    data: np.ndarray, bounds: np.ndarray, table: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the n + 1 word bounds of the documents."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = table[data]
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(
    data: np.ndarray, bounds: np.ndarray, table: np.ndarray, fold: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased if ``fold``, and word bounds."""
    starts, ends, per_doc = words(data, bounds, table)
    return span_hash(LOWER[data] if fold else data, starts, ends), per_doc


_COMBINE = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words, over document ends too."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += h[i : n + i] * _COMBINE[i]
    return mix(out)
