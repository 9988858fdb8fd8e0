"""Texts cut into units that a lower-casing BPE encodes alone, each unit once.

White space ends a token in such a vocabulary, and runs of letters, of digits and of
other signs never share one.  A block's units are found, hashed and numbered as arrays;
only units that the worker has not met yet reach the encoder, and the ids of whole
texts are gathered from a pool.  A stretch between blanks that holds an apostrophe
(contractions), a ``<`` (special tokens) or a character beyond Latin-1 letters is one
unit, whole, and left to the encoder's full rules.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from . import vectext

REMEMBERED = 1_500_000
_BLANKS = (0x20, 0x09, 0x0A)


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, 3, np.uint8)
    kind[0x80:] = 1
    for first in (0x41, 0x61):
        kind[first : first + 26] = 1
    kind[0x30:0x3A] = 2
    kind[list(_BLANKS)] = 0
    odd = np.zeros(256, bool)
    odd[[*range(0x00, 0x20), 0x27, 0x3C, 0x7F, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
    odd[list(_BLANKS)] = False
    return kind, odd


_KIND, _ODD = _classes()


def split(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every unit, and the n + 1 unit bounds of the documents."""
    n = len(data)
    kind = np.zeros(n + 1, np.uint8)
    kind[:n] = _KIND[data]
    odd = _ODD[data]
    # After the lead byte of a Latin-1 letter, two signs are not letters.
    lead = np.flatnonzero(data == 0xC3)
    follow = data[np.minimum(lead + 1, n - 1)] if n else data
    odd[lead[(follow == 0x97) | (follow == 0xB7)]] = True
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    cut[1:] |= kind[1:] != kind[:-1]
    if odd.any():
        edge = (kind[1:] == 0) | (kind[:-1] == 0)
        hard = np.zeros(n + 1, bool)
        hard[bounds] = True
        hard[1:] |= edge
        where = np.flatnonzero(hard)
        many = np.add.reduceat(odd, where[:-1]) if len(where) > 1 else np.zeros(0)
        for k in np.flatnonzero(many).tolist():
            cut[where[k] + 1 : where[k + 1]] = False
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    full = kind[starts] > 0
    starts, ends = starts[full], ends[full]
    hashes = vectext.span_hash(vectext.LOWER[data], starts, ends)
    if odd.any() and len(starts):  # special tokens are matched before case is folded
        strange = np.flatnonzero(np.add.reduceat(odd, starts) > 0)
        hashes[strange] = vectext.span_hash(data, starts[strange], ends[strange]) ^ np.uint64(0x0DD)
    return starts, ends, vectext.mix(hashes), np.searchsorted(starts, bounds)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start .. start + length of all spans, one after another."""
    ends = np.cumsum(lengths)
    out = np.arange(ends[-1] if len(ends) else 0)
    out += np.repeat(starts - (ends - lengths), lengths)
    return out


class Memo:
    """Ids of the units met so far; ``encode`` takes units' texts, gives ids and counts."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.slots[at], -1)

    def texts(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts, and the n + 1 id bounds of its documents."""
        starts, ends, hashes, per_doc = split(data, bounds)
        keys, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > REMEMBERED:
            self._forget()
        slots = self._slots(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw = data.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            ids, counts = self.encode([raw[s:e].decode() for s, e in spans])
            slots[new] = len(self.first) + np.arange(len(new))
            self.first = np.concatenate((self.first, self.used + np.cumsum(counts) - counts))
            self.count = np.concatenate((self.count, counts))
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate((self.pool, np.zeros(max(len(ids), len(self.pool)), np.uint16)))
            self.pool[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            where = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, where, keys[new])
            self.slots = np.insert(self.slots, where, slots[new])
        slot = slots[inverse]
        counts = self.count[slot]
        bounds = np.concatenate(([0], np.cumsum(counts)))[per_doc]
        return self.pool[spread(self.first[slot], counts)], bounds
