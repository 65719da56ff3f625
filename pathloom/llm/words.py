"""Hashed words of a batch of texts, worked out on the bytes of the Arrow column."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=U64)
_STEP = U64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def byte_mask(*ranges: tuple[int, int]) -> np.ndarray:
    """Truth table of 256 bytes, true inside the closed ranges."""
    mask = np.zeros(256, bool)
    for a, b in ranges:
        mask[a:b + 1] = True
    return mask


#: Words of letters, digits and everything beyond ASCII; words between white space.
LETTERS = byte_mask((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
UNSPACED = ~byte_mask((0x20, 0x20), (0x09, 0x0D))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Words:
    """The words of an Arrow string array without nulls.

    ``hash``: 64 bits of the word with A-Z lowered; ``doc``: which text it is in, in ascending order; ``begin`` and
    ``end``: its bytes in ``data``; ``first``: where each text's words begin, one more entry than texts;
    ``edges``: where each text's bytes begin.
    """

    def __init__(self, texts, inside: np.ndarray):
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
        held = texts.buffers()[2]
        whole = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        data = _LOWER[whole[offsets[0]:offsets[-1]]]
        edges = offsets - offsets[0]
        self.data, self.edges = data, edges
        mask = inside[data]
        start = mask.copy()
        start[1:] &= ~mask[:-1]
        stop = mask.copy()
        stop[:-1] &= ~mask[1:]
        seams = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(data))]  # words do not reach over them
        start[seams] |= mask[seams]
        stop[seams - 1] |= mask[seams - 1]
        self.begin, self.end = np.flatnonzero(start), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.begin, edges)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        if len(self.begin) == 0:
            self.hash = np.zeros(0, U64)
            return
        length = self.end - self.begin
        used = data[mask]  # the words end to end
        at = np.cumsum(length) - length
        place = np.arange(len(used)) - np.repeat(at, length)
        power = np.cumprod(np.concatenate([[U64(1)], np.full(int(length.max()) - 1, _STEP | U64(1))]), dtype=U64)
        sums = np.add.reduceat(_BYTE[used] * power[place], at)
        self.hash = mixed(sums + length.astype(U64) * _STEP)
