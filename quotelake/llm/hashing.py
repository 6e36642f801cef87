"""Hashes of the words of many texts at once, with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are hashed in slices of about so many bytes: some 40 bytes of memory for each.
HASHED_BYTES = 1 << 20
#: Random numbers for places in a word (from there on they repeat).
PLACES = 65_536
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every bit depends on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) in one array, and where each begins."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


class Words:
    """Words of ASCII-white-space-separated texts, A-Z in lower case, as 64-bit hashes.

    A word's hash is a mixed sum over its bytes of a random number for the byte (one for both cases of a letter,
    0 for white space) times a random odd number for the place.
    """

    def __init__(self):
        self.byte = mixed(np.arange(1, 257, dtype=np.uint64) * MIX[0])
        self.byte[ord("A") : ord("Z") + 1] = self.byte[ord("a") : ord("z") + 1]
        self.blank = np.zeros(256, bool)
        self.blank[[32, *range(9, 14)]] = True
        self.byte[self.blank] = 0
        self.place = mixed(np.arange(1, PLACES + 1, dtype=np.uint64) * MIX[1]) | np.uint64(1)

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of consecutive texts in one buffer of UTF-8, and where the words of each text begin among them."""
        if not len(raw):
            return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
        solid = ~self.blank[raw]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        heads = offsets[:-1][offsets[:-1] < len(raw)]
        first[heads] = solid[heads]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
        at = np.arange(starts[0], len(raw), dtype=np.int64) - np.repeat(starts, np.diff(starts, append=len(raw)))
        terms = self.byte[raw[starts[0] :]] * self.place[at % PLACES]
        return mixed(np.add.reduceat(terms, starts - starts[0])), np.searchsorted(starts, offsets)
