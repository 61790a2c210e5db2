"""Ids of words met before, held by a Python worker in flat arrays and looked up by 64-bit hashes for whole blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from llm import blocks as B

#: Words that a table holds at most, and its slots. A full table starts anew: this bounds memory and changes no result.
MAX_WORDS, SLOTS = 1_000_000, 1 << 21


class WordTable:
    """Open addressing in numpy. Hashes are keyed by a secret of the table (see blocks.keyed_hashes)."""

    def __init__(self):
        self.secret = B.drawn_key()
        self.keys, self.place = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.clear()

    def clear(self) -> None:
        self.keys[:] = 0
        self.count, self.used = 0, 0
        self.start, self.size = np.zeros(MAX_WORDS, np.int64), np.zeros(MAX_WORDS, np.int32)
        self.flat = np.zeros(1 << 20, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        key = self.keys[slot]
        out = np.where(key == h, self.place[slot], -1)
        going = np.flatnonzero((key != h) & (key != 0))
        while len(going):
            slot[going] = (slot[going] + 1) & (SLOTS - 1)
            key = self.keys[slot[going]]
            hit = key == h[going]
            out[going[hit]] = self.place[slot[going[hit]]]
            going = going[~hit & (key != 0)]
        return out

    def add(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Distinct hashes that are not there yet, with their words' ids end to end and how many each has."""
        n = len(h)
        while self.used + sizes.sum() > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + sizes.sum()] = ids
        self.start[self.count : self.count + n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.count : self.count + n] = sizes
        slot, place = (h & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(self.count, self.count + n, dtype=np.int32)
        going = np.arange(n)
        while len(going):  # of words that seek one free slot the last written gets it
            free = self.keys[slot[going]] == 0
            self.keys[slot[going[free]]] = h[going[free]]
            got = self.keys[slot[going]] == h[going]
            self.place[slot[going[got]]] = place[going[got]]
            going = going[~got]
            slot[going] = (slot[going] + 1) & (SLOTS - 1)
        self.count, self.used = self.count + n, self.used + int(sizes.sum())

    def ids(self, data: np.ndarray, words: B.Words, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has; encode gives those of words not met before."""
        h = np.maximum(B.limb_hashes(data, words, self.secret), np.uint64(1))
        place = self.find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            if self.count + len(new) > MAX_WORDS:
                self.clear()
                new = np.arange(len(h))
            found, at, which = np.unique(h[new], return_index=True, return_inverse=True)
            raw = data.tobytes()
            at = new[at]
            ids, sizes = encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(words.begin[at].tolist(), words.end[at].tolist(), strict=True)])
            if len(found) > MAX_WORDS:  # a text of its own with more words than a table holds: they are not kept
                return _taken(ids, np.cumsum(sizes) - sizes, sizes.astype(np.int64), which)
            self.add(found, ids, sizes)
            place[new] = self.find(h[new])
        return _taken(self.flat, self.start, self.size.astype(np.int64), place)


def _taken(flat: np.ndarray, start: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words at these places end to end, and how many each has."""
    start, size = start[place], size[place]
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)], size
