"""Shingle sets of many texts at once, as sorted 64-bit hashes in NumPy arrays.

A word is hashed by a polynomial over its bytes modulo 2**64, taken as a difference of running sums, so that all
words of a piece of text are hashed together.  Words end at ASCII white space and A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from greenspark.llm.common import ASCII_LOWER

_RANDOM = np.random.default_rng(20240501)
ODD = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64)
_VALUE = _VALUE[np.frombuffer(ASCII_LOWER, np.uint8)]
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
PIECE_BYTES = 1 << 20


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[41]
    h = (h ^ (h >> np.uint64(29))) * ODD[42]
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Sets of ``size``-word shingles; a text of fewer words has its whole word sequence as its one shingle."""

    def __init__(self, size: int):
        self.size = size
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, count: int) -> None:
        """Powers of the base and of its inverse, for pieces of up to ``count`` bytes."""
        if len(self.up) >= count:
            return
        base = int(ODD[43])
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            table, done = np.ones(count, np.uint64), 1
            while done < count:
                more = min(done, count - done)
                table[done:done + more] = table[:more] * np.uint64(pow(b, done, 1 << 64))
                done += more
            tables.append(table)
        self.up, self.down = tables

    def _words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and hash of every word; memory for hashing is bounded by PIECE_BYTES and the longest word."""
        blank = _BLANK[data]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]])))
        starts, ends = edges[::2], edges[1::2]
        hashes = np.empty(len(starts), np.uint64)
        k = 0
        while k < len(starts):
            first = starts[k]
            last = max(int(np.searchsorted(ends, first + PIECE_BYTES, "right")), k + 1)
            piece = data[first:ends[last - 1]]
            self._powers(len(piece))
            total = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_VALUE[piece] * self.up[:len(piece)], out=total[1:])
            at = starts[k:last] - first
            hashes[k:last] = _mixed((total[ends[k:last] - first] - total[at]) * self.down[at])
            k = last
        return starts, hashes

    def sets(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, bounds): the sorted distinct shingles of text i are tokens[bounds[i]:bounds[i + 1]]."""
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        begin = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(r) + 1 for r in raw], out=begin[1:])
        starts, h = self._words(np.frombuffer(b" ".join(raw), np.uint8))
        if not len(h):
            return np.empty(0, np.uint64), np.zeros(len(raw) + 1, np.int64)
        word = np.searchsorted(starts, begin)
        n_words = np.diff(word)
        n_grams = np.maximum(n_words - self.size + 1, np.minimum(n_words, 1))
        bounds = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(n_grams, out=bounds[1:])
        own = np.repeat(np.arange(len(raw)), n_grams)
        at = np.arange(bounds[-1]) + (word[:-1] - bounds[:-1])[own]
        beyond = word[1:][own]
        grams = np.zeros(len(own), np.uint64)
        for k in range(self.size):
            grams = (grams ^ np.where(at + k < beyond, h[np.minimum(at + k, len(h) - 1)], np.uint64(0))) * ODD[k]
            grams ^= grams >> np.uint64(29)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            grams[a:b].sort()
        first = np.ones(len(grams), bool)
        first[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])
        return grams[first], np.concatenate([[0], np.cumsum(first)])[bounds]

    def pieces(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``sets`` of stretches [first, last) of the texts, each of about PIECE_BYTES or one text."""
        first, held = 0, 0
        for k, text in enumerate(texts):
            held += len(text) if text else 0
            if held >= PIECE_BYTES or k + 1 == len(texts):
                yield first, k + 1, *self.sets(texts[first:k + 1])
                first, held = k + 1, 0
