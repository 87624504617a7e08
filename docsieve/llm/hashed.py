"""Hashes of the words and character n-grams of a text, as numpy arrays.

A text goes through in slices of code points, so that memory follows neither
its length nor that of a word: what a word or an n-gram needs of the slice
before is carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points of a slice.
SLICE = 1 << 15
_A, _B, _C = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35), np.uint32(0x9E3779B1)
SPACE = 32


def mixed(x: np.ndarray) -> np.ndarray:
    """32-bit hashes whose bits all depend on all bits of ``x`` (uint32)."""
    x = x ^ (x >> np.uint32(16))
    x *= _A
    x ^= x >> np.uint32(13)
    x *= _B
    x ^= x >> np.uint32(16)
    return x


def slices(text: str, size: int | None = None) -> Iterator[np.ndarray]:
    """Code points of a whole text, slice by slice."""
    size = size or SLICE
    for i in range(0, len(text), size):
        yield np.frombuffer(text[i : i + size].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def white(codes: np.ndarray) -> np.ndarray:
    """Which code points are white space: 20 and 09 to 0D."""
    return (codes == SPACE) | (codes - np.uint32(9) <= np.uint32(4))


class Words:
    """Word hashes of a text whose slices come one by one; a word may go over slices.

    ``stem``: 0, or the number of first code points that a second hash of each
    word covers; the hashes then have two columns.
    """

    def __init__(self, stem: int = 0):
        self.stem, self.length = stem, 0
        self.sums = np.zeros((1, 2 if stem else 1), dtype=np.uint32)

    def _hashes(self, sums: np.ndarray) -> np.ndarray:
        return mixed(sums) if self.stem else mixed(sums[:, 0])

    def feed(self, codes: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """Hashes of the words that end before or in this slice; ``gap`` marks what lies between words."""
        at = np.flatnonzero(~gap)
        if not len(at):
            return self.end()
        cut = np.concatenate([[0], np.flatnonzero(np.diff(at) > 1) + 1])
        sizes = np.diff(cut, append=len(at))
        starts = at[cut]
        place = at - np.repeat(starts, sizes)
        goes_on = bool(self.length) and starts[0] == 0
        done = self.end() if self.length and not goes_on else self._hashes(self.sums[:0])
        if goes_on:
            place[: sizes[0]] += self.length
        value = mixed(codes[at] * _C + place.astype(np.uint32))
        sums = [np.add.reduceat(value, cut, dtype=np.uint32)]
        if self.stem:
            sums.append(np.add.reduceat(np.where(place < self.stem, value, np.uint32(0)), cut, dtype=np.uint32))
        sums = np.stack(sums, axis=1)
        if goes_on:
            sums[:1] += self.sums
        if at[-1] == len(codes) - 1:  # the last word may go on
            self.length = int(sizes[-1]) + (self.length if goes_on and len(cut) == 1 else 0)
            self.sums, sums = sums[-1:], sums[:-1]
        else:
            self.length = 0
        return np.concatenate([done, self._hashes(sums)])

    def end(self) -> np.ndarray:
        """The word that is open, if any, ends here."""
        if not self.length:
            return self._hashes(self.sums[:0])
        self.length = 0
        return self._hashes(self.sums)


def ngrams(codes: np.ndarray, before: int, lengths: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Hashes of the n-grams of each length (ascending) that end after the first ``before`` code points.

    White space is one kind of mark: an n-gram may start or end with it, but
    not have it inside, so that n-grams stay within a word and its marks.
    """
    gap = white(codes)
    codes = np.where(gap, np.uint32(SPACE), codes)
    spaces = np.cumsum(gap, dtype=np.int32)
    h, have = codes * _C, 1
    for n in lengths:
        for k in range(have, n):
            h = (h[: len(codes) - k] + codes[k:]) * _C
        have = n
        first = max(0, before - n + 1)
        count = len(codes) - n + 1 - first
        if count > 0:
            # marks from the first to the last but one, less those at the first itself
            pure = spaces[first + n - 2 : first + n - 2 + count] == spaces[first : first + count]
            own = h[first : first + count][pure] + np.uint32(n)
            yield own ^ (own >> np.uint32(15))
