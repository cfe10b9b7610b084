"""Word positions and hashes of many texts at once, with numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Two odd numbers, so that their powers can be divided out modulo 2**64, and two of a mixing step that is public knowledge (MurmurHash3's finalizer).
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
#: ASCII letters in lower case and digits stay, and all bytes of other characters; the rest becomes blank.
PLAIN = bytes(c if c >= 0x80 else ord(chr(c).lower()) if chr(c).isalnum() else 0x20 for c in range(256))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64. Kept by power of two."""
    return _powers(base, max(16, (n - 1).bit_length()))[:n]


@cache
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.full(1 << bits, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX[0]
    h = (h ^ (h >> np.uint64(33))) * MIX[1]
    return h ^ (h >> np.uint64(33))


class Words:
    """The words of texts in order: start and end in buffer; text i has words first[i] .. first[i+1]-1."""

    def __init__(self, texts: list[bytes]) -> None:
        self.buffer = b" " + b" ".join(texts) + b" "
        self.bytes = np.frombuffer(self.buffer, np.uint8)
        space = SPACE[self.bytes]
        self.start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        self.end = np.flatnonzero(~space[:-1] & space[1:]) + 1
        begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, begin)

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes: the difference of two prefix sums of a polynomial, with the offset divided out."""
        n = len(self.bytes)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, n), out=sums[1:])
        return mixed((sums[self.end] - sums[self.start]) * powers(pow(BYTE_BASE, -1, 1 << 64), n)[self.start])

    def runs(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """For every k consecutive words of one text: number of its first word, hash. words: hashes()."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * np.uint64(WORD_BASE) + words[i : i + n]
        inside = np.ones(n, bool)
        for cut in range(1, k):
            at = self.first[1:-1] - cut
            inside[at[(at >= 0) & (at < n)]] = False
        return np.flatnonzero(inside), mixed(h[inside])
