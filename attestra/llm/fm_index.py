"""A compressed full-text index over word numbers, searched for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

ONE, LOW = np.uint64(1), np.uint64(63)


class Bits:
    """A bit vector in 64-bit words, with the ones counted before each."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        below = (ONE << (i.astype(np.uint64) & LOW)) - ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class Wavelet:
    """A wavelet matrix: how often a symbol occurs before a position, in one step for each bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in reversed(range(max(1, (n_symbols - 1).bit_length()))):
            ones = (symbols >> shift & 1).astype(bool)
            self.levels.append((shift, Bits(ones), len(symbols) - int(ones.sum())))
            symbols = np.concatenate([symbols[~ones], symbols[ones]])
        self.base = self.moved(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def moved(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(symbol >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.moved(symbol, i) - self.base[symbol]


def suffix_order(text: np.ndarray, n_symbols: int, depth: int) -> np.ndarray:
    """Starts of the text's suffixes in order, by prefix doubling. text: symbols that are all unique at every depth-th place or sooner."""
    n, base, width = len(text), n_symbols + 1, 1
    rank = text.astype(np.int64) + 1
    key = rank.copy()
    while base ** (width + 1) < 1 << 62 and width < 4:
        key *= base
        key[:-width] += rank[width:]
        width += 1
    while True:
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])]) + 1
        if width >= depth or new[order[-1]] == n:
            return order
        key = new * (n + 1)
        key[:-width] += new[width:]
        width *= 2


class FmIndex:
    """Index of texts, all of ``window`` words or more. words: numbers from 1; ends: where each text ends in words; owner: the owner of each text."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owner: np.ndarray, window: int) -> None:
        self.window, self.lengths, n_texts = window, lengths, len(lengths)
        n_words = int(words.max()) + 1
        stops = np.cumsum(lengths + 1) - 1
        self.text = np.zeros(len(words) + n_texts, np.int64)
        inside = np.ones(len(self.text), bool)
        inside[stops] = False
        self.text[inside] = words
        self.stops = stops
        marked = self.text + n_texts - 1  # the end of each text is a symbol of its own, below all words
        marked[stops] = np.arange(n_texts)
        order = suffix_order(marked, n_texts + n_words, int(lengths.max()) + 1)
        self.wavelet = Wavelet(self.text[order - 1], n_words)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=n_words))[:-1]])
        # suffixes that share their first `window` words lie together; those that end sooner are alone
        differs = np.zeros(len(order), bool)
        differs[0] = True
        for i in range(window):
            symbol = marked[np.minimum(order + i, len(marked) - 1)]
            differs[1:] |= symbol[1:] != symbol[:-1]
        self.group = np.cumsum(differs) - 1
        self.group_start = np.flatnonzero(differs)
        self.group_end = np.append(self.group_start[1:], len(order))
        owners = np.repeat(owner, lengths + 1)[order]
        self.least = np.minimum.reduceat(owners, self.group_start)

    def streamed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of the texts against the index, cut at ``window`` words: (text, start, least owner of a text with the same words from there).

        All texts are read from their ends at once. A backward step puts a word before the match; a match of over
        ``window`` words loses its last one, which widens its interval to that of its first ``window`` words.
        """
        by_length = np.argsort(-self.lengths, kind="stable")
        lengths = self.lengths[by_length]
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), len(self.text), np.int64)
        out = []
        for t in range(1, int(lengths[0]) + 1):
            n = int(np.searchsorted(-lengths, -t, "right"))
            low, high, symbol = low[:n], high[:n], self.text[self.stops[by_length[:n]] - t]
            low = self.first[symbol] + self.wavelet.rank(symbol, low)
            high = self.first[symbol] + self.wavelet.rank(symbol, high)
            if t >= self.window:
                group = self.group[low]
                found = high > low
                out.append((by_length[:n][found], (lengths[:n] - t)[found], self.least[group][found]))
                low, high = self.group_start[group], self.group_end[group]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))
