"""An FM-index over integer symbols with a wavelet matrix, for many patterns at once.

Suffixes are sorted by their first `depth` symbols, which is all that patterns of up to that
length need: the rows that begin with such a pattern are contiguous, and stepping backwards
from them counts symbols of the transformed text only up to the pattern's own bounds. The
wavelet matrix holds packed bits with a 32-bit running count per 64 of them: 1.5 bits a symbol
and level. With the suffixes' places (32 bits) and common prefixes (16 bits), an index of n symbols of
an alphabet of s takes about n (0.19 log2 s + 6) bytes; what sorting needs is dropped.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-len(bits) % 64 + 64, bool)
        self.words = np.packbits(np.concatenate([bits, pad]), bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int32)
        self.ones = int(counts.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before each i."""
        k = i >> 6
        return self.before[k] + np.bitwise_count(self.words[k] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))


class Wavelet:
    """Occurrences of symbols before positions."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.n, self.levels = len(symbols), []
        for shift in range(max(1, int(most).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift) & 1 == 1
            self.levels.append((shift, Bits(bit)))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.begin = np.searchsorted(_order_key(symbols, self.levels), _order_key(np.arange(most + 1), self.levels))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before i."""
        for shift, bits in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> shift) & 1 == 1, self.n - bits.ones + ones, i - ones)
        return i - self.begin[c]


def _order_key(symbols: np.ndarray, levels: list) -> np.ndarray:
    """The order that the matrix's last level leaves symbols in: by their bits, the lowest first."""
    out, top = np.zeros(len(symbols), np.int64), len(levels)
    for shift, _ in levels:
        out |= ((symbols >> shift) & 1) << (top - 1 - shift)
    return out


def _ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


class FMIndex:
    """Index of texts (lists of symbols, 0 and up), for patterns and matches of up to `depth` symbols."""

    def __init__(self, texts: list[np.ndarray], depth: int):
        self.depth = depth
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = np.concatenate([x for t in texts for x in (t, [np.uint64(0)])]) if texts else np.zeros(0, np.uint64)
        self.begin = np.concatenate([[0], np.cumsum(sizes + 1)])
        ends = self.begin[1:] - 1
        real = np.ones(len(joined), bool)
        real[ends] = False
        self.alphabet, back = np.unique(joined[real], return_inverse=True)
        codes = np.zeros(len(joined), np.int64)  # 0 ends a text
        codes[real] = back + 1
        n = len(codes)
        shifted = lambda r, k: np.concatenate([r[k:], np.zeros(min(k, n), np.int64)])[:n]
        powers, k, r = [(1, codes)], 1, codes
        while 2 * k <= depth:
            r = _ranks(r, shifted(r, k))
            k *= 2
            powers.append((k, r))
        full = _ranks(r, shifted(r, depth - k)) if depth > k else r
        self.sa = np.argsort(full, kind="stable")
        lcp = np.zeros(n + 1, np.int64)
        if n:
            a, b, same = self.sa[:-1].copy(), self.sa[1:].copy(), np.zeros(n - 1, np.int64)
            for k, r in reversed(powers):
                for _ in range(1 + (k == powers[-1][0])):
                    on = (same + k <= depth) & (a < n) & (b < n)
                    on[on] = r[a[on]] == r[b[on]]
                    same += on * k
                    a, b = a + on * k, b + on * k
            equal = full[self.sa[:-1]] == full[self.sa[1:]]
            lcp[1:n] = np.where(equal, depth, np.minimum(same, depth - 1))
        lcp[0] = lcp[n] = -1
        self.lcp = lcp.astype(np.int16 if depth < 1 << 15 else np.int64)  # of each row with the one before
        last = codes[self.sa - 1] if n else codes
        self.sa = self.sa.astype(np.int32)
        self.wavelet = Wavelet(last, len(self.alphabet))
        self.smaller = np.searchsorted(np.sort(codes), np.arange(len(self.alphabet) + 2))
        self._wide: np.ndarray | None = None

    def rows(self, l: np.ndarray, r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of c followed by what rows l to r begin with."""
        both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([l, r])) + np.tile(self.smaller[c], 2)
        return both[: len(l)], both[len(l) :]

    def _spans(self) -> tuple[np.ndarray, np.ndarray]:
        """For each border between rows the next border to either side with a smaller common prefix."""
        if self._wide is None:
            n, h = len(self.lcp), self.lcp
            up, down = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
            for to in (up, down):
                on = np.flatnonzero((h[to] >= h) & (h >= 0))
                while len(on):
                    to[on] = to[to[on]]
                    on = on[h[to[on]] >= h[on]]
            self._wide = np.stack([down, up])
        return self._wide[0], self._wide[1]

    def wider(self, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The smallest wider range of rows with a common prefix, and that prefix's length."""
        down, up = self._spans()
        size = np.maximum(self.lcp[l], self.lcp[r])
        at = np.where(self.lcp[l] >= self.lcp[r], l, r)
        whole = size <= 0
        return np.where(whole, 0, down[at]), np.where(whole, len(self.sa), up[at]), np.maximum(size, 0)

    def cut_to(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row the range of rows that share its first `size` symbols."""
        first = np.flatnonzero(self.lcp[:-1] < size)
        group = np.cumsum(self.lcp[:-1] < size) - 1
        return first[group], np.append(first, len(self.sa))[1:][group]

    def matching_statistics(self, texts: list[np.ndarray]):
        """For each position of the texts (joined) the length, up to depth, of the longest match that begins there, and its rows.

        All texts are read backwards in step. A match that can't be extended is shortened at its
        end to the next wider range of rows until it can; one of full depth is first cut by one symbol.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        joined = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        place = np.minimum(np.searchsorted(self.alphabet, joined), max(0, len(self.alphabet) - 1))
        code = np.where(self.alphabet[place] == joined, place + 1, 0) if len(self.alphabet) else np.zeros(len(joined), np.int64)
        length, low, high = (np.zeros(len(joined), np.int64) for _ in range(3))
        n = len(self.sa)
        lo, hi = self.cut_to(self.depth - 1) if n else (self.sa, self.sa)
        at = begin[1:] - 1
        live = np.flatnonzero(sizes > 0)
        l, r, m = np.zeros(len(texts), np.int64), np.full(len(texts), n), np.zeros(len(texts), np.int64)
        while len(live):
            c = code[at[live]]
            full = live[m[live] >= self.depth]
            r[full], l[full], m[full] = hi[l[full]], lo[l[full]], self.depth - 1
            a, b = self.rows(l[live], r[live], c)
            fits = (b > a) & (c > 0)
            done = fits | (m[live] == 0) | (c == 0)
            ok, none = live[fits], live[done & ~fits]
            l[ok], r[ok], m[ok] = a[fits], b[fits], m[ok] + 1
            l[none], r[none], m[none] = 0, n, 0
            back = live[~done]
            if len(back):
                l[back], r[back], m[back] = self.wider(l[back], r[back])
            step = live[done]
            length[at[step]], low[at[step]], high[at[step]] = m[step], l[step], r[step]
            at[step] -= 1
            live = live[at[live] >= begin[live]]
        return length, low, high
