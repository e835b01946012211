"""FM-index over integer symbols, in numpy: suffix array by prefix doubling, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_array(sym: np.ndarray, sigma: int) -> np.ndarray:
    """Suffix array of `sym` (its last symbol must be unique and least)."""
    n = len(sym)
    bits = max(1, int(sigma - 1).bit_length())
    h = max(1, 62 // bits)
    padded = np.concatenate([sym, np.zeros(h, sym.dtype)]).astype(np.int64)
    key = np.zeros(n, np.int64)
    for k in range(h):
        key = (key << bits) | padded[k : k + n]
    sa = np.argsort(key)
    key = key[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    start = np.flatnonzero(new)
    group = np.repeat(start, np.diff(np.append(start, n)))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = group
    single = new & np.append(new[1:], True)
    slots = np.flatnonzero(~single)
    while len(slots):
        suf = sa[slots]
        comb = (rank[suf] << 32) | (rank[np.minimum(suf + h, n)] + 1)
        o = np.argsort(comb)
        suf, comb = suf[o], comb[o]
        sa[slots] = suf
        new = np.ones(len(slots), bool)
        new[1:] = comb[1:] != comb[:-1]
        start = np.flatnonzero(new)
        rank[suf] = np.repeat(slots[start], np.diff(np.append(start, len(slots))))
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


class FMIndex:
    """Index of a text of code points (uint32); texts in it are parted by SEPARATOR."""

    SEPARATOR = 0xFFFFFFFF

    def __init__(self, codes: np.ndarray):
        seen = np.unique(codes)
        self.alphabet = seen[seen != self.SEPARATOR]
        self.sigma = len(self.alphabet) + 2
        sym = np.searchsorted(self.alphabet, codes) + 2
        sym[codes == self.SEPARATOR] = 1
        sym = np.append(sym, 0)
        self.n = n = len(sym)
        sa = suffix_array(sym, self.sigma)
        self.bwt = sym[sa - 1]
        self.c = np.concatenate([[0], np.cumsum(np.bincount(sym, minlength=self.sigma))])[: self.sigma]
        self.bits = max(1, int(self.sigma - 1).bit_length())
        self.ranks, self.zeros = [], []
        seq = self.bwt.astype(np.int32)
        for level in range(self.bits - 1, -1, -1):
            one = ((seq >> level) & 1).astype(bool)
            cum = np.zeros(n + 1, np.int32)
            np.cumsum(one, out=cum[1:])
            self.ranks.append(cum)
            self.zeros.append(n - int(cum[-1]))
            seq = np.concatenate([seq[~one], seq[one]])
        self.first = self._walk(np.arange(self.sigma), np.zeros(self.sigma, np.int64))
        marked = sa % SAMPLE == 0
        self.marked = marked
        self.mark_rank = np.concatenate([[0], np.cumsum(marked)])
        self.samples = sa[marked]

    def _walk(self, sym: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ranks[k][i]
            i = np.where((sym >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, sym: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the first i places of the transform."""
        return self._walk(sym, i) - self.first[sym]

    def search(self, codes: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the stretches of `width` code points that begin at `start`: those that occur, and their row intervals."""
        at = np.searchsorted(self.alphabet, codes)
        known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == codes if len(self.alphabet) else np.zeros(len(codes), bool)
        strange = np.concatenate([[0], np.cumsum(~known)])
        live = np.flatnonzero(strange[start + width] == strange[start])
        sym = at + 2
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for k in range(width - 1, -1, -1):
            if not len(live):
                break
            s = sym[start[live] + k]
            lo, hi = self.c[s] + self.rank(s, lo), self.c[s] + self.rank(s, hi)
            keep = hi > lo
            live, lo, hi = live[keep], lo[keep], hi[keep]
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps backward until a sampled suffix."""
        out = np.empty(len(rows), np.int64)
        todo, row, steps = np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.marked[row]
            out[todo[hit]] = self.samples[self.mark_rank[row[hit]]] + steps
            todo, row = todo[~hit], row[~hit]
            s = self.bwt[row]
            row = self.c[s] + self.rank(s, row)
            steps += 1
        return out
