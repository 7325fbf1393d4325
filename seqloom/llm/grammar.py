"""Recompression of integer sequences into a run-length grammar, and longest common extensions read off it.

The sequence is rewritten in rounds until all its symbols differ. A block round replaces every maximal block of one symbol by a
symbol for (symbol, length); a pair round splits the alphabet into left and right symbols and replaces every left symbol that a
right one follows, with it, by a symbol for the pair. Both look at neighbours only, so equal stretches are rewritten alike but for
their rims: two positions are compared by climbing while their symbols are equal, where at most one symbol or block has to be passed
to reach a place where both have a boundary in the next round, and, from the round in which they differ, by going down again, where at
most one child is equal. All queries of a call move together as numpy arrays, so a round costs a few array operations.
"""

from __future__ import annotations

import numpy as np

#: Multipliers of the hash that gives a symbol its side in a round (odd 64-bit numbers).
MIX, STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03


class Level:
    """A round: first[u] is the first symbol below that u stands for (one entry more than symbols), up[u] what the symbol u below is part of.

    ``right`` has the sides of the symbols below in a pair round and is None in a block round.
    """

    def __init__(self, below: np.ndarray, first: np.ndarray, symbols: np.ndarray, right: np.ndarray | None):
        self.first = np.append(first, len(below))
        starts = np.zeros(len(below), np.int64)
        starts[first] = 1
        self.up = np.cumsum(starts) - 1
        self.symbols, self.right = symbols, right


def _named(symbols: np.ndarray, at: np.ndarray, keys: np.ndarray, used: int) -> int:
    """Give the symbols at ``at`` new names, equal for equal keys; returns how many names are used now."""
    distinct, names = np.unique(keys, return_inverse=True)
    symbols[at] = used + names
    return used + len(distinct)


class Grammar:
    """Grammar of ``sequence`` (non-negative integers), whose first and last values occur nowhere else."""

    def __init__(self, sequence: np.ndarray):
        self.bottom = np.ascontiguousarray(sequence, np.int64)
        self.levels: list[Level] = []
        symbols, used, turn = self.bottom, int(self.bottom.max(initial=0)) + 1, 0
        while len(symbols) > 1 and np.bincount(symbols, minlength=1).max() > 1:
            first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
            if len(first) < len(symbols):
                sizes, now = np.diff(np.append(first, len(symbols))), symbols[first]
                many = np.flatnonzero(sizes > 1)
                used = _named(now, many, now[many] * (len(symbols) + 1) + sizes[many], used)
                self.levels.append(Level(symbols, first, now, None))
                symbols = now
            turn += 1
            mix, add = np.uint64(MIX), np.uint64(turn * STEP % (1 << 64))
            right = ((symbols.astype(np.uint64) * mix + add) * mix >> np.uint64(63)).astype(bool)
            second = np.flatnonzero(~right[:-1] & right[1:]) + 1
            if len(second):
                first = np.delete(np.arange(len(symbols)), second)
                now = symbols[first]
                at = second - 1 - np.arange(len(second))
                used = _named(now, at, symbols[second - 1] * used + symbols[second], used)
                self.levels.append(Level(symbols, first, now, right))
                # names are dense again, so that bincount and the keys stay small
                _, symbols = np.unique(now, return_inverse=True)
                used = int(symbols.max()) + 1
                self.levels[-1].symbols = symbols

    def _symbols(self, level: int) -> np.ndarray:
        return self.levels[level - 1].symbols if level else self.bottom

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the sequence goes on alike from i and from j; i and j differ."""
        return self._extend(i, j, 1)

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the sequence is alike before i and before j; i and j differ and are above 0."""
        return self._extend(i, j, -1)

    def _extend(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        """u and v are places between symbols; what comes next is at ``u - back``."""
        back = 0 if way > 0 else 1
        u, v = np.array(i, np.int64), np.array(j, np.int64)
        stopped = np.zeros(len(u), np.int64)
        live = np.arange(len(u))
        for n in range(len(self.levels) + 1):
            symbols = self._symbols(n)
            same = symbols[u[live] - back] == symbols[v[live] - back]
            stopped[live[~same]] = n
            live = live[same]
            if not len(live):
                break
            level = self.levels[n]  # the last round has no equal symbols
            a, b = u[live] - back, v[live] - back
            pa, pb = level.up[a], level.up[b]
            if level.right is not None:
                # the next symbol may be the far half of a pair in one place only: then it is passed
                passed = level.right[a] if way > 0 else ~level.right[a]
                u[live], v[live] = (pa + passed, pb + passed) if way > 0 else (pa + 1 - passed, pb + 1 - passed)
                continue
            left_a, left_b = (level.first[pa + 1] - a, level.first[pb + 1] - b) if way > 0 else (a + 1 - level.first[pa], b + 1 - level.first[pb])
            whole = (left_a == level.first[pa + 1] - level.first[pa]) & (left_b == level.first[pb + 1] - level.first[pb])
            odd = ~whole & (left_a != left_b)  # the shorter rest is passed, then the symbols differ in this round
            rest = way * np.minimum(left_a, left_b)[odd]
            u[live[odd]] += rest
            v[live[odd]] += rest
            stopped[live[odd]] = n
            on = ~odd
            passed = ~whole[on]
            u[live[on]], v[live[on]] = (pa[on] + passed, pb[on] + passed) if way > 0 else (pa[on] + 1 - passed, pb[on] + 1 - passed)
            live = live[on]
        for n in range(int(stopped.max(initial=0)), 0, -1):
            level, below = self.levels[n - 1], self._symbols(n - 1)
            down = np.flatnonzero(stopped >= n)
            pa, pb = u[down] - back, v[down] - back
            a, b = level.first[u[down]], level.first[v[down]]
            same = below[a - back] == below[b - back]
            size = np.ones(len(down), np.int64) if level.right is not None else np.minimum(level.first[pa + 1] - level.first[pa], level.first[pb + 1] - level.first[pb])
            u[down], v[down] = a + way * same * size, b + way * same * size
        return way * (u - np.asarray(i, np.int64))
