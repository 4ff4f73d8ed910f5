"""Global alignment of long pairs in linear memory, inside a band that is proven wide enough.

The dynamic programme runs row by row over a band of diagonals. Its states are kept at a few
rows only; a stretch between two of them is worked out again when the trace comes to it, and
cut again where it is still large, so that memory is that of a few rows.

The band starts narrow. An alignment that leaves it has a known least number of gap letters
and so a greatest possible score; once the score found inside is above that, every best
alignment lies inside the band, ties included, and the trace is the one that the whole table
would give. Otherwise the band is doubled.
"""

from __future__ import annotations

import numpy as np

LOW = -1e18
#: Bytes of the table of origins that a stretch may take, and rows kept of a longer one.
TABLE, PARTS = 8 << 20, 8
FIRST_BAND = 64


class _Band:
    """The programme over diagonals first to last (place in b less place in a)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, score: np.ndarray, opening: float, extending: float, first: int, last: int):
        self.a, self.b, self.score = a, b, score
        self.opening, self.extending, self.first, self.last = opening, extending, first, last

    def columns(self, row: int) -> tuple[int, int]:
        """From and to (inclusive) of a row's places in b."""
        return max(0, row + self.first), min(len(self.b), row + self.last)

    def start(self) -> np.ndarray:
        lo, hi = self.columns(0)
        state = np.full((3, hi - lo + 1), LOW)
        state[0, 0] = 0
        state[2, 1:] = -self.opening - self.extending * np.arange(hi - lo)
        return state

    def first_origins(self) -> np.ndarray:
        lo, hi = self.columns(0)
        out = np.zeros(hi - lo + 1, np.uint8)
        out[2:] = 2 << 4
        return out

    def step(self, row: int, state: np.ndarray, origins: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """The states (substitution, gap in b, gap in a) of a row from those of the one
        before, and where each came from: bits 1-2, 3-4, 5-6 as in align.py."""
        lo, hi = self.columns(row)
        before_lo, before_hi = self.columns(row - 1)
        old = np.full((3, hi - lo + 2), LOW)  # columns lo - 1 to hi
        old[:, before_lo - lo + 1 : before_hi - lo + 2] = state
        h, e, f = old
        out = np.full((3, hi - lo + 1), LOW)
        best = np.maximum(np.maximum(h, e), f)[:-1]
        skip = 1 if lo == 0 else 0  # nothing is substituted before b begins
        out[0, skip:] = best[skip:] + self.score[self.a[row - 1], self.b[lo + skip - 1 : hi]]
        from_h, from_f, from_e = h[1:] - self.opening, f[1:] - self.opening, e[1:] - self.extending
        out[1] = np.maximum(np.maximum(from_h, from_f), from_e)
        place = np.arange(lo, hi + 1)
        begun = np.maximum(out[0], out[1]) - self.opening + self.extending * (place + 1)
        run = np.maximum.accumulate(begun)
        out[2, 1:] = run[:-1] - self.extending * place[1:]
        if not origins:
            return out, None
        came = np.zeros(hi - lo + 1, np.uint8)
        came[skip:] = np.where((h >= e) & (h >= f), 0, np.where(e >= f, 1, 2))[:-1][skip:]
        came |= np.where(from_h >= out[1], 0, np.where(from_e >= out[1], 1, 2)).astype(np.uint8) << 2
        fresh = np.where(out[0, :-1] >= out[1, :-1], 0, 1)
        came[1:] |= np.where(begun[:-1] >= run[:-1], fresh, 2).astype(np.uint8) << 4
        return out, came

    def trace(self, top: int, bottom: int, state: np.ndarray, kept: list[tuple[int, np.ndarray]] | None, at: tuple[int, int, int], moves: list[int]) -> tuple[int, int, int]:
        """Follow the alignment from ``at`` (row bottom, column, state) up to row top, whose
        states are given. kept: rows between whose states are known."""
        width = min(len(self.b), bottom - top + self.last - self.first) + 1
        if kept is None and (bottom - top) * width > TABLE and bottom - top > 1:
            kept = self.forward(top, bottom, state)[1]
        if kept is not None:
            edges = [(top, state), *kept]
            for (row, own), end in zip(reversed(edges), [bottom, *(r for r, _ in reversed(kept))]):
                at = self.trace(row, end, own, None, at, moves)
            return at
        rows = {}
        for row in range(top + 1, bottom + 1):
            state, rows[row] = self.step(row, state, True)
        i, j, s = at
        while i > top:
            lo = self.columns(i)[0]
            cell = int(rows[i][j - lo])
            moves.append(s)
            if s == 0:
                i, j, s = i - 1, j - 1, cell & 3
            elif s == 1:
                i, s = i - 1, 1 if j == 0 else cell >> 2 & 3
            else:
                j, s = j - 1, 2 if i == 0 else cell >> 4 & 3
            if not i and j:
                s = 2
            elif i and not j:
                s = 1
        return i, j, s

    def forward(self, top: int, bottom: int, state: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The states of row bottom, and of some rows between."""
        keep, kept = {top + (bottom - top) * k // PARTS for k in range(1, PARTS)} - {top, bottom}, []
        for row in range(top + 1, bottom + 1):
            state, _ = self.step(row, state, False)
            if row in keep:
                kept.append((row, state))
        return state, kept

    def beyond(self) -> float:
        """The most that an alignment which leaves the band can score."""
        n, m = len(self.a), len(self.b)
        gap = lambda k: self.opening + self.extending * (k - 1) if k > 0 else 0.0
        gain = lambda x, y: np.concatenate([[0], np.cumsum(np.sort(np.maximum(self.score[np.ix_(x, np.unique(y))].max(axis=1), 0))[::-1])])
        out = -np.inf
        if self.last < m:
            more = self.last + 1
            out = max(out, gain(self.b, self.a)[m - more] - gap(more) - gap(more - (m - n)))
        if -self.first < n:
            more = 1 - self.first
            out = max(out, gain(self.a, self.b)[n - more] - gap(more) - gap(more + m - n))
        return out


def align(a: np.ndarray, b: np.ndarray, score: np.ndarray, opening: float, extending: float) -> tuple[list[int], float]:
    """(moves from the front: 0 a pair of letters, 1 a gap in b, 2 a gap in a; the score) of
    two sequences of letter numbers, neither empty."""
    n, m = len(a), len(b)
    half = FIRST_BAND
    while True:
        band = _Band(a, b, score, opening, extending, max(-n, min(0, m - n) - half), min(m, max(0, m - n) + half))
        start = band.start()
        end, kept = band.forward(0, n, start)
        total = end[:, m - band.columns(n)[0]]
        if total.max() > band.beyond():
            break
        half *= 2
    moves: list[int] = []
    i, j, _ = band.trace(0, n, start, kept, (n, m, int(np.argmax(total))), moves)
    moves += [2] * j  # what is left lies in the first row
    return moves[::-1], float(total.max())
