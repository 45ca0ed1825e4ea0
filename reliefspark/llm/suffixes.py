"""Suffix sorting by hash-compared mergesort.

Prefix polynomial hashes (modulo 2^64, over random 64-bit numbers for the bytes) give
the hash of any substring from two prefix values, so a binary search over lengths finds
the common extension of two suffixes in logarithmic time. Mergesort places each suffix
of a block among those of the neighbouring block by binary search. Neighbours in the
result are then compared byte by byte: if equal hashes ever misled a comparison, the
order shows it, and those suffixes are sorted again by their bytes.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20)
BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Suffixes:
    """Suffixes of a byte matrix's rows: row r holds length[r] bytes, then anything."""

    def __init__(self, rows: np.ndarray, length: np.ndarray):
        self.rows, self.length = rows, length
        n, width = rows.shape
        self.prefix, scale = np.zeros((n, width + 1), np.uint64), powers(BASE, width)
        for i in range(0, n, 4096):
            np.cumsum(BYTE[rows[i : i + 4096]] * scale, axis=1, out=self.prefix[i : i + 4096, 1:])
        self.steps = max(1, int(width).bit_length())

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of rows a and b, by binary search over hashes."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.length[a], self.length[b])
        for _ in range(self.steps):
            mid = (low + high + 1) // 2
            same = self.prefix[a, mid] == self.prefix[b, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as row a sorts before, with or after row b."""
        k = self.common(a, b)
        end_a, end_b = k >= self.length[a], k >= self.length[b]
        last = self.rows.shape[1] - 1
        x = np.where(end_a, -1, self.rows[a, np.minimum(k, last)].astype(np.int64))
        y = np.where(end_b, -1, self.rows[b, np.minimum(k, last)].astype(np.int64))
        return np.sign(x - y)

    def order(self, group: np.ndarray) -> np.ndarray:
        """Rows sorted by group and, within a group, by their bytes (equal rows by row number)."""
        at = np.argsort(group, kind="stable")
        g = group[at]
        first = np.searchsorted(g, g, "left")
        size = np.searchsorted(g, g, "right") - first
        width, place = 1, np.arange(len(at)) - first
        while width < size.max(initial=0):
            todo = np.flatnonzero(size > width)
            row, p = at[todo], place[todo]
            block = p // width
            own = block * width
            other = np.where(block % 2 == 0, own + width, own - width)
            n_other = np.clip(size[todo] - other, 0, width)
            low, high = np.zeros(len(todo), np.int64), n_other.copy()
            right = block % 2 == 1
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                rival = at[first[todo[open_]] + other[open_] + mid]
                sign = self.before(rival, row[open_])
                under = (sign < 0) | ((sign == 0) & right[open_])  # ties: the left block comes first
                low[open_] = np.where(under, mid + 1, low[open_])
                high[open_] = np.where(under, high[open_], mid)
            to = np.minimum(own, other) + (p - own) + low
            at[first[todo] + to] = row
            width *= 2
        return at

    def sorted_with_common(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, and for each place the bytes shared with the place before (-1 at a group's start)."""
        at = self.order(group)
        shared = self._verified(at, group)
        if shared is None:  # a hash collision misled the sort
            text = [self.rows[r, : self.length[r]].tobytes() for r in range(len(self.length))]
            at = np.array(sorted(range(len(text)), key=lambda r: (group[r], text[r], r)), np.int64)
            shared = self._verified(at, group)
        return at, shared

    def _verified(self, at: np.ndarray, group: np.ndarray) -> np.ndarray | None:
        shared = np.full(len(at), -1, np.int64)
        if len(at) < 2:
            return shared
        a, b = at[:-1], at[1:]
        most = np.minimum(self.length[a], self.length[b])
        differs = self.rows[a] != self.rows[b]
        k = np.minimum(np.where(differs.any(1), differs.argmax(1), differs.shape[1]), most)
        last = self.rows.shape[1] - 1
        x = np.where(k >= self.length[a], -1, self.rows[a, np.minimum(k, last)].astype(np.int64))
        y = np.where(k >= self.length[b], -1, self.rows[b, np.minimum(k, last)].astype(np.int64))
        same = group[a] == group[b]
        if np.any(same & (x > y)):
            return None
        shared[1:] = np.where(same, k, -1)
        return shared
