"""Edit distances of sequences and the places that a shortest edit script sets against each other."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Cells of a distance table held at once; longer sequences are halved first.
TABLE_CELLS = 50_000_000


def _numbers(*sequences: Sequence) -> list[np.ndarray]:
    """The sequences as arrays in which equal members have equal numbers."""
    known: dict = {}
    return [np.fromiter((known.setdefault(x, len(known)) for x in s), np.int32, len(s)) for s in sequences]


def _rows(a: np.ndarray, b: np.ndarray, band: int) -> np.ndarray:
    """Edit distances of all beginnings, as far as they lie within ``band`` of the diagonal: cell k of row i is column i + k - band."""
    n, m, wide = len(a), len(b), 2 * band + 1
    far, cell = n + m + 1, np.arange(wide, dtype=np.int32)
    # Column j - 1 of row i is at i + k here, so that a row meets its members of ``b`` in one slice.
    shifted = np.full(n + wide + m, -1, np.int32)
    shifted[band + 1 : band + 1 + m] = b
    out = np.full((n + 1, wide), far, np.int32)
    start = cell - band
    out[0][(start >= 0) & (start <= m)] = start[(start >= 0) & (start <= m)]
    for i in range(1, n + 1):
        above = out[i - 1]
        best = above + (shifted[i : i + wide] != a[i - 1])
        best[:-1] = np.minimum(best[:-1], above[1:] + 1)
        best = np.minimum.accumulate(best - cell) + cell
        column = start + i
        best[(column < 0) | (column > m)] = far
        out[i] = np.minimum(best, far)
    return out


def _ends(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all of ``a`` to each beginning of ``b``, in one row."""
    place = np.arange(len(b) + 1, dtype=np.int32)
    row = place.copy()
    for i, x in enumerate(a, 1):
        best = np.empty_like(row)
        best[0] = i
        best[1:] = np.minimum(row[:-1] + (b != x), row[1:] + 1)
        row = np.minimum.accumulate(best - place) + place
    return row


def links(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Places of ``a`` and ``b`` that a shortest edit script sets against each other, equal or exchanged, in order.

    Of equal scripts, read from the end, exchanging goes before leaving out, and that before putting in. The distance table
    is as wide as the distance needs; sequences too long for one are halved where both halves together are nearest.
    """
    x, y = _numbers(a, b)
    return _links(x, y)


def _links(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    n, m = len(x), len(y)
    if not n or not m:
        return []
    band = max(8, abs(n - m))
    while (n + 1) * (2 * band + 1) <= TABLE_CELLS or n < 2:
        rows = _rows(x, y, band)
        if rows[n, m - n + band] <= band or band >= max(n, m):
            break
        band = min(2 * band, max(n, m))
    else:
        half = n // 2
        cut = int((_ends(x[:half], y) + _ends(x[half:][::-1], y[::-1])[::-1]).argmin())
        return _links(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in _links(x[half:], y[cut:])]
    found, i, j = [], n, m
    while i and j:
        k = j - i + band
        if rows[i - 1, k] + (x[i - 1] != y[j - 1]) == rows[i, k]:
            i, j = i - 1, j - 1
            found.append((i, j))
        elif k + 1 < rows.shape[1] and rows[i - 1, k + 1] + 1 == rows[i, k]:
            i -= 1
        else:
            j -= 1
    return found[::-1]


def distance(a: Sequence, b: Sequence) -> int:
    """Edit distance; the table is as wide as the distance needs, or one row where it would be too large."""
    x, y = _numbers(a, b)
    n, m = len(x), len(y)
    band = max(8, abs(n - m))
    while (n + 1) * (2 * band + 1) <= TABLE_CELLS:
        found = int(_rows(x, y, band)[n, m - n + band])
        if found <= band or band >= max(n, m):
            return found
        band = min(2 * band, max(n, m))
    return int(_ends(x, y)[m])
