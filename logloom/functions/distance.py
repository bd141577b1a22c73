"""Edit distances between sequences, for batches of pairs inside tasks.

Unrestricted Damerau-Levenshtein: a transposition may span edited elements,
which the built-in ``levenshtein`` does not know at all.

All pairs of a batch go through the table together, row by row. A row follows from the
one above it without a loop: insertions are a running minimum, and of the transpositions
only those count that have no edits between the elements on one side or the other, as
with edits on both sides replacing everything is at most as dear. So three rows and one
remembered cell for each column are enough, and memory is linear in the lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cells of a row over all pairs that go through the table together.
BATCH_CELLS = 1 << 18
_FAR = 1e30


class Sequences:
    """Coded sequences of a batch, end to end, with optional measures of each element."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, measures: tuple[np.ndarray, ...] = ()):
        self.codes, self.sizes, self.measures = codes, np.asarray(sizes, np.int64), measures
        self.starts = np.cumsum(self.sizes) - self.sizes

    def cut(self, starts: np.ndarray, sizes: np.ndarray) -> Sequences:
        """Other stretches of the same elements."""
        part = Sequences(self.codes, sizes, self.measures)
        part.starts = starts
        return part

    def padded(self, rows: np.ndarray, values: np.ndarray, fill) -> np.ndarray:
        """One line for each of ``rows``, filled up to the longest."""
        sizes = self.sizes[rows]
        at = np.arange(int(sizes.max(initial=0)))[None, :]
        inside = at < sizes[:, None]
        out = np.full(inside.shape, fill, values.dtype)
        out[inside] = values[(self.starts[rows][:, None] + at)[inside]]
        return out


def distances(a: Sequences, b: Sequences) -> np.ndarray:
    """The distance of each pair.

    Keeping equal elements costs half the sum of the differences of their measures,
    which must lie in [0, 1]; nothing if there are no measures.
    """
    if not a.measures:
        a, b = _without_common_ends(a, b)
    # the rows are the shorter one's
    both = Sequences(
        np.concatenate([a.codes, b.codes]), a.sizes, tuple(map(np.concatenate, zip(a.measures, b.measures)))
    )
    swap, start_b = a.sizes > b.sizes, b.starts + len(a.codes)
    x = both.cut(np.where(swap, start_b, a.starts), np.where(swap, b.sizes, a.sizes))
    y = both.cut(np.where(swap, a.starts, start_b), np.where(swap, a.sizes, b.sizes))
    out = y.sizes.astype(float)  # right where the shorter one is empty
    order = np.lexsort((x.sizes, y.sizes))
    order = order[x.sizes[order] > 0]
    at = 0
    while at < len(order):
        # ascending widths: as many pairs as fit with the width of the last of them
        widths = y.sizes[order[at : at + BATCH_CELLS]]
        fit = np.searchsorted((widths + 1) * np.arange(1, len(widths) + 1), BATCH_CELLS, "right")
        pairs = order[at : at + max(1, int(fit))]
        out[pairs] = _table(x, y, pairs)
        at += len(pairs)
    return out


def _table(a: Sequences, b: Sequences, pairs: np.ndarray) -> np.ndarray:
    """Distances of pairs with non-empty sequences. Cells hold the distance less their column."""
    x, y = a.padded(pairs, a.codes, -1), b.padded(pairs, b.codes, -2)
    measured = [(a.padded(pairs, m, 0.0), b.padded(pairs, m, 0.0)) for m in a.measures]
    count, width = y.shape
    kind = np.float64 if measured else np.int32
    # lines of three rows of the table; a line's cells are 0 to width
    above2, above, current = (np.zeros((count, width + 1), kind) for _ in range(3))
    # of the last row whose element equals that of the column: its number, and the
    # cell above it and two columns to the left
    matched_row = np.zeros(y.size, kind)
    matched_cell = np.full(y.size, 2 * (x.shape[1] + width), kind)
    spare, equal, close = np.empty((count, width), kind), np.empty(y.shape, bool), np.zeros(y.shape, bool)
    # the line and the column (less one) of each place of ``y``, and the cell left of it
    line, place = np.divmod(np.arange(y.size), width)
    left = np.arange(y.size) + line
    inner = place < width - 1
    sizes, ends = a.sizes[pairs], b.sizes[pairs]
    out = np.zeros(count)
    for i in range(1, x.shape[1] + 1):
        np.equal(y, x[:, i - 1 : i], out=equal)
        if measured:
            drift = sum(np.abs(m[:, i - 1 : i] - n) for m, n in measured) / 2
            np.add(above[:, :-1], np.where(equal, drift - 1, 0), out=spare)
        else:
            np.subtract(above[:, :-1], equal, out=spare)
        best = current[:, 1:]
        np.add(above[:, 1:], 1, out=best)
        np.minimum(best, spare, out=best)
        hits = np.flatnonzero(equal)
        cells = current.ravel()
        # the row's element is right before the column, whose element was in an earlier row
        after = hits[inner[hits]] + 1
        to = left[after] + 1
        cells[to] = np.minimum(cells[to], matched_cell[after] + (i - 2 - matched_row[after]))
        # the column's element is in the row above, and the row's in an earlier column
        if i > 1 and len(hits):
            there = np.flatnonzero(close)
            last = np.searchsorted(hits, there) - 1
            at = hits[last]
            usable = (last >= 0) & (line[at] == line[there])
            to = left[there[usable]] + 1
            cells[to] = np.minimum(cells[to], above2.ravel()[left[at[usable]]] - 1)
        current[:, 0] = i
        np.minimum.accumulate(current, axis=1, out=current)
        done = np.flatnonzero(sizes == i)
        out[done] = current[done, ends[done]] + ends[done]
        # the next row
        matched_row[hits] = i
        hits = hits[place[hits] > 0]
        matched_cell[hits] = above.ravel()[left[hits] - 1]
        equal, close = close, equal
        above2, above, current = above, current, above2
    return out


def _without_common_ends(a: Sequences, b: Sequences) -> tuple[Sequences, Sequences]:
    """The pairs without the elements that they begin and end with in common."""
    head = _common(a, b, a.starts, b.starts, np.minimum(a.sizes, b.sizes), 1)
    left = np.minimum(a.sizes, b.sizes) - head
    tail = _common(a, b, a.starts + a.sizes - 1, b.starts + b.sizes - 1, left, -1)
    return tuple(s.cut(s.starts + head, s.sizes - head - tail) for s in (a, b))


def _common(a, b, at_a, at_b, most, step) -> np.ndarray:
    """How many elements from the given places on are equal, at most ``most``."""
    length = np.zeros(len(most), np.int64)
    chunk, open_ = 8, np.flatnonzero(most > 0)
    while len(open_):
        k = np.arange(chunk)[None, :]
        inside = length[open_][:, None] + k < most[open_][:, None]
        shift = (length[open_][:, None] + k) * step
        left = np.where(inside, at_a[open_][:, None] + shift, 0)
        right = np.where(inside, at_b[open_][:, None] + shift, 0)
        run = np.logical_and.accumulate(inside & (a.codes[left] == b.codes[right]), axis=1).sum(axis=1)
        length[open_] += run
        open_ = open_[(run == chunk) & (length[open_] < most[open_])]
        chunk = min(2 * chunk, max(8, BATCH_CELLS // max(len(open_), 1)))
    return length


def _sequences(left: pd.Series, right: pd.Series, *measures) -> tuple[Sequences, Sequences]:
    """Both sides of a batch with one code for equal elements; measures come in pairs."""
    sizes = [np.fromiter(map(len, side), np.int64, len(side)) for side in (left, right)]
    flat = [v for side in (left, right) for v in side]
    codes, _ = pd.factorize(np.concatenate(flat)) if flat else (np.zeros(0, np.int64), None)
    cut = int(sizes[0].sum())
    each = [[np.concatenate([np.asarray(v, float) for v in m] or [np.zeros(0)]) for m in side] for side in measures]
    return tuple(
        Sequences(c, n, tuple(m[k] for m in each)) for k, (c, n) in enumerate(((codes[:cut], sizes[0]), (codes[cut:], sizes[1])))
    )


def _shares(a: Sequences, b: Sequences) -> pd.Series:
    longer = np.maximum(a.sizes, b.sizes)
    return pd.Series(1.0 - distances(a, b) / np.maximum(longer, 1))


@F.pandas_udf(T.DoubleType())
def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """1 - distance / longer length; two empty sequences are equal."""
    for left, right in batches:
        yield _shares(*_sequences(left, right))


@F.pandas_udf(T.DoubleType())
def timed_similarity(batches: Iterator[tuple[pd.DataFrame, pd.DataFrame]]) -> Iterator[pd.Series]:
    """``similarity`` where keeping an activity costs its mean time difference.

    Sides are structs of ``task``, ``dur`` and ``wait`` arrays, times in [0, 1].
    """
    for left, right in batches:
        yield _shares(*_sequences(left["task"], right["task"], *[(left[c], right[c]) for c in ("dur", "wait")]))
