"""Worker functions over sorted streams: medians of contexts, and what a sample looks up.

Rows come sorted by a group, in batches; a group is read whole, so memory is that of the
largest group or of ``ROWS`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from logloom.functions.scaling import scaled_values

# Rows that are worked on at once, where groups allow it.
ROWS = 1 << 17
SUMS = "rung int, route int, n_size int, part int, total double, w bigint"


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of about ROWS rows, each with all rows of the groups in it."""
    held, rows, wanted = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < wanted:
            continue
        table = pa.Table.from_batches(held)
        keys = table[column].to_numpy()
        other = np.flatnonzero(keys != keys[-1])
        if not len(other):
            wanted = 2 * rows
            continue
        cut = int(other[-1]) + 1
        yield table.slice(0, cut).combine_chunks()
        held, rows, wanted = table.slice(cut).to_batches(), table.num_rows - cut, ROWS
        wanted = max(ROWS, 2 * rows)
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _doubles(table: pa.Table, column: str) -> np.ndarray:
    """NULL as NaN."""
    return table[column].cast(pa.float64()).to_numpy()


def _starts(keys: list[np.ndarray]) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def medians(context: list[str], times: list[str], rungs: int):
    """Lower medians by context and rung, from rows sorted by ``_group``, the context's hash.

    NULL counts as the smallest value, as in a sort.
    """

    def run(batches):
        for table in whole_groups(batches, "_group"):
            keys = [table[c].to_numpy() for c in context]
            group = table["_group"].to_numpy()
            new = _starts([group, *keys])
            if new.sum() > _starts([group]).sum():  # contexts of one hash may be mixed
                order = np.lexsort((*keys, group))
                table = table.take(pa.array(order))
                keys = [k[order] for k in keys]
                new = _starts([group[order], *keys])
            of, n = np.cumsum(new) - 1, int(new.sum())
            bits = table["_rungs"].to_numpy()
            out = [pa.array(k[new]) for k in keys]
            counts = [np.bincount(of[bits >> k & 1 == 1], minlength=n) for k in range(rungs)]
            picked = {}
            for t in times:
                values = _doubles(table, t)
                values = np.where(np.isnan(values), -np.inf, values)
                order = np.lexsort((values, of))
                values, own = values[order], bits[order]
                for k in range(rungs):
                    kept = np.append(values[own >> k & 1 == 1], -np.inf)
                    middle = np.cumsum(counts[k]) - counts[k] + (counts[k] + 1) // 2 - 1
                    found = np.where(counts[k] > 0, kept[np.maximum(middle, 0)], -np.inf)
                    picked[t, k] = pa.array(found, mask=np.isneginf(found))
            names = list(context)
            for k in range(rungs):
                out += [pa.array(counts[k], pa.int64()), *[picked[t, k] for t in times]]
                names += [f"n_{k}", *[f"{t}_{k}" for t in times]]
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _deepest(at: np.ndarray, known: np.ndarray, chain: list[tuple[int, int]], sizes: list[int]):
    """For each size: (rungs, units), the row of the longest context that is known, or -1.

    ``at``: the row of each family and unit, or -1; ``known``: by rung and row.
    """
    best = np.full((len(known), at.shape[1]), -1)
    upto = 0
    for n in sizes:
        while upto < len(chain) and chain[upto][0] <= 2 * n + 1:
            rows = at[chain[upto][1]]
            best = np.where((rows >= 0) & known[:, rows], rows, best)
            upto += 1
        yield best


def _units(table: pa.Table, n_families: int) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each unit, and the rows by family and unit."""
    new = _starts([table["unit"].to_numpy()])
    at = np.full((n_families, int(new.sum())), -1)
    at[table["family"].to_numpy(), np.cumsum(new) - 1] = np.arange(len(new))
    return np.flatnonzero(new), at


def _sums(totals: np.ndarray, weights: np.ndarray, found: np.ndarray, sizes: list[int]) -> pa.RecordBatch:
    """Cells of (rung, route, size, part) that any unit has found a context for."""
    cells = np.argwhere(found > 0)
    picked = tuple(cells.T)
    columns = [cells[:, 0], cells[:, 1], np.array(sizes)[cells[:, 2]], cells[:, 3]]
    arrays = [pa.array(c, pa.int32()) for c in columns]
    arrays += [pa.array(totals[picked], pa.float64()), pa.array(weights[picked], pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["rung", "route", "n_size", "part", "total", "w"])


def entropies(chains: list[list[tuple[int, int]]], n_families: int, sizes: list[int], rungs: int):
    """Sums of ``ce_<rung>`` of the longest known context, from rows sorted by ``unit``."""

    def run(batches):
        shape = (rungs, len(chains), len(sizes), 1)
        totals, weights = np.zeros(shape), np.zeros(shape, np.int64)
        for table in whole_groups(batches, "unit"):
            first, at = _units(table, n_families)
            w = table["w"].to_numpy()[first]
            ce = np.stack([_doubles(table, f"ce_{k}") for k in range(rungs)])
            for route, chain in enumerate(chains):
                for size, best in enumerate(_deepest(at, ~np.isnan(ce), chain, sizes)):
                    for k in range(rungs):
                        some = best[k] >= 0
                        totals[k, route, size, 0] += (ce[k][best[k][some]] * w[some]).sum()
                        weights[k, route, size, 0] += w[some].sum()
        yield _sums(totals, weights, weights, sizes)

    return run


def errors(chains, n_families: int, sizes: list[int], rungs: int, times: list[str], methods: list, args: dict):
    """Sums of the absolute errors of the scaled times, a part for each method.

    A closing event's times are 0 on every scale. Errors that are not known weigh nothing.
    """

    def run(batches):
        shape = (rungs, len(chains), len(sizes), len(methods))
        totals, weights, found = np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for table in whole_groups(batches, "unit"):
            first, at = _units(table, n_families)
            w = table["w"].to_numpy()[first]
            closing = table["closing"].to_numpy()[first]
            known = np.stack([table[f"n_{k}"].to_numpy() > 0 for k in range(rungs)])
            actual = {t: _doubles(table, f"{t}_next")[first] for t in times}
            guess = {(t, k): _doubles(table, f"{t}_{k}") for t in times for k in range(rungs)}
            on = {}
            for t, k, m in args:
                real = np.where(closing, 0.0, scaled_values(actual[t], args[t, k, m], m))
                on[t, k, m] = real, scaled_values(guess[t, k], args[t, k, m], m)
            for route, chain in enumerate(chains):
                for size, best in enumerate(_deepest(at, known, chain, sizes)):
                    for k in range(rungs):
                        some = np.flatnonzero(best[k] >= 0)
                        rows = best[k][some]
                        for part, m in enumerate(methods):
                            gaps = [np.abs(on[t, k, m][0][some] - on[t, k, m][1][rows]) for t in times]
                            gap = sum(gaps) / len(times)
                            real = ~np.isnan(gap)
                            totals[k, route, size, part] += (gap[real] * w[some][real]).sum()
                            weights[k, route, size, part] += w[some][real].sum()
                            found[k, route, size, part] += len(some)
        yield _sums(totals, weights, found, sizes)

    return run
