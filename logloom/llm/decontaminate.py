"""Benchmark decontamination by greedy string tiling.

Every run of ``min_match`` words of the benchmark is a seed. A document that shares a
seed with an item is compared with it: the longest common run of free words is marked as
a tile, again and again, until no run of ``min_match`` words is left. Tiles never
overlap, so passages put in another order, or with words put between them, still cover
their item. A document is contaminated when tiles cover enough of an item.

The benchmark is read in blocks of bounded size, and each block meets every document
within its task; documents are not moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.names import own_names
from logloom.llm.text import blocks, column, grams, texts, word_hashes

MIN_MATCH = 5
COVERAGE = 0.5
# Bytes of benchmark text that travel with the tasks at once.
BENCHMARK_BYTES = 32 << 20
_BASE = np.uint64(0x9FB21C651E98DF25)


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two sequences of word hashes: (place in doc, in item, length).

    Running Karp-Rabin: the search length begins at the length of the item and is
    halved; hashes of all free runs of that length meet in a sorted table. A match is
    extended as far as it goes. As a longer one may turn up, matches of a round are
    marked from the longest to the shortest, ties by place in the document, then in the
    item, and what another tile has taken meanwhile is looked at again, cut to what is
    free.
    """
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    found: list[tuple[int, int, int]] = []
    length = min(len(doc), len(item))
    while length >= min_match:
        matches = _maximal(doc, item, free_doc, free_item, length)
        if matches:
            matches.sort(key=lambda m: (-m[2], m[0], m[1]))
            again = False
            longest = matches[0][2]
            for a, b, n in matches:
                if n < longest and again:
                    break  # a match cut by a tile may now be shorter than others
                if free_doc[a : a + n].all() and free_item[b : b + n].all():
                    free_doc[a : a + n] = False
                    free_item[b : b + n] = False
                    found.append((a, b, n))
                else:
                    again = True
            if again:
                continue  # cut matches come back with what is left of them
        if length == min_match:
            break
        length = max(min_match, length // 2)
    return found


def _runs(h: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(Karp-Rabin hash, place) of all runs of n free words."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[n:] == taken[:-n])
    powers = np.full(len(h), _BASE)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    inverse = np.full(len(h), np.uint64(pow(int(_BASE), -1, 1 << 64)))
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers, dtype=np.uint64)])
    return (upto[at + n] - upto[at]) * inverse[at], at


def _maximal(doc, item, free_doc, free_item, n: int) -> list[tuple[int, int, int]]:
    """All free matches of n words or more that cannot be extended."""
    keys, places = _runs(item, free_item, n)
    hashes, at = _runs(doc, free_doc, n)
    if not len(keys) or not len(at):
        return []
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    low, high = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
    out = []
    for i in np.flatnonzero(high > low).tolist():
        a = int(at[i])
        for b in places[low[i] : high[i]].tolist():
            before = a > 0 and b > 0 and free_doc[a - 1] and free_item[b - 1]
            if before and doc[a - 1] == item[b - 1]:
                continue  # part of the match that begins one word earlier
            size = min(len(doc) - a, len(item) - b)
            same = (doc[a : a + size] == item[b : b + size]) & (
                free_doc[a : a + size] & free_item[b : b + size]
            )
            stop = np.flatnonzero(~same)
            size = int(stop[0]) if len(stop) else size
            if size >= n:
                out.append((a, b, size))
    return out


class Index:
    """The word hashes of one block of the benchmark, and where each seed occurs."""

    def __init__(self, ids: list[int], items: pa.Array, min_match: int):
        h, first = word_hashes(*texts(items))
        self.min_match = min_match
        self.ids, self.items, seeds, owners = [], [], [], []
        for i, a, b in zip(ids, first[:-1].tolist(), first[1:].tolist()):
            if a == b:
                continue  # an item without words covers nothing
            n = min(min_match, b - a)
            # an item of fewer words is its own seed; it must occur whole
            seeds.append(grams(h[a:b], n) + np.uint64(n))
            owners.append(np.full(len(seeds[-1]), len(self.ids)))
            self.ids.append(i)
            self.items.append(h[a:b])
        self.lengths = sorted({min(min_match, len(x)) for x in self.items})
        seeds = np.concatenate([np.zeros(0, np.uint64), *seeds])
        owners = np.concatenate([np.zeros(0, np.int64), *owners])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owners = seeds[order], owners[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.seeds >> np.uint64(44)] = True

    def matches(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
        """(row, item number, covered words, tiles) of documents that share a seed."""
        h, first = word_hashes(*texts(column(batch, "text")))
        for n in self.lengths:
            g = grams(h, n) + np.uint64(n)
            at = np.flatnonzero(self.filter[g >> np.uint64(44)])
            low = np.searchsorted(self.seeds, g[at], "left")
            high = np.searchsorted(self.seeds, g[at], "right")
            hit = high > low
            at, low, high = at[hit], low[hit], high[hit]
            row = np.searchsorted(first, at, "right") - 1
            whole = at + n <= first[row + 1]  # not across two texts
            at, low, high, row = at[whole], low[whole], high[whole], row[whole]
            number = np.repeat(row, high - low)
            spread = np.arange(int((high - low).sum()))
            spread -= np.repeat(np.cumsum(high - low) - (high - low), high - low)
            owner = self.owners[np.repeat(low, high - low) + spread]
            pairs = np.unique(number * np.int64(max(1, len(self.ids))) + owner)
            for pair in pairs.tolist():
                r, k = divmod(pair, len(self.ids))
                item = self.items[k]
                if min(self.min_match, len(item)) != n:
                    continue
                found = tiles(h[first[r] : first[r + 1]], item, n)
                yield r, k, sum(t[2] for t in found), len(found)


# Stands for the null id of an item, and counts as the smallest.
NO_ID = -(1 << 63)
RESULT = ("_tiled_item", "_tiled_words", "_tiled_length", "_tiled_count")


def judge(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH) -> DataFrame:
    """``docs`` with the columns of ``RESULT``: each row's worst item, its covered words,
    its length in words and the number of tiles.

    The worst item is the one with the largest covered part, of ties the smallest id;
    null, with nothing covered, if no item shares a seed. Null and empty texts share
    none, nor do items without text; a null item id counts as smallest. An item shorter than ``min_match`` must
    occur whole. All rows and columns stay, repeated rows too.
    """
    start = (F.lit(None), F.lit(0), F.lit(1), F.lit(0))
    rows = docs.withColumns({c: v.cast("long") for c, v in zip(RESULT, start)})
    for ids, items in benchmark_blocks(benchmark):
        rows = rows.mapInArrow(_over(ids, items, min_match), rows.schema)
    return rows


def _over(ids: list[int], items: pa.Array, min_match: int):
    def run(batches):
        index = Index(ids, items, min_match)
        for batch in blocks(batches):
            best = [column(batch, c).to_pylist() for c in RESULT]
            for r, k, covered, count in index.matches(batch):
                item, words = index.ids[k], len(index.items[k])
                old = best[0][r]
                gain = covered * best[2][r] - best[1][r] * words
                if covered and (old is None or gain > 0 or (gain == 0 and item < old)):
                    for values, new in zip(best, (item, covered, words, count)):
                        values[r] = new
            kept = batch.num_columns - len(RESULT)
            yield pa.RecordBatch.from_arrays(
                batch.columns[:kept] + [pa.array(v, pa.int64()) for v in best],
                batch.schema.names,
            )

    return run


def benchmark_blocks(benchmark: DataFrame) -> Iterator[tuple[list, pa.Array]]:
    """(ids, texts) of the benchmark, at most about BENCHMARK_BYTES of text at a time.

    The driver reads one row after the other and holds one block; each block is one
    more step of the tasks over their documents.
    """
    own = F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID))
    items = benchmark.select(own.alias("i"), "text").where("text is not null")
    ids, rows, size = [], [], 0
    for row in items.toLocalIterator():
        ids.append(row["i"])
        rows.append(row["text"])
        size += len(row["text"].encode())
        if size >= BENCHMARK_BYTES:
            yield ids, pa.array(rows, pa.string())
            ids, rows, size = [], [], 0
    if ids:
        yield ids, pa.array(rows, pa.string())


def covered_part():
    return F.col(RESULT[1]) / F.col(RESULT[2])


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, contaminated, item_id, coverage, covered, tiles) of every row."""
    rows = judge(docs.select(key, "text"), benchmark)
    return rows.select(
        F.col(key).alias("doc_id"),
        (covered_part() >= COVERAGE).alias("contaminated"),
        F.when(F.col(RESULT[0]) != NO_ID, F.col(RESULT[0])).alias("item_id"),
        covered_part().alias("coverage"),
        F.col(RESULT[1]).alias("covered"),
        F.col(RESULT[3]).alias("tiles"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """The rows of which no item is covered by ``threshold`` or more."""
    docs, back = own_names(docs)
    kept = judge(docs, benchmark).where(covered_part() < threshold)
    return kept.drop(*RESULT).withColumnsRenamed(back)
