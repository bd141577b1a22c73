"""Ranked lexical search: documents grouped by which of an item's terms they hold.

Within a block of documents every term of the items has the list of documents that hold
it. For an item these lists set one bit each in a mask a document, and documents with
equal masks form a group. A group's best possible score follows from its mask, from the
largest count of each term in the block and from its shortest document. Groups are
evaluated in descending order of it, until none can get into the item's ten best.

The texts are read once for each block of items: matched terms and their counts are
written as a table, which gives document frequencies first and scores afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.text import blocks, column, hashes, runs, signed, texts
from logloom.runtime import pin

TOP = 10
# Terms of the items that travel with the tasks at once; an item with more is a block alone.
BLOCK_TERMS = 1 << 19
# Documents of a block that are masked at once, and 64-bit words of masks at most.
BLOCK_DOCS = 1 << 13
MASK_WORDS = 1 << 21
# Documents of several groups that are evaluated together, and counts held at once.
EVALUATED = 64
CELLS = 1 << 18
# Groups that tasks' results are merged in first.
SALTS = 64
# Fixed values of the score.
LENGTH_BASE, LENGTH_SHARE, SCALE = 10, 90, 1_000_000_000


def term_bytes() -> np.ndarray:
    """Which bytes terms are made of: letters, digits and all bytes beyond ASCII."""
    member = np.zeros(256, bool)
    member[48:58] = member[65:91] = member[97:123] = True
    member[128:] = True
    return member


def terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms, first term of each text)."""
    data, offsets = texts(column(batch, "text"))
    starts, ends, first = runs(data, offsets, term_bytes())
    return hashes(data, starts, ends), first


def _lists(values: list[np.ndarray], kind=None) -> pa.Array:
    edges = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(flat, kind))


def distinct_terms(items: DataFrame) -> DataFrame:
    """(item_row, item_id, terms): each item's distinct terms as hashes.

    ``item_row`` tells rows with equal or null ids apart.
    """

    def run(batches):
        for batch in blocks(batches):
            h, first = terms(batch)
            each = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "item_row"), column(batch, "item_id"), _lists([signed(x) for x in each], pa.int64())],
                ["item_row", "item_id", "terms"],
            )

    rows = items.withColumn("item_row", F.monotonically_increasing_id())
    rows = rows.select("item_row", "item_id", "text")
    return rows.mapInArrow(run, "item_row long, item_id long, terms array<long>")


def item_blocks(items: DataFrame):
    """The items in blocks of at most BLOCK_TERMS terms, one block at a time as Arrow."""
    sized = items.select("item_row", F.size("terms").alias("n")).where("n > 0")
    sized = sized.repartitionByRange("item_row").sortWithinPartitions("item_row")

    def run(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        parts = [list(x) for x in zip(*joined((r, r, n) for r, n in rows))] or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in parts], ["low", "high", "n"])

    # a row for each block and partition
    bounds = sized.mapInArrow(run, "low long, high long, n long").orderBy("low").collect()
    for low, high, _ in joined(bounds):
        yield items.where(F.col("item_row").between(low, high) & (F.size("terms") > 0)).toArrow().combine_chunks()


def joined(ranges) -> list[tuple[int, int, int]]:
    """Neighbouring (low, high, n) ranges joined as long as n stays within BLOCK_TERMS."""
    out: list[tuple[int, int, int]] = []
    for low, high, n in ranges:
        if out and out[-1][2] + n <= BLOCK_TERMS:
            out[-1] = (out[-1][0], high, out[-1][2] + n)
        else:
            out.append((low, high, n))
    return out


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, term, times) of the documents with terms.

    ``n`` is the number of all terms; ``term`` has the places in the sorted vocabulary of
    those that are in it, ``times`` their counts.
    """

    def run(batches):
        for batch in blocks(batches):
            h, first = terms(batch)
            n = np.diff(first)
            at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
            hit = np.flatnonzero(vocabulary[at] == h)
            doc = np.repeat(np.arange(len(n)), n)[hit]
            pairs, times = np.unique(doc * len(vocabulary) + at[hit], return_counts=True)
            of, term = np.divmod(pairs, len(vocabulary))
            kept = np.flatnonzero(n)
            edges = pa.array(np.searchsorted(of, np.append(kept, len(n))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id").take(pa.array(kept)),
                    pa.array(n[kept]),
                    pa.ListArray.from_arrays(edges, pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(edges, pa.array(times.astype(np.int32))),
                ],
                ["doc_id", "n", "term", "times"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, term array<int>, times array<int>")


def document_frequencies(found: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs."""

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(column(batch, "term").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["term", "df"])

    each = found.select("term").mapInArrow(run, "term int, df long")
    rows = each.groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # a row for each term
    out = np.zeros(size, np.int64)
    out[rows["term"].to_numpy()] = rows["df"].to_numpy()
    return out


@dataclass
class Query:
    """One item: the places of its terms, and their weights."""

    row: int
    terms: np.ndarray
    weights: np.ndarray


class Block:
    """Documents of a task, with the list of documents of each of their terms."""

    def __init__(self, doc_id, length, of, term, times, vocabulary_size):
        self.doc_id, self.length, self.size = doc_id, length, vocabulary_size
        self.keys, self.times = of * vocabulary_size + term, times
        order = np.argsort(term, kind="stable")
        self.term, self.cuts = np.unique(term[order], return_index=True)
        self.holders = of[order]
        self.cuts = np.append(self.cuts, len(order))
        self.most = np.maximum.reduceat(times[order], self.cuts[:-1]) if len(order) else times

    def search(self, query: Query, best: list) -> list:
        """``best`` with this block's documents taken in: (-score, null, doc_id), ascending."""
        here = np.searchsorted(self.term, query.terms)
        here[here == len(self.term)] = 0
        present = np.flatnonzero(self.term[here] == query.terms) if len(self.term) else []
        if not len(present):
            return best
        width = -(-len(present) // 64)
        masks = np.zeros((len(self.doc_id), width), np.uint64)
        for bit, at in enumerate(here[present]):
            masks[self.holders[self.cuts[at] : self.cuts[at + 1]], bit // 64] |= np.uint64(1 << (bit % 64))
        docs = np.flatnonzero(masks.any(axis=1))
        # documents with equal masks, side by side
        order = docs[np.lexsort(masks[docs].T)]
        changes = np.any(masks[order][1:] != masks[order][:-1], axis=1)
        starts = np.append(0, np.flatnonzero(changes) + 1)
        weights, most = query.weights[present], self.most[here[present]]
        shortest = np.minimum.reduceat(self.length[order], starts)
        held = np.unpackbits(masks[order[starts]].view(np.uint8), axis=1, bitorder="little")[:, : len(present)]
        bound = np.zeros(len(starts), np.int64)
        for bit in range(len(present)):
            top = weights[bit] * (SCALE * most[bit] // (1000 * most[bit] + 8 * shortest))
            bound += np.where(held[:, bit] == 1, top, 0)
        groups = np.argsort(-bound, kind="stable")
        ends = np.append(starts[1:], len(order))
        waiting: list[np.ndarray] = []
        ready = 0
        for g in groups:
            if ready and ready + ends[g] - starts[g] > EVALUATED:
                best = self._merge(query, np.concatenate(waiting), best)
                waiting, ready = [], 0
            if len(best) == TOP and bound[g] < -best[-1][0]:
                break  # all further groups are bounded by less than the tenth score
            waiting.append(order[starts[g] : ends[g]])
            ready += ends[g] - starts[g]
        return self._merge(query, np.concatenate(waiting), best) if ready else best

    def _merge(self, query: Query, docs: np.ndarray, best: list) -> list:
        step = max(1, CELLS // len(query.terms))
        for a in range(0, len(docs), step):
            part = docs[a : a + step]
            keys = part[:, None] * self.size + query.terms[None, :]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            tf = np.where(self.keys[at] == keys, self.times[at], 0)
            total = (query.weights * (SCALE * tf // (1000 * tf + 8 * self.length[part][:, None]))).sum(axis=1)
            least = -best[-1][0] if len(best) == TOP else 1
            for k in np.flatnonzero(total >= max(least, 1)):
                key = self.doc_id[part[k]]
                best.append((-int(total[k]), key is None, key or 0))
            best = sorted(best)[:TOP]
        return best


def best_in_tasks(found: DataFrame, queries: list[Query], size: int, n: int, total: int) -> DataFrame:
    """(item_row, doc_id, score): the ten best documents of each task and item."""

    def run(batches):
        best: dict[int, list] = {}
        widest = max(-(-len(q.terms) // 64) for q in queries)
        step = max(1, min(BLOCK_DOCS, MASK_WORDS // widest))
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                lists = column(batch, "term")
                each = np.diff(lists.offsets.to_numpy())
                block = Block(
                    column(batch, "doc_id").to_pylist(),
                    100 - LENGTH_SHARE + LENGTH_SHARE * column(batch, "n").to_numpy() * n // total,
                    np.repeat(np.arange(batch.num_rows), each),
                    lists.flatten().to_numpy().astype(np.int64),
                    column(batch, "times").flatten().to_numpy().astype(np.int64),
                    size,
                )
                for query in queries:
                    found_here = block.search(query, best.get(query.row, []))
                    if found_here:
                        best[query.row] = found_here
        rows = [(row, None if null else key, -score) for row, b in best.items() for score, null, key in b]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["item_row", "doc_id", "score"]
        )

    return found.mapInArrow(run, "item_row long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the ten best documents of every row of ``items``.

    A null text has no terms; a document without terms is not counted, an item without
    terms has no rows, nor has one that no document scores above 0 for. Equal scores are in
    the order of doc_id, null last; rows with equal doc_ids are documents of their own, and
    items with equal ids (or none) are searched one by one. No documents give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = pin(distinct_terms(items.select(F.col("item_id").cast("long").alias("item_id"), "text")))
    results, sums = [], None
    for block in item_blocks(items):
        flat = block["terms"].combine_chunks()
        offsets = flat.offsets.to_numpy()
        hashed = flat.flatten().to_numpy().view(np.uint64)
        vocabulary, places = np.unique(hashed, return_inverse=True)
        found = pin(postings(docs, vocabulary))
        sums = sums or found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        n, total = sums
        if not n:
            break
        df = document_frequencies(found, len(vocabulary))
        weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
        queries = []
        for k, row in enumerate(block["item_row"].to_pylist()):
            at = places[offsets[k] - offsets[0] : offsets[k + 1] - offsets[0]]
            at = at[df[at] > 0]
            if len(at):
                queries.append(Query(row, at, weights[at]))
        if queries:
            results.append(pin(best_in_tasks(found, queries, len(vocabulary), n, total)))
    schema = "item_id long, rank int, doc_id long, score long"
    if not results:
        return docs.sparkSession.createDataFrame([], schema)
    each = results[0]
    for more in results[1:]:
        each = each.unionByName(more)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))
    few = each.withColumn("_salt", salt)
    few = few.withColumn("_r", F.row_number().over(W.partitionBy("item_row", "_salt").orderBy(*order)))
    few = few.where(F.col("_r") <= TOP)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("item_row").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= TOP).select(F.col("item_row").alias("_of"), "rank", "doc_id", "score")
    ids = items.select("item_row", "item_id")
    return ranked.join(ids, ranked["_of"] == ids["item_row"]).select("item_id", "rank", "doc_id", "score")
