"""Byte-level BPE: encoding by merge replay over the distinct pieces of a block.

The texts of a block are cut into pieces, and every distinct piece that the task has
not met yet joins one list of symbols. An inverted index holds, for each token that
two neighbours could form, the positions of the left neighbour. The lowest rank is
taken from it again and again, applied at all of its positions, and only the touched
neighbours are entered anew. Merges never cross pieces, so replaying the corpus block
by block gives what one replay over all of it would give, without an exchange.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import blocks, column

# Words a task remembers; the memory is emptied beyond it, which costs time only.
REMEMBERED = 250_000
# Bytes of text whose new words are replayed together.
BLOCK = 1 << 22

ENCODED = "doc_key long, n_tokens long, ids binary"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    pairs = (line.split() for line in data.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Merges:
    """The rank table as arrays: which two neighbours form which token.

    ``ranks`` holds every single byte, as byte-level tables do. A token is told apart
    by its rank, and two neighbours merge when their bytes together are a token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.width = np.int64(max(ranks.values()) + 1)
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        found = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    found[left * int(self.width) + right] = rank
        self.keys = np.array(sorted(found), np.int64)
        self.values = np.array([found[k] for k in self.keys.tolist()], np.int64)
        left, right = self.keys // self.width, self.keys % self.width
        # tokens that can go into a token of a lower rank than their own
        self.upset = {*left[self.values < left].tolist(), *right[self.values < right].tolist()}

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each two neighbours form, -1 for none."""
        key = left.astype(np.int64) * self.width + right
        if not len(self.keys):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], -1)


class PairIndex:
    """Positions of the left neighbour, by the rank of what it forms with the next."""

    def __init__(self):
        self.places: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []

    def add(self, ranks: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1, append=-1)).tolist()
        for a, b, rank in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist()):
            if rank not in self.places:
                self.places[rank] = []
                heapq.heappush(self.heap, rank)
            self.places[rank].append(at[a:b])

    def lowest(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.heap)
        parts = self.places.pop(rank)
        return rank, parts[0] if len(parts) == 1 else np.concatenate(parts)


def replay(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces, first id of each), by applying the merges in rank order.

    A piece that is a token is that token. A merge whose token can go into one of a
    lower rank is applied to one place of a piece at a time, so any rank table gives
    what merging piece by piece gives.
    """
    sizes = np.array([len(p) for p in pieces], np.int64)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    symbol = merges.bytes[np.frombuffer(b"".join(pieces), np.uint8)].astype(np.int32)
    n = len(symbol)
    if n == 0:
        return symbol.astype(np.uint32), np.zeros(len(pieces) + 1, np.int64)
    first = np.cumsum(sizes) - sizes
    after = np.arange(1, n + 1, dtype=np.int32)  # a block has less than 2**31 bytes
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[first[sizes > 0]] = -1
    after[(first + sizes - 1)[sizes > 0]] = -1
    pair = np.full(n, -1, np.int32)
    inner = np.flatnonzero(after >= 0)
    pair[inner] = merges.of(symbol[inner], symbol[inner + 1])
    for k, piece in enumerate(pieces):
        whole = merges.ranks.get(piece)
        if whole is not None:
            a, b = first[k], first[k] + sizes[k]
            pair[a:b], symbol[a:b], symbol[a] = -1, -1, whole
    index = PairIndex()
    at = np.flatnonzero(pair >= 0)
    index.add(pair[at], at)
    while index.heap:
        rank, at = index.lowest()
        at = at[pair[at] == rank]  # else a neighbour went into another merge
        if not len(at):
            continue
        at = distinct(at)
        if rank in merges.upset:
            one = np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])
            if not one.all():
                index.add(pair[at[~one]], at[~one])
            at = at[one]
        elif len(at) > 1:
            # of places that overlap in a chain, every second is free again
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if chained.any():
                place = np.arange(len(at))
                run = np.maximum.accumulate(np.where(chained, 0, place))
                at = at[(place - run) % 2 == 0]
        gone = after[at]
        right = after[gone]
        symbol[at], symbol[gone], pair[gone] = rank, -1, -1
        after[at] = right
        inside = right >= 0
        before[right[inside]] = at[inside]
        pair[at] = -1
        left = before[at]
        touched = distinct(np.concatenate([at[inside], left[left >= 0]]))
        new = merges.of(symbol[touched], symbol[after[touched]])
        pair[touched] = new
        touched, new = touched[new >= 0], new[new >= 0]
        if len(new):
            index.add(new, touched)
    left = symbol >= 0
    counts = np.bincount(owner[left], minlength=len(pieces))
    return symbol[left].astype(np.uint32), np.concatenate([[0], np.cumsum(counts)])


class Encoder:
    """Encodes the texts of one task, block by block, and remembers its words.

    A text is first cut at single spaces between other characters. No piece of the
    pattern goes across such a cut, its space belongs to what follows.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges = Merges(ranks)
        self.pieces = regex.compile(pattern).findall
        self.uneven = re.compile(r"\s\s|^\s|\s\Z").search
        self.cut = regex.compile(r"(?<=\S) (?=\S)").split
        self.forget()

    def forget(self) -> None:
        self.place: dict = defaultdict(count().__next__)
        self.ids = np.zeros(0, np.uint32)
        self.starts = self.sizes = np.zeros(0, np.int64)

    def words(self, text: str) -> list:
        """The words of a text; the first has no space before it and is a tuple."""
        found = self.cut(text) if self.uneven(text) else text.split(" ")
        found[0] = (found[0],)
        return found

    def learn(self, words: list) -> None:
        parts = [self.pieces(w[0] if isinstance(w, tuple) else " " + w) for w in words]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        number: dict[str, int] = defaultdict(count().__next__)
        flat = chain.from_iterable(parts)
        at = np.fromiter(map(number.__getitem__, flat), np.int64, int(counts.sum()))
        ids, first = replay([p.encode() for p in number], self.merges)
        lengths = np.diff(first)[at]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        edges = upto[np.concatenate([[0], np.cumsum(counts)])]
        self.starts = np.concatenate([self.starts, len(self.ids) + edges[:-1]])
        self.sizes = np.concatenate([self.sizes, np.diff(edges)])
        self.ids = np.concatenate([self.ids, spread(ids, first[at], lengths)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first id of each)."""
        if len(self.place) > REMEMBERED:
            self.forget()
        known = len(self.place)
        number = self.place.__getitem__  # gives a new word the next number
        counts, at = [], []
        for text in texts:
            words = self.words(text) if text else []
            counts.append(len(words))
            at.append(np.fromiter(map(number, words), np.int64, len(words)))
        if len(self.place) > known:
            self.learn(list(islice(self.place, known, None)))
        at = np.concatenate([np.zeros(0, np.int64), *at])
        lengths = self.sizes[at]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = spread(self.ids, self.starts[at], lengths)
        return ids, upto[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]


def distinct(at: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    at = np.sort(at)
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def spread(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one after the other."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return values[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


def encode_batches(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], pattern: str):
    """(batch, ids of all its texts, first id of each text) for each block."""
    encoder = Encoder(ranks, pattern)
    for batch in blocks(batches, size=BLOCK):
        yield batch, *encoder.encode(column(batch, "text").to_pylist())


def decoder(ranks: dict[bytes, int]):
    """A function from an array of ids to the bytes they stand for."""
    size = max(ranks.values(), default=-1) + 1
    table = [b""] * size
    for token, rank in ranks.items():
        table[rank] = token
    lengths = np.array([len(t) for t in table], np.int64)
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(table), np.uint8)

    def decode(ids: np.ndarray) -> bytes:
        sizes = lengths[ids]
        upto = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        return data[np.repeat(starts[ids] - upto, sizes) + np.arange(total)].tobytes()

    return decode


def encode(docs: DataFrame, rank_file: bytes, pattern: str, key: str = "doc_id") -> DataFrame:
    """Adds ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit) to (key, text).

    A null or empty text has no ids. Repeated keys keep their rows; other columns
    are not looked at and not returned, so their names cannot clash.
    """

    def run(batches):
        ranks = read_ranks(rank_file)
        for batch, ids, first in encode_batches(batches, ranks, pattern):
            ids = ids.astype("<u4")
            parts = [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_key"), pa.array(np.diff(first)), pa.array(parts, pa.binary())],
                ["doc_key", "n_tokens", "ids"],
            )

    keyed = docs.select(F.col(key).cast("long").alias("doc_key"), "text")
    return keyed.mapInArrow(run, ENCODED).withColumnRenamed("doc_key", key)


def decode(encoded: DataFrame, rank_file: bytes, key: str = "doc_id") -> DataFrame:
    """(key, bytes) of an encoded table; null ids decode to no bytes."""

    def run(batches):
        back = decoder(read_ranks(rank_file))
        for batch in batches:
            rows = column(batch, "ids").to_pylist()
            parts = [back(np.frombuffer(ids or b"", "<u4")) for ids in rows]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_key"), pa.array(parts, pa.binary())], ["doc_key", "bytes"]
            )

    keyed = encoded.select(F.col(key).cast("long").alias("doc_key"), "ids")
    return keyed.mapInArrow(run, "doc_key long, bytes binary").withColumnRenamed("doc_key", key)


def digests(docs: DataFrame, rank_file: bytes, pattern: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, and the hashes of ids and decoded bytes.

    Encodes and decodes block by block, so neither ids nor bytes leave the task.
    """

    def run(batches):
        ranks = read_ranks(rank_file)
        back = decoder(ranks)
        for batch, ids, first in encode_batches(batches, ranks, pattern):
            ids = ids.astype("<u4")
            each = [ids[a:b] for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_key"),
                    pa.array(np.diff(first)),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in each]),
                    pa.array([hashlib.sha256(back(x)).hexdigest() for x in each]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_key"), "text")
    return keyed.mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
