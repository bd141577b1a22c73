"""Importance resampling towards a target distribution over hashed n-grams.

A feature's bucket is the CRC of its bytes. It is never hashed as a whole: an Aho-Corasick
automaton over the distinct words of a block, each between two delimiters, scans the block
and emits every word's payload, its CRC and its length. The CRC of a joined run follows
from the payloads of its neighbours, as appending n bytes is a linear map that depends on
n alone; these maps are tables, applied to whole arrays.

The texts are scanned twice: once to count buckets, of which only the fixed number of sums
reaches the driver, and once to score documents by the gains of their buckets.
"""

from __future__ import annotations

import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.cells import CELLS, chunk_batches, total
from logloom.llm.text import blocks, column, texts
from logloom.runtime import pin

BUCKETS = 10_000
# Words in a run, at most.
LONGEST_RUN = 3
# Bytes of text that get an automaton of their own.
BLOCK_BYTES = 1 << 23
# Longer words are not put into automata; their payloads are computed where they stand.
WORD_BYTES = 64
LEAST_WORDS, PERCENT, SEED = 20, 5, 42
ROW_BITS = 33
_SPACE = ord(" ")
# Fixed value of the CRC.
_POLYNOMIAL = np.uint32(0xEDB88320)


def plain_bytes() -> np.ndarray:
    """For each byte what it counts as: A-Z as a-z, what ends a word as a space."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    member = np.zeros(256, bool)
    member[48:58] = member[97:123] = True
    member[128:] = True
    table[~member[table]] = _SPACE
    return table


class Shifts:
    """What a CRC becomes, as part of a longer text's, once more bytes follow it."""

    def __init__(self):
        shift = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            shift = (shift >> np.uint32(1)) ^ np.where(shift & np.uint32(1), _POLYNOMIAL, np.uint32(0))
        low = np.arange(256, dtype=np.uint32)
        # one table for each byte of the CRC; the first is for one more byte
        one = np.stack([shift, *[low << np.uint32(8 * i) for i in range(3)]])
        short = [np.stack([low << np.uint32(8 * i) for i in range(4)])]
        for _ in range(WORD_BYTES):
            short.append(_mapped(one, short[-1]))
        self.short = np.stack(short).ravel()
        # for 1, 2, 4, 8, ... bytes
        self.doubled = [one]
        for _ in range(40):
            self.doubled.append(_mapped(self.doubled[-1], self.doubled[-1]))

    def append(self, crc: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Each CRC as it counts once ``n`` more bytes follow."""
        at = np.minimum(n, WORD_BYTES) << 10
        out = (
            self.short[at + (crc & np.uint32(255))]
            ^ self.short[at + 256 + (crc >> np.uint32(8) & np.uint32(255))]
            ^ self.short[at + 512 + (crc >> np.uint32(16) & np.uint32(255))]
            ^ self.short[at + 768 + (crc >> np.uint32(24))]
        )
        for i in np.flatnonzero(np.asarray(n) > WORD_BYTES):
            c, k = crc[i : i + 1], int(n[i])
            for bit in range(k.bit_length()):
                if k >> bit & 1:
                    c = _mapped(self.doubled[bit], c)
            out[i] = c[0]
        return out


def _mapped(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (
        tables[0][crc & np.uint32(255)]
        ^ tables[1][crc >> np.uint32(8) & np.uint32(255)]
        ^ tables[2][crc >> np.uint32(16) & np.uint32(255)]
        ^ tables[3][crc >> np.uint32(24)]
    )


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC, length of each word, first word of each text), from a scan of the block."""
    n = len(offsets) - 1
    # a delimiter before each text and one at the end, so that none runs into the next
    plain = np.full(len(data) + n + 1, _SPACE, np.uint8)
    own = np.ones(len(plain), bool)
    own[offsets + np.arange(n + 1)] = False
    plain[own] = plain_bytes()[data]
    edge = plain == _SPACE
    starts, ends = np.flatnonzero(edge[:-1] & ~edge[1:]) + 1, np.flatnonzero(~edge[:-1] & edge[1:]) + 1
    length = ends - starts
    first = np.searchsorted(starts, offsets + np.arange(n + 1))
    crc = np.zeros(len(starts), np.uint32)
    long = np.flatnonzero(length > WORD_BYTES)
    for i in long:
        crc[i] = zlib.crc32(plain[starts[i] : ends[i]].tobytes())
        plain[starts[i] : ends[i]] = _SPACE  # the automaton passes over it
    if len(long) < len(starts):
        crc[length <= WORD_BYTES] = scan(plain.tobytes())
    return crc, length, first


def scan(plain: bytes) -> np.ndarray:
    """The CRC of each word of a text of words between spaces, as its automaton emits them."""
    found = set(plain.split(b" "))
    found.discard(b"")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    codes = np.zeros(len(found), np.uint32)
    for i, word in enumerate(found):
        codes[i] = zlib.crc32(word)
        automaton.add_word(f" {word.decode('latin-1')} ", i)
    automaton.make_automaton()
    emitted = [i for _, i in automaton.iter(plain.decode("latin-1"))]
    return codes[emitted]


def runs_of_words(crc: np.ndarray, length: np.ndarray, first: np.ndarray, shifts: Shifts):
    """For runs of 1, 2, 3 words: (text of each run, its CRC), from neighbouring payloads."""
    space = np.uint32(zlib.crc32(b" "))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = np.repeat(first[1:], np.diff(first)) - np.arange(len(crc))  # words up to the text's end
    run, at = crc, np.arange(len(crc))
    for k in range(LONGEST_RUN):
        if k:
            keep = left[at] > k
            run, at = run[keep], at[keep]
            run = shifts.append(run, 1) ^ space
            run = shifts.append(run, length[at + k]) ^ crc[at + k]
        yield text[at], run


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches):
        shifts, counts = Shifts(), np.zeros(BUCKETS, np.int64)
        for batch in blocks(batches, size=BLOCK_BYTES):
            for _, crc in runs_of_words(*payloads(*texts(column(batch, "text"))), shifts):
                counts += np.bincount(crc % np.uint32(BUCKETS), minlength=BUCKETS)
        yield from chunk_batches(counts)

    return total(rows.select("text").mapInArrow(run, CELLS), BUCKETS, "int64", "int64")


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier a bucket is in the target than in the raw texts."""
    s, t = raw.astype(float), target.astype(float)
    ratio = (t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""

    def run(batches):
        shifts = Shifts()
        for batch in blocks(batches, size=BLOCK_BYTES):
            crc, length, first = payloads(*texts(column(batch, "text")))
            n = len(first) - 1
            features, weight = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for text, run_crc in runs_of_words(crc, length, first, shifts):
                # texts are in ascending order: sums of neighbours are differences of running sums
                cut = np.searchsorted(text, np.arange(n + 1))
                each = np.append(0, np.cumsum(gain[run_crc % np.uint32(BUCKETS)]))
                features += np.diff(cut)
                weight += each[cut[1:]] - each[cut[:-1]]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(np.diff(first)), pa.array(features), pa.array(weight)],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def with_noise(weighed: DataFrame) -> DataFrame:
    """Adds ``score``: the weight and a Gumbel draw that the key alone decides."""
    text = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """Adds ``rank`` among the rows with enough words: 1 to ``drawn``, null beyond.

    Rows are sorted into range partitions; each partition's count, one row, gives the
    places before it.
    """
    order = [F.asc("_short"), F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = rows.withColumn("_short", (F.col("n_words") < LEAST_WORDS).cast("int"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = pin(rows.withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_id", ROW_BITS))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    counts = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND((1 << ROW_BITS) - 1) + 1
    placed = rows.join(F.broadcast(counts), "_part")
    return placed.withColumn("rank", F.when((F.col("_short") == 0) & (place <= drawn), place))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row, drawn towards ``target``.

    A null or empty text has no features and weight 0. Rows with equal keys share their
    noise and are ranked one by one, in any order if their texts are equal too; a null key
    is noised as the empty text and comes last among ties. Without documents there are no
    rows; an empty target has no features, so rare buckets gain.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    gain = gains(bucket_counts(rows), bucket_counts(target))
    scored = pin(with_noise(weights(rows, gain)))
    eligible = scored.where(F.col("n_words") >= LEAST_WORDS).count()
    out = ranked(scored, eligible * PERCENT // 100)
    return out.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))
