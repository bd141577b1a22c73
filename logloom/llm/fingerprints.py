"""Document fingerprints: every shingle hash below a fixed threshold is retained.

Shingles are the runs of ``SHINGLE_BYTES`` bytes of the text; a shorter text is one
shingle. A sketch holds all distinct hashes below ``2**64 / SCALE``, and besides always
the ``FLOOR`` smallest, so a short text is not left without any. Both rules depend only
on the set of hashes, so the sketch of a union is made from the sketches alone, and two
documents of very unequal length can be compared. Of a short document only the hashes
below the long one's limit can be, one in ``SCALE``; if it has none there, its containment
is not known.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import BLOCK_BYTES, mix

SHINGLE_BYTES = 16  # a power of two
SCALE = 16
FLOOR = 32
THRESHOLD = np.uint64((1 << 64) // SCALE)
# Keys looked at for each partition when the cuts between partitions are chosen.
KEYS_PER_CUT = 64

_BASE = np.uint64(0xA0761D6478BD642F)


def _rolled(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SHINGLE_BYTES bytes, by doubling the length of the runs."""
    h = mix(np.arange(1, 257, dtype=np.uint64))[data]
    power, size = _BASE, 1
    while size < SHINGLE_BYTES:
        h = h[:-size] * power + h[size:]
        power, size = power * power, 2 * size
    return mix(h)


def sketches(texts: list[bytes]) -> list[np.ndarray]:
    """The sketch of each text as sorted hashes; an empty text has an empty one."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    with np.errstate(over="ignore"):
        rolled = _rolled(data) if len(data) >= SHINGLE_BYTES else np.zeros(0, np.uint64)
    low = np.flatnonzero(rolled < THRESHOLD)
    out, at = [], 0
    for text in texts:
        end = at + len(text)
        last = end - SHINGLE_BYTES + 1
        if not text:
            out.append(np.zeros(0, np.uint64))
        elif last <= at:
            digest = hashlib.blake2b(text, digest_size=8).digest()
            out.append(np.frombuffer(digest, "<u8").astype(np.uint64))
        else:
            a, b = np.searchsorted(low, (at, last))
            kept = np.unique(rolled[low[a:b]])
            out.append(kept if len(kept) >= FLOOR else np.unique(rolled[at:last])[:FLOOR])
        at = end
    return out


def reach(sketch: np.ndarray) -> int:
    """The largest hash up to which a sketch is complete."""
    if len(sketch) < FLOOR:
        return (1 << 64) - 1  # it holds every hash of the document
    return max(int(sketch[FLOOR - 1]), int(THRESHOLD) - 1)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two documents taken together."""
    both = np.union1d(a, b)
    kept = int(np.searchsorted(both, THRESHOLD))
    return both[: max(kept, FLOOR)]


def _comparable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    limit = np.uint64(min(reach(a), reach(b)))
    return a[: np.searchsorted(a, limit, "right")], b[: np.searchsorted(b, limit, "right")]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two empty sketches are equal."""
    a, b = _comparable(a, b)
    if not len(a) and not len(b):
        return 1.0
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same / (len(a) + len(b) - same)


def containment(a: np.ndarray, b: np.ndarray) -> float | None:
    """Estimated part of the first document's shingles that the second has.

    An empty document is contained in any; None if no hash of the first is comparable.
    """
    if not len(a):
        return 1.0
    a, b = _comparable(a, b)
    if not len(a):
        return None
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def as_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8").astype(np.uint64)


def fingerprint(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint) of every text; null counts as empty. No exchange."""

    def run(batches):
        for batch in batches:
            keys, rows = batch.column(0), batch.column(1).to_pylist()
            marks = [as_text(s) for s in _in_blocks([(t or "").encode() for t in rows])]
            yield pa.RecordBatch.from_arrays([keys, pa.array(marks, pa.string())], ["k", "f"])

    keyed = docs.select(F.col(key).alias("k"), "text")
    kind = docs.schema[key].dataType.simpleString()
    return keyed.mapInArrow(run, f"k {kind}, f string").toDF(key, "fingerprint")


def _in_blocks(texts: list[bytes]) -> Iterator[np.ndarray]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK_BYTES):
            size += len(texts[to])
            to += 1
        yield from sketches(texts[at:to])
        at = to


def in_descending_order(docs: DataFrame) -> DataFrame:
    """(key, text, halo) dealt into ranges, each sorted downwards and then one row more.

    The row more, with ``halo`` true, is the one that follows the range in the order
    (key, hash of the text) downwards, null keys last; after the last row comes the
    first. Where to cut is taken from a sample of keys, whose size goes with the number
    of partitions; the driver sees those and one key of each range, no texts.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("key"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("place", F.struct(F.col("key"), F.xxhash64("text").alias("h")))
    places = keyed.select("place")
    one_in = max(1, places.count() // (KEYS_PER_CUT * parts))
    some = places.where(F.pmod(F.xxhash64("place"), F.lit(one_in)) == 0).distinct().collect()
    some = sorted({_comparable_key(r["place"]) for r in some})
    cuts = list(dict.fromkeys(some[len(some) * i // parts] for i in range(1, parts))) if some else []
    ranged = keyed.withColumn("part", (F.lit(parts - 1) - _cuts_below(cuts)).cast("int"))
    heads = ranged.groupBy("part").agg(F.max("place").alias("place")).collect()
    heads.sort(key=lambda r: r["part"])
    # by range: its first row, and the range before it, which ends with that row too
    at = {r["part"]: (_literal(_comparable_key(r["place"])), heads[i - 1]["part"]) for i, r in enumerate(heads)}
    nowhere = (F.lit(None).cast("struct<key:long,h:long>"), -1)
    rows = [at.get(p, nowhere) for p in range(parts)]
    first = F.get(F.array(*[place for place, _ in rows]), F.col("part"))
    before = F.get(F.array(*[F.lit(to) for _, to in rows]), F.col("part"))
    none = F.array().cast("array<struct<to:int,halo:boolean>>")
    copy = F.struct(before.cast("int").alias("to"), F.lit(True).alias("halo"))
    own = F.struct(F.col("part").alias("to"), F.lit(False).alias("halo"))
    at_head = F.col("place") == first
    targets = F.concat(F.array(own), F.when(at_head, F.array(copy)).otherwise(none))
    sent = ranged.select("key", "text", "place", F.explode(targets).alias("t"))
    return (
        sent.select("key", "text", "place", "t.to", "t.halo")
        .repartitionById(parts, F.col("to"))
        .sortWithinPartitions("halo", F.desc("place"))
        .select("key", "text", "halo")
    )


def _cuts_below(cuts: list[tuple]):
    """How many of the ascending cuts are at or below ``place``: first by groups of them.

    All cuts are elements of two array literals, so the plan has the same depth however
    many there are. Null keys are the smallest, in Spark's order of structs as well.
    """
    if not cuts:
        return F.lit(0)
    groups = [cuts[i : i + CUTS_IN_GROUP] for i in range(0, len(cuts), CUTS_IN_GROUP)]
    below = lambda array: F.size(F.filter(array, lambda c: c <= F.col("place")))
    whole = below(F.array(*[_literal(g[0]) for g in groups]))
    inside = F.get(F.array(*[F.array(*map(_literal, g)) for g in groups]), whole - 1)
    return F.when(whole == 0, 0).otherwise((whole - 1) * CUTS_IN_GROUP + below(inside))


def _comparable_key(place) -> tuple:
    return (place["key"] is not None, place["key"] or 0, place["h"])


def _literal(place: tuple):
    key = F.lit(place[1] if place[0] else None).cast("long")
    return F.struct(key.alias("key"), F.lit(place[2]).cast("long").alias("h"))


# Cuts between ranges that are compared with a row after its group of cuts is found.
CUTS_IN_GROUP = 64

EDITED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double"
)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    The next document is the one with the next smaller ``doc_id``; rows with equal
    ids follow each other by the hash of their text, null ids come last, and after
    the last document comes the first. Null texts count as empty, an only document
    follows itself, no documents give no rows. Other columns are not looked at.
    """

    def run(batches):
        held = None  # the document before the current one: (key, text, sketch)
        for keys, texts, halos in _small_batches(batches):
            marks = sketches([t.encode() for t in texts])
            rows = list(zip(keys, texts, marks))
            ended = halos.index(True) if True in halos else None
            if ended is not None:
                rows = rows[: ended + 1]  # further copies of that row are of no use
            line = ([held] if held else []) + rows
            edited = []
            for (_, text, _), (_, after, _) in zip(line, line[1:]):
                half = len(text) // 2
                edited.append((text[: len(text) - half] + after[:half]).encode())
            edited_marks = sketches(edited)
            yield _result(line, edited, edited_marks)
            held = rows[-1]
            if ended is not None:
                for _ in batches:
                    pass
                return

    return in_descending_order(docs).mapInArrow(run, EDITED)


def _small_batches(batches):
    for batch in batches:
        keys, texts, halos = (c.to_pylist() for c in batch.columns)
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK_BYTES):
                size += len(texts[to])
                to += 1
            yield keys[at:to], texts[at:to], halos[at:to]
            at = to


def _result(line: list, edited: list[bytes], edited_marks: list[np.ndarray]) -> pa.RecordBatch:
    pairs = list(zip(line, line[1:], edited_marks))
    columns = [
        pa.array([a[0] for a, _, _ in pairs], pa.int64()),
        pa.array([len(a[1]) for a, _, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array([as_text(a[2]) for a, _, _ in pairs], pa.string()),
        pa.array([as_text(m) for _, _, m in pairs], pa.string()),
        pa.array([likeness(a[2], m) for a, _, m in pairs], pa.float64()),
        pa.array([likeness(a[2], b[2]) for a, b, _ in pairs], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in EDITED.split(", ")])
