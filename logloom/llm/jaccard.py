"""Exact n-gram Jaccard join: prefix index, skipped blocks, answers derived from answers.

A document is the set of its distinct word shingles. Equal sets are one set from the
start. Shingles are ordered from rare to frequent, by a count sketch of fixed size over
all documents (any order gives the same links), and only the first shingles of a set,
its prefix, are indexed: two sets that link share one of those.

1. *Lists.* The postings of one shingle are sorted by size and read as a stream. They
   fall into blocks within which sizes allow a link; a block's first set is its leader.
   Rows out of reach of all others of their list are dropped: sets that link do so at
   their first common shingle, and what stands before it in either is not shared.
2. *Leaders.* Every set is compared with the leaders of its blocks only, so a group of
   near copies costs a number of comparisons linear in its size. A set that links takes
   a leader as home and keeps how many shingles it adds to it.
3. *The rest.* What is left are pairs of sets from different components that share a
   list. They are looked at by homes: a whole block is skipped if its positions and
   sizes in the list rule out a link, and pairs of members are skipped or linked when
   the overlap of their homes and the shingles they add or lack decide it. Only what
   stays open is compared. If homes have many members, some of each are tried first, as
   what they join need not be compared with the others; then all are.

No list is cut and no pair that could join two components is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.cells import chunks, total
from logloom.llm.text import SHINGLE_WORDS, blocks, column, shingle_sets, signed, texts
from logloom.operators.roles import connected_components
from logloom.runtime import dimension, pin

PERCENT = 80
# Cells of the count sketch: eight megabytes at any input size.
CELL_BITS = 20
# Sets a task remembers so that it indexes copies once; emptied beyond it.
REMEMBERED = 1_000_000
NO_ID = -(1 << 63)


def _set_id(items: np.ndarray) -> int:
    """64 bits of a set; among n sets two share one with a chance of n**2 / 2**65."""
    return xxhash.xxh3_64_intdigest(items.tobytes())


def _as_long(values: list[int]) -> pa.Array:
    return pa.array(signed(np.array(values, np.uint64)))


def summaries(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """Rows (key, n_shingles, set_id) and, of each task, rows (chunk, counts) of the sketch."""

    def run(batches):
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        names = ["key", "n_shingles", "set_id", "chunk", "cells"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in blocks(batches):
            sets = shingle_sets(*texts(column(batch, "text")), words)
            n = len(sets)
            sizes = np.array([len(s) for s in sets], np.int64)
            ids = _as_long([_set_id(s) for s in sets])
            every = np.concatenate([np.zeros(0, np.uint64), *sets])
            np.add.at(cells, every >> np.uint64(64 - CELL_BITS), np.uint32(1))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), pa.array(sizes), ids, pa.nulls(n, types[3]), pa.nulls(n, types[4])],
                names,
            )
        for chunk, part in chunks(cells):
            row = [None, None, None, chunk, part]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    kind = "key long, n_shingles long, set_id long, chunk int, cells binary"
    return docs.select("key", "text").mapInArrow(run, kind)


def frequency_levels(sketch: DataFrame) -> bytes:
    """A byte for each cell of the summed sketch: eight times the logarithm of its count."""
    counts = total(sketch, 1 << CELL_BITS, "uint32", "uint64")
    return np.minimum(8 * np.log2(counts + 1.0), 255).astype(np.uint8).tobytes()


def postings(docs: DataFrame, levels: bytes, percent: int, words: int) -> DataFrame:
    """(shingle, set_id, size, pos) of the prefix of every set, copies once in a task."""

    def run(batches):
        level = np.frombuffer(levels, np.uint8)
        seen: set[int] = set()
        for batch in blocks(batches):
            if len(seen) > REMEMBERED:
                seen.clear()
            items, ids, sizes, counts = [], [], [], []
            for s in shingle_sets(*texts(column(batch, "text")), words):
                if not len(s) or (own := _set_id(s)) in seen:
                    continue
                seen.add(own)
                n = len(s)
                order = np.argsort(level[s >> np.uint64(64 - CELL_BITS)], kind="stable")
                items.append(s[order[: n - (percent * n + 99) // 100 + 1]])
                ids.append(own)
                sizes.append(n)
                counts.append(len(items[-1]))
            if not items:
                continue
            counts = np.array(counts)
            pos = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(np.concatenate(items))),
                    pa.array(signed(np.repeat(np.array(ids, np.uint64), counts))),
                    pa.array(np.repeat(np.array(sizes, np.int32), counts)),
                    pa.array(pos.astype(np.int32)),
                ],
                ["shingle", "set_id", "size", "pos"],
            )

    kind = "shingle long, set_id long, size int, pos int"
    return docs.select("text").mapInArrow(run, kind)


LISTS = "shingle long, set_id long, size int, pos int, leader long, lead_size int, lead_pos int"


def _leaders(start: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """The row that leads each row's block; ``start``: the first row of its list."""
    lead = start.copy()
    while True:
        off = np.flatnonzero(percent * size > 100 * size[lead])
        if not len(off):
            return lead
        # the first set too large for its leader leads those after it in its list
        first = off[np.concatenate([[True], start[off[1:]] != start[off[:-1]]])]
        mark = np.zeros(len(lead), np.int64)
        mark[first] = first
        reach = np.maximum.accumulate(mark)
        lead = np.where(reach >= start, np.maximum(lead, reach), lead)


def _list_rows(rows: list[np.ndarray], lead: np.ndarray, keep: np.ndarray) -> pa.RecordBatch:
    ids = [r[keep] for r in rows] + [r[lead][keep] for r in rows[1:]]
    return pa.RecordBatch.from_arrays([pa.array(r) for r in ids], [c.split()[0] for c in LISTS.split(", ")])


# Rows of a list whose pairs are all tried before it is written.
SHORT = 8


def _partnered(start: np.ndarray, size: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Whether a row is within reach (as in _reach) of another one of its list.

    In lists of more than SHORT rows only the other's size is looked at. ``start``: the
    first row of its list; the rows of a list are sorted by size.
    """
    rest = size - pos
    near = np.zeros(len(size), bool)
    for d in range(1, min(SHORT, len(size))):
        a, b = slice(None, -d), slice(d, None)
        met = (100 + percent) * np.minimum(rest[a], rest[b]) >= percent * (size[a] + size[b])
        met &= start[a] == start[b]
        near[a] |= met
        near[b] |= met
    at = start << 32
    least = -(-percent * size // 100)
    most = (100 + percent) * rest // percent - size
    first = np.searchsorted(at + size, at + least, "left")
    last = np.searchsorted(at + size, at + np.clip(most, 0, (1 << 32) - 1), "right")
    long = np.bincount(start, minlength=len(start))[start] > SHORT
    return near | long & (last - first > (size <= most))


def lists(posted: DataFrame, percent: int) -> DataFrame:
    """The postings within reach of another set of their shingle, with their block's leader."""

    def run(batches):
        # of the last list: its only row so far, or else its last leader and last set
        single, leader, last = None, None, None
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if not len(rows[0]):
                continue
            if leader is not None:
                n = int(np.searchsorted(rows[0], leader[0], "right"))
                head = [np.concatenate([[x], r[:n]]).astype(r.dtype) for x, r in zip(leader, rows)]
                rows = [r[n:] for r in rows]
                if n:
                    keep = np.ones(n + 1, bool)
                    keep[0] = False  # it went out before
                    keep[1:] = head[1][1:] != np.concatenate([[last], head[1][1:-1]])
                    lead = _leaders(np.zeros(n + 1, np.int64), head[2].astype(np.int64), percent)
                    yield _list_rows(head, lead, keep)
                    leader, last = [r[lead[-1]] for r in head], head[1][-1]
                if not len(rows[0]):
                    continue
            elif single is not None:
                rows = [np.concatenate([[x], r]).astype(r.dtype) for x, r in zip(single, rows)]
            new = np.ones(len(rows[0]), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            rows = [r[new] for r in rows]
            starts = np.flatnonzero(np.diff(rows[0], prepend=~rows[0][:1]) != 0)
            sizes = np.diff(np.append(starts, len(rows[0])))
            start = np.repeat(starts, sizes)
            size = rows[2].astype(np.int64)
            lead = _leaders(start, size, percent)
            keep = _partnered(start, size, rows[3].astype(np.int64), percent)
            if sizes[-1] > 1:
                keep[starts[-1] :] = True  # the list may go on
            yield _list_rows(rows, lead, keep)
            if sizes[-1] > 1:
                single, leader, last = None, [r[lead[-1]] for r in rows], rows[1][-1]
            else:
                single, leader, last = [r[-1] for r in rows], None, None

    order = ["shingle", "size", "set_id"]
    parts = int(posted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = posted.repartition(parts, "shingle").sortWithinPartitions(*order)
    return ordered.mapInArrow(run, LISTS)


def _links(overlap, a, b, percent: int):
    """Whether two sets of these sizes link: percent of the union is shared."""
    return (100 + percent) * overlap >= percent * (a.cast("long") + b.cast("long"))


# Rounds of comparing with leaders, at most, and the part of the sets still apart below
# which another round is worth while. What they leave is found all the same.
LEADER_ROUNDS, GAIN = 8, 0.8
# Members of one leader that go through one task.
TOGETHER = 256
# Members of one home that are tried on sets of other components before all of them are:
# most of those that link do so with several, and what is joined is not compared again.
CROWD = 64


def compare(pairs: DataFrame, docs: DataFrame, active: DataFrame, words: int) -> DataFrame:
    """Adds ``overlap`` and both sizes to (a, b): sets made from the texts again.

    ``pairs`` is a written table, ``active`` (set_id, key) names a document of each set.
    The sets of a pair meet at ``a``, whose own is sent once for up to TOGETHER others
    and held while those stream by. Texts are not moved as long as the few documents
    wanted fit a bounded broadcast.
    """
    salt = F.pmod(F.xxhash64("b"), F.col("parts"))
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    wanted = parts.select(
        F.col("a").alias("set_id"),
        "a",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.lit(None).cast("long").alias("b"),
    ).unionByName(
        pairs.join(parts, "a").select(F.col("b").alias("set_id"), "a", salt.alias("part"), "b")
    )
    wanted = pin(wanted)
    ids = pin(wanted.select("set_id").distinct().join(active, "set_id"))
    found = docs.join(dimension(ids, ids.count()), "key").select("text", "set_id")
    sets = found.mapInArrow(_sets(words), "set_id long, items binary")
    sent = sets.join(dimension(wanted, wanted.count()), "set_id").select("a", "part", "b", "items")

    def run(batches):
        leader, items, last = None, None, None
        for batch in batches:
            a, part, b = (c.to_pylist() for c in batch.columns[:3])
            out = []
            for i, at in enumerate(zip(a, part)):
                if b[i] is None:
                    leader, last = at, None
                    items = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64).copy()
                elif at == leader and b[i] != last:
                    own = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64)
                    same = len(np.intersect1d(items, own, assume_unique=True))
                    out.append((a[i], b[i], same, len(items), len(own)))
                    last = b[i]
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["a", "b", "overlap", "size_a", "size_b"]
            )

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = sent.repartition(n, "a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    return met.mapInArrow(run, "a long, b long, overlap long, size_a long, size_b long")


def _sets(words: int):
    def run(batches):
        for batch in blocks(batches):
            sets = shingle_sets(*texts(column(batch, "text")), words)
            ids = _as_long([_set_id(s) for s in sets])
            items = pa.array([s.tobytes() for s in sets], pa.binary())
            out = pa.RecordBatch.from_arrays([ids, items], ["set_id", "items"])
            # rows that share the key of a wanted set need not have its text
            yield out.filter(pc.equal(ids, column(batch, "set_id")))

    return run


def link_components(
    docs: DataFrame, key: str = "doc_id", percent: int = PERCENT, words: int = SHINGLE_WORDS
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    ``component_id`` is the smallest key reachable by links, a row's own included.
    Rows with equal keys keep their rows and may differ in text; a null key counts as
    smallest and stays null. A null text or one without words has no shingles and links
    with nothing, not even with another such text. Other columns are not looked at.
    """
    docs = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("key"), "text")
    found = pin(summaries(docs, words))
    rows = found.where("chunk is null").select("key", "n_shingles", "set_id")
    levels = frequency_levels(found.where("chunk is not null").select("chunk", "cells"))
    owners = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("key").alias("key"))

    listed = pin(lists(postings(docs, levels, percent, words), percent))
    active = pin(owners.join(listed.select("set_id").distinct(), "set_id"))

    def overlaps(pairs: DataFrame) -> DataFrame:
        return compare(pin(pairs), docs, active, words)

    # leaders: first those of the blocks, then members of large components
    to_leader = listed.where("leader <> set_id").where(
        _links(
            _reach(F.col("pos"), F.col("size"), F.col("lead_pos"), F.col("lead_size")),
            F.col("size"),
            F.col("lead_size"),
            percent,
        )
    )
    pairs = to_leader.select(F.col("leader").alias("a"), F.col("set_id").alias("b")).distinct()
    nodes = active.select(F.col("set_id").alias("node"))
    linked, groups, apart, live = None, None, None, listed
    for k in range(LEADER_ROUNDS):
        answers = overlaps(pairs)
        found = answers.where(_links(F.col("overlap"), F.col("size_a"), F.col("size_b"), percent))
        linked = pin(found if linked is None else linked.unionByName(found))
        edges = linked.select(F.col("a").alias("x"), F.col("b").alias("y"))
        groups = pin(connected_components(nodes, edges))
        live = pin(_open_lists(live, groups, k))
        pairs = pin(_with_members(live, percent, k))
        left = pairs.count()
        if not left or (apart is not None and left > GAIN * apart):
            break
        apart = left
    homes = linked.groupBy("b").agg(
        F.min_by(
            F.struct(
                F.col("a").alias("home"),
                (F.col("size_b") - F.col("overlap")).alias("adds"),
                (F.col("size_a") - F.col("overlap")).alias("lacks"),
            ),
            F.struct(-F.col("overlap"), F.col("a")),
        ).alias("h")
    )
    homes = homes.select(F.col("b").alias("set_id"), "h.*")
    placed = groups.withColumnRenamed("node", "set_id").join(homes, "set_id", "left")
    placed = placed.select(
        "set_id",
        "component",
        F.coalesce("home", "set_id").alias("home"),
        F.coalesce("adds", F.lit(0)).alias("adds"),
        F.coalesce("lacks", F.lit(0)).alias("lacks"),
    )
    sized = listed.groupBy("set_id").agg(F.max("size").alias("size"))
    placed = pin(placed.join(sized, "set_id"))

    # lists of one component have nothing left to find
    crowd = _crowd(placed)
    if crowd is not None:
        more = pin(_remaining_links(live, placed, overlaps, percent, crowd))
        placed = pin(_merged(placed, more))
    more = pin(_remaining_links(live, placed, overlaps, percent))
    named = _merged(placed, more).join(active, "set_id")
    least = named.groupBy("component").agg(F.min("key").alias("component_id"))
    named = named.join(least, "component").select("set_id", "component_id")
    classes = owners.join(named, "set_id", "left").select(
        "set_id", F.coalesce("component_id", "key").alias("component_id")
    )
    alone = rows.where("n_shingles = 0").withColumn("component_id", F.col("key"))
    grouped = rows.where("n_shingles > 0").join(classes, "set_id")
    out = grouped.select("key", "n_shingles", "component_id").unionByName(
        alone.select("key", "n_shingles", "component_id")
    )

    def shown(c):
        return F.when(F.col(c) != NO_ID, F.col(c))

    return out.select(
        shown("key").alias(key), "n_shingles", shown("component_id").alias("component_id")
    )


def _reach(pos_a, size_a, pos_b, size_b):
    """The most shingles two sets can share if those at these positions are their first common one.

    Sets that link are within reach where their first common shingle is listed, so they are
    found there if all other lists pass them over.
    """
    return F.least(size_a - pos_a, size_b - pos_b)


def _open_lists(live: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """The lists with more than one component, and of each a member ``c`` of its largest one.

    Another member is chosen in each turn. Lists only ever leave, as components grow.
    """
    sizes = groups.groupBy("component").agg(F.count("*").alias("members"))
    known = groups.join(sizes, "component").withColumnRenamed("node", "set_id")
    rows = live.select("shingle", "set_id", "size", "pos").join(known, "set_id")
    of_list = W.partitionBy("shingle")
    chosen = F.max_by(
        F.struct("set_id", "size", "pos", "component"),
        F.struct("members", "component", F.xxhash64("set_id", F.lit(turn))),
    )
    rows = rows.withColumns({
        "low": F.min("component").over(of_list),
        "high": F.max("component").over(of_list),
        "c": chosen.over(of_list),
    })
    return rows.where("low <> high").drop("low", "high", "members")


def _with_members(live: DataFrame, percent: int, turn: int) -> DataFrame:
    """A pair (a, b) for each set b that shares a list with a set of a larger component.

    Of the lists of a set one is chosen that may link it. In a group of near copies most
    sets find their way into one component by this, at one comparison in each turn.
    """
    near = live.where(
        (F.col("component") != F.col("c.component"))
        & _links(
            _reach(F.col("pos"), F.col("size"), F.col("c.pos"), F.col("c.size")),
            F.col("size"),
            F.col("c.size"),
            percent,
        )
    )
    return near.groupBy(F.col("set_id").alias("b")).agg(
        F.min_by("c.set_id", F.xxhash64("c.set_id", "set_id", F.lit(turn))).alias("a")
    ).select("a", "b")


def _crowd(placed: DataFrame) -> DataFrame | None:
    """CROWD members each of the homes that have more, if there are such."""
    sizes = placed.groupBy("home").agg(F.count("*").alias("members"))
    large = pin(sizes.where(F.col("members") > CROWD).select("home"))
    if large.isEmpty():
        return None
    of_home = W.partitionBy("home").orderBy(F.xxhash64("set_id"), "set_id")
    members = placed.join(large, "home").withColumn("rank", F.row_number().over(of_home))
    return pin(members.where(F.col("rank") <= CROWD).select("set_id"))


def _merged(placed: DataFrame, links: DataFrame) -> DataFrame:
    """``placed`` with the components that ``links`` leave."""
    parts = placed.select(F.col("component").alias("node")).distinct()
    joined = connected_components(parts, links)
    joined = joined.select(F.col("node").alias("part"), F.col("component").alias("joined"))
    found = placed.join(joined, placed["component"] == joined["part"])
    return found.withColumn("component", F.col("joined")).drop("part", "joined")


def _spans(rows: DataFrame) -> DataFrame:
    """The blocks of ``rows``: what a component's members of one home have in a list."""
    return rows.groupBy("shingle", "component", "home").agg(
        F.min("size").alias("small"),
        F.max("size").alias("large"),
        F.max(F.col("size") - F.col("pos")).alias("rest"),
    )


def _remaining_links(
    listed: DataFrame, placed: DataFrame, overlaps, percent: int, some: DataFrame | None = None
) -> DataFrame:
    """Links (x, y) between components, from all pairs that share a list but no component.

    With ``some`` (set_id): only from pairs with one of those.
    """
    rows = listed.select("shingle", "set_id", "size", "pos").join(placed.drop("size"), "set_id")
    spans = pin(_spans(rows))
    if some is None:
        first, apart = rows, F.col("a.home") < F.col("b.home")
        a, b = spans.alias("a"), spans.alias("b")
    else:
        first, apart = rows.join(some, "set_id", "left_semi"), F.lit(True)
        a, b = pin(_spans(first)).alias("a"), spans.alias("b")
    # of the members of two blocks, as in _reach
    reach = F.least("a.rest", "b.rest")
    near = (
        (F.col("a.shingle") == F.col("b.shingle"))
        & apart
        & (F.col("a.component") != F.col("b.component"))
        & (100 * F.col("a.large") >= percent * F.col("b.small"))
        & (100 * F.col("b.large") >= percent * F.col("a.small"))
        & _links(reach, F.col("a.small"), F.col("b.small"), percent)
    )
    near = pin(a.join(b, near).select("a.shingle", F.col("a.home").alias("a"), F.col("b.home").alias("b")))
    answers = pin(overlaps(near.select("a", "b").distinct()))
    direct = answers.where(_links(F.col("overlap"), F.col("size_a"), F.col("size_b"), percent))

    # members of two homes: their overlap lies within what they add to and lack of these
    members = placed.where("adds > 0 or lacks > 0 or set_id <> home")
    widest = members.groupBy("home").agg(
        F.max("adds").alias("adds"), F.min("size").alias("size")
    )
    wide = {
        side: widest.select(
            F.col("home").alias(side),
            F.col("adds").alias(f"adds_{side}"),
            F.col("size").alias(f"least_{side}"),
        )
        for side in "ab"
    }
    open_pairs = answers.join(wide["a"], "a", "left").join(wide["b"], "b", "left")
    top = F.col("overlap") + F.coalesce("adds_a", F.lit(0)) + F.coalesce("adds_b", F.lit(0))
    open_pairs = open_pairs.where("adds_a is not null or adds_b is not null").where(
        _links(
            top,
            F.least("size_a", F.coalesce("least_a", "size_a")),
            F.least("size_b", F.coalesce("least_b", "size_b")),
            percent,
        )
        & ~_links(F.col("overlap"), F.col("size_a"), F.col("size_b"), percent)
    )
    # as their homes do, they meet in the list of their first common shingle
    x = first.select(*[F.col(c).alias(f"x_{c}") for c in rows.columns])
    y = rows.select(*[F.col(c).alias(f"y_{c}") for c in rows.columns])
    reach = _reach(F.col("x_pos"), F.col("x_size"), F.col("y_pos"), F.col("y_size"))
    top = F.least(reach, F.col("overlap") + F.col("x_adds") + F.col("y_adds"))
    sure = F.col("overlap") - F.col("x_lacks") - F.col("y_lacks")
    derived = (
        near.join(open_pairs.select("a", "b", "overlap"), ["a", "b"])
        .join(x, (F.col("shingle") == F.col("x_shingle")) & (F.col("a") == F.col("x_home")))
        .join(
            y,
            (F.col("shingle") == F.col("y_shingle"))
            & (F.col("b") == F.col("y_home"))
            & (F.col("x_component") != F.col("y_component"))
            & ((F.col("x_set_id") != F.col("a")) | (F.col("y_set_id") != F.col("b")))
            & _links(top, F.col("x_size"), F.col("y_size"), percent),
        )
        .select(
            F.col("x_set_id").alias("a"),
            F.col("y_set_id").alias("b"),
            _links(sure, F.col("x_size"), F.col("y_size"), percent).alias("sure"),
        )
        .distinct()
    )
    derived = pin(derived)
    open_still = overlaps(derived.where("not sure").select("a", "b").distinct())
    open_still = open_still.where(
        _links(F.col("overlap"), F.col("size_a"), F.col("size_b"), percent)
    )
    found = (
        direct.select("a", "b")
        .unionByName(derived.where("sure").select("a", "b"))
        .unionByName(open_still.select("a", "b"))
    )
    part = placed.select("set_id", "component")
    left = part.select(F.col("set_id").alias("a"), F.col("component").alias("x"))
    right = part.select(F.col("set_id").alias("b"), F.col("component").alias("y"))
    return found.join(left, "a").join(right, "b").select("x", "y").where("x <> y").distinct()
