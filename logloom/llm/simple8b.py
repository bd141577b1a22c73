"""Simple-8b: 64-bit words whose low four bits say how many ids the other 60 hold.

Ids are coded in blocks of ``BLOCK_IDS``. A block's words depend on nothing outside
it, and the offsets of the blocks allow decoding any of them alone.
"""

from __future__ import annotations

import numpy as np

BLOCK_IDS = 1024
# Selectors 1 to 14: (ids in a word, bits of each). Selector 0 is the escape: the next
# word is one id of up to 64 bits as it is.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10),
            (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]


def _choices(ids: np.ndarray) -> np.ndarray:
    """For each position, the selector that packs the most ids from there on."""
    n = len(ids)
    narrow = np.uint32 if int(ids.max()) < 1 << 32 else np.uint64
    ids = ids.astype(narrow)
    widest = int(ids.max())
    place = np.arange(n, dtype=np.int64 if n >= 1 << 31 else np.int32)
    room = np.minimum((place // BLOCK_IDS + 1) * BLOCK_IDS, n) - place
    choice = np.zeros(n, np.uint8)
    for selector in range(len(PACKINGS), 0, -1):
        count, bits = PACKINGS[selector - 1]
        if widest >> bits == 0:
            choice[room >= count] = selector
            continue
        # runs of narrow ids; the narrower the fewer, so only they are looked at
        low = np.flatnonzero(ids >> narrow(bits) == 0)
        edges = np.flatnonzero(np.diff(low) != 1) + 1
        first, last = np.append(0, edges), np.append(edges, len(low))
        long = last - first >= count
        sizes = (last - first)[long] - count + 1
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.repeat(low[first[long]], sizes) + within
        choice[at[room[at] >= count]] = selector
    return choice


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned ids below 2**64."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    choice = _choices(ids)
    counts = np.array([1, *(c for c, _ in PACKINGS)])[choice]
    starts = np.arange(0, n, BLOCK_IDS)
    ends = np.minimum(starts + BLOCK_IDS, n)
    at, used = starts, np.zeros(n, bool)
    while len(at):  # one word of every block at a time
        used[at] = True
        at = at + counts[at]
        more = at < ends
        at, ends = at[more], ends[more]
    first = np.flatnonzero(used)
    selector = choice[first]
    width = np.where(selector == 0, 2, 1)
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    words[place] = selector
    escaped = selector == 0
    words[place[escaped] + 1] = ids[first[escaped]]
    for s, (count, bits) in enumerate(PACKINGS, 1):
        mine = selector == s
        a, packed = first[mine], np.uint64(s)
        for k in range(count):
            packed = packed | ids[a + k] << np.uint64(4 + k * bits)
        words[place[mine]] = packed
    edges = np.searchsorted(first, starts)
    offsets = np.append(place[edges], len(words))
    return words, offsets.astype(np.int64)


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of the words of one or more whole blocks."""
    words = np.asarray(words, np.uint64)
    selector = (words & np.uint64(15)).astype(np.int64)
    escapes = np.flatnonzero(selector == 0)
    if len(escapes):  # a raw word may look like anything, also like an escape
        raw = []
        for i in escapes.tolist():
            if not raw or raw[-1] != i:
                raw.append(i + 1)
        raw = np.array(raw)
        head = np.ones(len(words), bool)
        head[raw] = False
        # a raw word that looks like an escape is not one; heads decide in order
        heads = np.flatnonzero(head)
        selector, body = selector[heads], words[heads]
        raw_words = words[np.minimum(heads + 1, len(words) - 1)]
    else:
        body, raw_words = words, None
    counts = np.array([1, *(c for c, _ in PACKINGS)])[selector]
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s, (count, bits) in enumerate(PACKINGS, 1):
        mine = np.flatnonzero(selector == s)
        mask = np.uint64((1 << bits) - 1)
        w, a = body[mine], place[mine]
        for k in range(count):
            out[a + k] = w >> np.uint64(4 + k * bits) & mask
    if raw_words is not None:
        mine = selector == 0
        out[place[mine]] = raw_words[mine]
    return out


def decode_block(words: np.ndarray, offsets: np.ndarray, block: int) -> np.ndarray:
    return decode(words[offsets[block] : offsets[block + 1]])
