import random

import brute
import numpy as np
import pytest
from brute import prose

from logloom.llm import jaccard


def edited(text: str, edits: int, seed: int) -> str:
    r = random.Random(seed)
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def corpus():
    """Copies, near copies on both sides of the threshold, chains, shared passages."""
    r = random.Random(7)
    texts = [prose(k, r.choice([3, 4, 5, 6, 20, 60, 150])) for k in range(40)]
    out = list(texts)
    for k, t in enumerate(texts):
        n = len(t.split())
        for e in range(r.randint(0, 5)):
            out.append(edited(t, max(1, n * e // 60), 100 * k + e))
    chain = prose(99, 120)
    for k in range(8):  # each links with the next, the ends do not link
        chain = edited(chain, 2, k)
        out.append(chain)
    passage = prose(77, 60)  # shared, in texts that are not alike
    out += [f"{prose(500 + k, 6 + k % 9)} {passage} {prose(600 + k, 5 + k % 7)}" for k in range(40)]
    out += [texts[0], texts[0].upper(), None, "", " \n", texts[5]]
    r.shuffle(out)
    return [(3 * k + 1, t) for k, t in enumerate(out)]


def components(docs):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()}


def test_components(make_docs):
    rows = corpus()
    assert components(make_docs(rows)) == brute.op6(rows)


def test_members_are_told_apart_by_their_homes(make_docs, monkeypatch):
    """Two groups of near copies that link by few of their members, and one that misses."""
    monkeypatch.setattr(jaccard, "TOGETHER", 3)
    a = prose(1, 200)
    rows = [(k, edited(a, 1 + k % 3, k)) for k in range(30)]
    half = edited(a, 9, 50)
    rows += [(100 + k, edited(half, 1 + k % 4, 60 + k)) for k in range(30)]
    rows += [(200 + k, edited(half, 14, 90 + k)) for k in range(10)]
    assert components(make_docs(rows)) == brute.op6(rows)


def test_lists_go_on_over_batches(spark, make_docs):
    rows = [(k, edited(prose(k % 3, 30), k % 4, k)) for k in range(300)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert components(make_docs(rows)) == brute.op6(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("percent", [50, 90])
def test_leaders(percent):
    size = np.array([10, 11, 12, 13, 20, 21, 5, 9, 30, 31])
    start = np.array([0, 0, 0, 0, 0, 0, 6, 6, 6, 6])
    lead = jaccard._leaders(start, size, percent)
    for k, at in enumerate(lead.tolist()):
        assert start[k] <= at <= k and 100 * size[at] >= percent * size[k]
        assert at == start[k] or percent * size[at] > 100 * size[lead[at - 1]]


def test_odd_rows(clashing, odd_rows, no_docs):
    got = jaccard.link_components(clashing).collect()
    assert len(got) == len(odd_rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by_id[1] == [(0, 1)] and by_id[2] == [(0, 2)] and by_id[3] == [(0, 3)]
    assert by_id[4] == [(1, 4)] and by_id[5] == [(1, 4)] * 2
    assert {c for _, c in by_id[7]} == {6} and sorted(by_id[None])[0] == (0, None)
    assert by_id[8][0][1] == 8 == by_id[9][0][1]
    assert jaccard.link_components(no_docs).count() == 0


def test_near_copies_that_do_not_link_are_hardly_compared(make_docs, monkeypatch):
    """A group of 80 near copies at 60 %: all pairs share lists, none is within reach."""
    counts, compare = [], jaccard.compare
    monkeypatch.setattr(
        jaccard, "compare", lambda pairs, *rest: counts.append(pairs.count()) or compare(pairs, *rest)
    )
    base = prose(1, 200)
    rows = [(k, edited(base, 5, k)) for k in range(80)]
    assert components(make_docs(rows)) == brute.op6(rows)
    assert sum(counts) <= 5 * len(rows)


def test_crowded_homes_are_tried_by_some_members_first(make_docs, monkeypatch):
    monkeypatch.setattr(jaccard, "CROWD", 3)
    base = prose(2, 150)
    rows = [(k, edited(base, 1 + k % 4, k)) for k in range(60)]
    rows += [(100 + k, prose(300 + k, 40)) for k in range(5)]
    assert components(make_docs(rows)) == brute.op6(rows)


@pytest.mark.parametrize("percent", [50, 80])
def test_rows_out_of_reach_are_dropped(percent):
    r = np.random.default_rng(3)
    for short in (True, False):
        n = np.repeat([1, 2, 5, 8, 3] if short else [30, 9, 60], 1)
        start = np.repeat(np.cumsum(n) - n, n)
        size = r.integers(5, 60, len(start))
        size = size[np.lexsort((size, start))]
        pos = (size * r.random(len(start)) * (100 - percent) / 100).astype(np.int64)
        got = jaccard._partnered(start, size, pos, percent)
        for k in range(len(start)):
            other = (start == start[k]) & (np.arange(len(start)) != k)
            reach = np.minimum(size - pos, size[k] - pos[k])
            met = bool((other & ((100 + percent) * reach >= percent * (size + size[k]))).any())
            assert got[k] == met if short else got[k] >= met
