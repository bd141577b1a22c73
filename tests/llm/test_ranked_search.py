import math
import re
from collections import Counter

import pytest
from brute import lower, prose

from logloom.llm import ranked_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute(docs, items):
    """(item_id, rank, doc_id, score) rows; docs and items are (id, text) lists."""
    terms = [(i, Counter(TERM.findall(lower(t)))) for i, t in docs]
    terms = [(i, c) for i, c in terms if c]
    n, total = len(terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(w for _, c in terms for w in c)
    out = []
    for item, text in items:
        wanted = [w for w in set(TERM.findall(lower(text))) if df[w]]
        weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) for w in wanted}
        scored = []
        for i, c in terms:
            m = 100 - 90 + 90 * sum(c.values()) * n // total
            s = sum(weight[w] * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in wanted)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:10])]
    return out


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def make_items(spark):
    return lambda r: spark.createDataFrame(r, "item_id long, text string")


@pytest.fixture(scope="module")
def corpus():
    words = prose(3, 120).split()
    docs = [(k, " ".join(words[(k * j * j + j) % 120] for j in range(3 + k % 37))) for k in range(400)]
    docs += [(500 + k, docs[7][1]) for k in range(15)]  # copies: ties by doc_id
    items = [(k, " ".join(words[(k * 11 + j) % 120] for j in range(1 + 5 * k))) for k in range(20)]
    return docs, items


def test_equals_brute_force(make_docs, make_items, corpus, monkeypatch):
    docs, items = corpus
    want = sorted(brute(docs, items), key=str)
    assert rows(ranked_search.search(make_docs(docs), make_items(items))) == want
    # small blocks of documents and of items, long masks, early ends
    for name, value in (("BLOCK_DOCS", 32), ("BLOCK_TERMS", 60), ("MASK_WORDS", 40), ("EVALUATED", 4), ("SALTS", 3)):
        monkeypatch.setattr(ranked_search, name, value)
    assert rows(ranked_search.search(make_docs(docs), make_items(items))) == want


def test_groups_are_skipped(corpus, monkeypatch):
    """Most documents of a block with one fitting copy are never scored."""
    import numpy as np

    docs = [["a"] * 3 + ["b"] * (k % 2) for k in range(5000)] + [["a", "c"]] * 12
    flat = [(d, ord(w) - 97, c) for d, ws in enumerate(docs) for w, c in sorted(Counter(ws).items())]
    of, term, times = (np.array(x) for x in zip(*flat))
    block = ranked_search.Block(list(range(len(docs))), np.full(len(docs), 100), of, term, times, 3)
    scored = []
    merge = ranked_search.Block._merge
    monkeypatch.setattr(
        ranked_search.Block, "_merge", lambda self, q, d, b: scored.append(len(d)) or merge(self, q, d, b)
    )
    best = block.search(ranked_search.Query(0, np.array([0, 1, 2]), np.array([0, 700, 8000])), [])
    assert [x[2] for x in best] == list(range(5000, 5010)) and sum(scored) < 100


def test_odd_rows(clashing, odd_rows, no_docs, make_items):
    items = [(1, "one two"), (1, "one"), (None, "six words é 日本"), (3, None), (4, ""), (5, "..."), (6, prose(2, 60))]
    items.append((7, odd_rows[11][1]))
    got = rows(ranked_search.search(clashing, make_items(items)))
    assert got == sorted(brute([r[:2] for r in odd_rows], items), key=str)
    assert ranked_search.search(no_docs, make_items(items)).count() == 0
    assert ranked_search.search(clashing, make_items([]).where("false")).count() == 0
