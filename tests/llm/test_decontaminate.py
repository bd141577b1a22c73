import random

import numpy as np
import pytest
from brute import prose

from logloom.llm import decontaminate as dc
from logloom.llm.text import texts, word_hashes
import pyarrow as pa


def plain_tiles(doc, item, least):
    """Greedy string tiling, one longest match after the other."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (least - 1, 0, 0)
        for a in range(len(doc)):
            for b in range(len(item)):
                n = 0
                while (
                    a + n < len(doc) and b + n < len(item) and doc[a + n] == item[b + n]
                    and free_d[a + n] and free_i[b + n]
                ):
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return out
        for k in range(n):
            free_d[a + k] = free_i[b + k] = False
        out.append((a, b, n))


def hashed(text):
    return word_hashes(*texts(pa.array([text])))[0]


@pytest.mark.parametrize("seed", range(40))
def test_tiles(seed):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(r.choice([2, 4, 12, 200]))]
    item = r.choices(words, k=r.randint(3, 30))
    doc = r.choices(words, k=20) + item[10:] + r.choices(words, k=3) + item[:10] + r.choices(words, k=9)
    got = dc.tiles(hashed(" ".join(doc)), hashed(" ".join(item)), 3)
    want = plain_tiles(doc, item, 3)
    assert sorted(n for *_, n in got) == sorted(n for *_, n in want)
    for a, b, n in got:
        assert doc[a : a + n] == item[b : b + n]


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_reordered_and_broken_passages(spark, make_docs):
    item = prose(5, 40).split()
    near = prose(6, 300).split()
    swapped = near[:50] + item[20:] + near[50:90] + item[:20] + near[90:]
    broken = near[:10] + item[:15] + ["x"] + item[16:] + near[10:]
    little = near[:30] + item[:12] + near[30:]
    docs = make_docs([(1, " ".join(swapped).upper()), (2, " ".join(broken)), (3, " ".join(little)),
                      (4, " ".join(near)), (5, None)])
    bench = benchmark(spark, [(7, " ".join(item)), (8, None), (9, ""), (10, "two words"), (None, "x y")])
    got = {r.doc_id: r for r in dc.contaminated(docs, bench).collect()}
    assert [got[k].contaminated for k in range(1, 6)] == [True, True, False, False, False]
    assert (got[1].item_id, got[1].coverage, got[1].tiles) == (7, 1.0, 2)
    assert (got[2].covered, got[3].covered, got[4].item_id) == (39, 12, None)
    assert sorted(r.doc_id for r in dc.clean(docs, bench).collect()) == [3, 4, 5]


def test_benchmark_in_blocks(spark, make_docs, monkeypatch):
    items = [(k, prose(k, 30)) for k in range(20)]
    docs = make_docs([(k, f"{prose(90 + k, 20)} {prose(k, 30)}") for k in range(20)] + [(50, prose(50, 9))])
    whole = sorted(dc.contaminated(docs, benchmark(spark, items)).collect())
    monkeypatch.setattr(dc, "BENCHMARK_BYTES", 500)
    assert sorted(dc.contaminated(docs, benchmark(spark, items)).collect()) == whole
    assert sum(r.contaminated for r in whole) == 20


def test_odd_rows(spark, clashing, odd_rows, no_docs):
    bench = benchmark(spark, [(2, "one"), (1, "ONE"), (3, prose(1, 200))])
    got = dc.contaminated(clashing, bench).collect()
    assert len(got) == len(odd_rows)
    found = {r.doc_id: (r.contaminated, r.item_id) for r in got}
    assert found[4] == found[5] == (True, 1)  # the smaller of two equal items
    assert found[8] == (True, 3) and found[1] == (False, None)
    kept = dc.clean(clashing, bench)
    assert kept.columns == clashing.columns
    assert dc.contaminated(no_docs, bench).count() == 0
    assert dc.clean(clashing, bench.where("false")).count() == len(odd_rows)
    assert np.isfinite([r.coverage for r in got]).all()


def test_items_without_id(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"a b {text} c"), (2, "a b c")], "doc_id long, text string")
    bench = benchmark(spark, [(None, text)])
    found = {r.doc_id: (r.contaminated, r.item_id, r.covered) for r in dc.contaminated(docs, bench).collect()}
    assert found == {1: (True, None, 60), 2: (False, None, 0)}
    assert [r.doc_id for r in dc.clean(docs, bench).collect()] == [2]
