import random

import brute
import numpy as np
from brute import prose

from logloom.llm import fingerprints as fp


def jaccard(a: bytes, b: bytes) -> float:
    def grams(x):
        return {x[i : i + fp.SHINGLE_BYTES] for i in range(max(1, len(x) - fp.SHINGLE_BYTES + 1))}

    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_short_texts_are_exact_and_long_ones_close():
    r = random.Random(1)
    for n, off in ((3, 0), (5, 0), (300, 0.2), (3000, 0.12)):
        a = [str(r.random())[2:8] for _ in range(n)]
        b = a[: n // 2] + [str(r.random())[2:8] for _ in range(n - n // 2)]
        a, b = " ".join(a).encode(), " ".join(b).encode()
        got = fp.likeness(*fp.sketches([a, b]))
        assert abs(got - jaccard(a, b)) <= off + 1e-9


def test_merge_is_the_sketch_of_the_union():
    a, b = prose(1, 2000).encode(), prose(2, 40).encode()
    x, y = fp.sketches([a, b])
    both = fp.merge(x, y)
    assert set(both) <= set(x) | set(y)
    assert (np.diff(both.astype(object)) > 0).all()
    assert fp.containment(y, both) == 1.0
    assert fp.likeness(both, fp.merge(both, y)) == 1.0


def test_very_unequal_documents():
    long = prose(3, 20_000).encode()
    part = long[5000:12_000]
    x, y = fp.sketches([long, part])
    assert fp.containment(y, x) > 0.95
    assert fp.likeness(x, y) < 0.15


def test_short_texts_against_long_ones():
    """Unrelated texts of 50 and 100 shingles are in no long one, cuts of it are."""
    long, *_ = fp.sketches([prose(4, 20_000).encode()])
    r = random.Random(2)
    cuts = prose(4, 20_000).encode()
    for shingles, unknown in ((50, 0.1), (100, 0.01)):
        n = shingles + fp.SHINGLE_BYTES - 1
        strange = fp.sketches([bytes(r.choices(range(33, 127), k=n)) for _ in range(400)])
        got = [fp.containment(s, long) for s in strange]
        assert not any(got) and sum(x is None for x in got) <= unknown * len(got)
        parts = fp.sketches([cuts[a : a + n] for a in range(0, 80_000, 200)])
        got = [fp.containment(s, long) for s in parts]
        assert {x for x in got if x is not None} == {1.0}
        assert sum(x is None for x in got) <= unknown * len(got)
    assert fp.containment(np.zeros(0, np.uint64), long) == 1.0


def test_blocks_do_not_matter():
    texts = [prose(k, 30 * k).encode() for k in range(1, 8)] + [b"", b"x", b"y" * 100]
    together = fp.sketches(texts)
    for t, s in zip(texts, together):
        assert (fp.sketches([t])[0] == s).all()


def test_edited(make_docs, spark):
    rows = [(i, prose(i // 2, 5 * i) if i % 5 else None) for i in range(60)]
    got = {r.doc_id: r for r in fp.compare_edited(make_docs(rows)).collect()}
    want = brute.op2(rows)
    assert {i: (r.n_chars, r.edited_sha256) for i, r in got.items()} == want
    texts = {}
    for i, t in rows:
        assert texts.setdefault(t or "", got[i].fingerprint) == got[i].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got.values())


def test_odd_rows(clashing, odd_rows, no_docs, make_docs):
    got = fp.compare_edited(clashing).collect()
    assert sorted((r.doc_id, r.n_chars) for r in got if r.doc_id is not None) == sorted(
        (i, len(t or "")) for i, t, *_ in odd_rows if i is not None
    )
    assert len(got) == len(odd_rows)
    assert fp.compare_edited(no_docs).count() == 0
    (alone,) = fp.compare_edited(make_docs([(1, "abcd")])).collect()
    assert alone.edited_sha256 == brute.sha(b"abab") and alone.near_next == 1.0
    marks = fp.fingerprint(clashing).collect()
    assert len(marks) == len(odd_rows)


def test_many_partitions(make_docs, spark):
    """More ranges than a chain of conditions could hold."""
    rows = [(i, prose(i, 4)) for i in range(3000)] + [(7, "again"), (None, "no id"), (5, prose(5, 4))]
    docs = make_docs(rows)
    want = sorted((r.doc_id or -1, r.edited_sha256, r.near_next) for r in fp.compare_edited(docs).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2000")
    try:
        got = sorted((r.doc_id or -1, r.edited_sha256, r.near_next) for r in fp.compare_edited(docs).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want
