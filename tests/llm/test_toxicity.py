import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import prose

from logloom.llm import toxicity

WORDS = "[0-9a-z\x80-\U0010ffff]+"


def fold(i):
    return zlib.crc32(str(i).encode()) % 5


@pytest.fixture(scope="module")
def corpus():
    """2,000 documents; one in five has two of ten rude words, whatever its topic."""
    r = random.Random(7)
    rude = [w + "x" for w in prose(9, 10).split()]
    topics = [prose(k, 400).split() for k in range(4)]
    docs, labels = [], []
    for i in range(2000):
        words = r.choices(topics[i % 4], k=r.randint(20, 120)) + r.choices(topics[(i + 1) % 4], k=3)
        toxic = int(r.random() < 0.2)
        for _ in range(2 * toxic):
            words.insert(r.randrange(len(words)), r.choice(rude))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def make_labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(make_docs, make_labels, corpus):
    docs, labels = corpus
    got = {r.doc_id: r for r in toxicity.score(make_docs(docs), make_labels(labels)).collect()}
    held = [(i, t) for i, _, t in labels if fold(i) == 0]
    assert len(got) == 2000 and all(got[i].held_out == (fold(i) == 0) for i, _ in docs)
    assert np.mean([got[i].predicted == t for i, t in held]) > 0.97
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_held_out_labels_have_no_effect(make_docs, make_labels, corpus):
    docs, labels = corpus
    turned = [(i, q, 1 - t if fold(i) == 0 else t) for i, q, t in labels]
    each = []
    for known in (labels, turned):
        rows = toxicity.score(make_docs(docs[:600]), make_labels(known)).collect()
        each.append({r.doc_id: round(r.score, 9) for r in rows})
    assert each[0] == each[1]


def test_counts_and_probabilities(make_docs, make_labels, corpus):
    """Contexts as counted one by one; both distributions sum to one."""
    docs, labels = corpus[0][:300], corpus[1][:300]
    known = toxicity.labelled(make_docs(docs), make_labels(labels)).where("fold <> 1")
    counts = {r.word: (r.ordinary, r.toxic, r.either) for r in toxicity.context_counts(known).collect()}
    seen = defaultdict(lambda: (set(), set()))
    for (i, text), (_, _, t) in zip(docs, labels):
        if fold(i) not in (0, 1):
            words = text.split()
            for u, w in zip([None, *words], words):
                seen[w][t].add(u)
    want = sorted((len(a), len(b), len(a | b)) for a, b in seen.values())
    assert sorted(counts.values()) == want
    model = toxicity.fit(known)
    for k in (0, 1):
        p = np.exp(model.shared.astype(float) + model.ratios[k, :-1]).sum() + math.exp(model.unknown + model.ratios[k, -1])
        assert abs(p - 1) < 1e-4


def test_rare_words_are_neutral(make_docs, make_labels, corpus):
    docs, labels = corpus
    known = toxicity.labelled(make_docs(docs), make_labels(labels)).where("fold <> 1")
    model = toxicity.fit(known)
    _, ratios = model.look_up(np.array([12345], np.uint64))
    assert abs(ratios[1, 0] - ratios[0, 0]) < 0.2


def test_odd_rows(clashing, odd_rows, no_docs, make_labels, corpus, make_docs):
    labels = make_labels([(i, 1, i % 2) for i in range(12)] + [(None, 1, 1), (3, 0, None), (4, 0, 7), (5, 1, 1)])
    got = toxicity.score(clashing, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows)
    assert all(0 <= r.score <= 1 and math.isfinite(r.toxic_log10) for r in got)
    assert toxicity.score(no_docs, labels).count() == 0
    none = toxicity.score(clashing, labels.where("false")).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}


def test_bounds_leave_results_alike(make_docs, make_labels, corpus, monkeypatch):
    docs, labels = corpus
    monkeypatch.setattr(toxicity, "WORDS", 1200)
    monkeypatch.setattr(toxicity, "CALIBRATION_ROWS", 200)
    monkeypatch.setattr(toxicity, "LABELLED_ROWS", 1600)
    known = toxicity.labelled(make_docs(docs), make_labels(labels))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    assert 600 < sizes[0] < 1000 and sizes[1] == sum(t for i, _, t in labels if fold(i))
    got = {r.doc_id: r.predicted for r in toxicity.score(make_docs(docs), make_labels(labels)).collect()}
    held = [(i, t) for i, _, t in labels if fold(i) == 0]
    assert np.mean([got[i] == t for i, t in held]) > 0.95


def test_words_after_others(make_docs, make_labels, corpus, monkeypatch):
    """Both labels' probabilities after a word, counted one by one; they sum to one."""
    monkeypatch.setattr(toxicity, "PAIR_COUNT", 1)
    docs, labels = corpus[0][:150], corpus[1][:150]
    known = toxicity.labelled(make_docs(docs), make_labels(labels)).where("fold <> 1")
    model = toxicity.fit(known)
    pairs = [Counter(), Counter()]
    for (i, text), (_, _, t) in zip(docs, labels):
        if fold(i) not in (0, 1):
            pairs[t].update(zip([None, *text.split()], text.split()))
    vocabulary = sorted({w for c in pairs for _, w in c})
    joined = "".join(vocabulary).encode()
    ends = np.cumsum([len(w.encode()) for w in vocabulary])
    h = toxicity.hashes(np.frombuffer(joined, np.uint8), np.append(0, ends[:-1]), ends)
    shared, ratios = model.look_up(h)
    number = {w: k for k, w in enumerate(vocabulary)}
    for v in (None, *vocabulary[::40]):
        before = np.full(len(h), toxicity.START if v is None else h[number[v]], np.uint64)
        p = np.exp(model.after(before, h, shared + ratios))
        for t in (0, 1):
            sizes = list(pairs[t].values())
            discount = sizes.count(1) / (sizes.count(1) + 2 * sizes.count(2))
            own = {w: n for (u, w), n in pairs[t].items() if u == v}
            total = sum(own.values())
            left = discount * len(own) / total if total else 1.0
            for w in vocabulary:
                lower = math.exp(shared[number[w]] + ratios[t, number[w]])
                want = (own[w] - discount) / total if w in own else 0.0
                assert p[t, number[w]] == pytest.approx(want + left * lower, rel=1e-3, abs=1e-9)
            rest = left * math.exp(model.unknown + model.ratios[t, -1])
            assert abs(p[t].sum() + rest - 1) < 1e-3
