import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
from brute import prose

from logloom.llm import language_model as lm


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def base(rows):
    """(n_tokens, n_known, train_tokens, base_score) of each row, in order."""
    end = object()

    def tokens(t):
        return [*brute.words(brute.lower(t)), end]

    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = tokens(t)
        score = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        out.append((i, len(w), sum(c[x] > 0 for x in w), n, round(score, 4)))
    return out


def shown(r):
    return (r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4))


def test_base_and_odd_rows(clashing, odd_rows, no_docs, monkeypatch):
    monkeypatch.setattr(lm, "DICTIONARY", 1000)  # most words get their counts by the join
    rows = [r[:2] for r in odd_rows]
    got = lm.score(clashing).collect()
    assert sorted(map(shown, got), key=str) == sorted(base(rows), key=str)
    assert all(r.held_out == held(r.doc_id) and np.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm.score(no_docs).count() == 0


def test_no_training_rows(make_docs):
    docs = [i for i in range(200) if held(i)][:3]
    got = lm.score(make_docs([(i, "a b") for i in docs])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0)] * 3


def test_probabilities_add_up():
    words = np.arange(1, 4001, dtype=np.uint64) * np.uint64(2654435761)
    counts = np.arange(4000, 0, -1)
    v = lm.Vocabulary(words, counts, int(counts.sum()), 4000)
    r = np.random.default_rng(1)
    model = lm.Model(v, r.normal(0, 0.3, sum(lm.Model.SIZES)).astype(np.float32))
    f = r.integers(0, 2**63, (lm.FEATURES, 1)).astype(np.uint64)
    every = np.append(np.arange(4000), -1)
    log = model.log_probability(np.repeat(f, len(every), axis=1), v.find(np.append(words, 7)))
    assert (v.find(words) >= 0).all() and v.find(np.array([7], np.uint64))[0] == -1
    at = v.find(np.append(words, 7))
    rare = np.where(at >= 0, v.group[at] == lm.CLASSES, True)
    share = np.where(at >= 0, v.counts[at] + 1.0, 1.0) / (v.rare_n + v.rare_distinct + 1)
    total = np.where(rare, np.exp(log) * share, np.exp(log)).sum()
    assert abs(total - 1) < 1e-3 and len(every) == 4001


def test_sums_of_segments():
    r = np.random.default_rng(3)
    for sizes in ([1], [1, 7, 8, 9, 64, 65, 1000], r.integers(1, 40, 200)):
        lengths = np.array(sizes)
        values = r.normal(size=(50, 6))
        entry = r.integers(0, 50, lengths.sum())
        wanted = np.zeros((len(lengths), 6))
        np.add.at(wanted, np.repeat(np.arange(len(lengths)), lengths), values[entry])
        assert np.allclose(lm.segment_sums(values, entry, lengths), wanted)


def test_rows_are_averaged_over_the_tasks_that_met_them(make_docs, monkeypatch):
    """A context that one of 20 tasks holds is learned as if that task were alone."""
    monkeypatch.setattr(lm, "TASK_TOKENS", 1)
    spark = make_docs([]).sparkSession
    texts = ["red green " * 400] + [f"w{i} " * 3 for i in range(19)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = lm.word_counts(docs)
    n = counts.agg({"count": "sum"}).first()[0]
    vocabulary = lm.Vocabulary(*lm.common_words(counts, 100), n, counts.count())
    one, many = (lm.train(docs.where(f"doc_id < {m}").repartition(m, "doc_id"), vocabulary, 1) for m in (1, 20))
    moved = np.abs(one.word_rows).sum(axis=1) > 0.5
    assert moved.any()
    assert np.abs(many.word_rows[moved]).sum() > 0.8 * np.abs(one.word_rows[moved]).sum()


def test_learns_from_context(make_docs):
    """Texts of two kinds, each with its own words: the model must beat plain counts."""
    r = random.Random(4)
    kinds = [prose(k, 60).split() for k in (1, 2)]
    rows = [(i, " ".join(r.choices(kinds[i % 2], k=150))) for i in range(1500)]
    gains = []
    for parts in (1, 150):
        got = [x for x in lm.score(make_docs(rows).repartition(parts)).collect() if x.held_out]
        assert len(got) > 30
        gains.append(sum(x.score - x.base_score for x in got) / sum(x.n_tokens for x in got))
    assert gains[0] > 0.13  # of log10(2) at best
    assert gains[1] > 0.8 * gains[0]
