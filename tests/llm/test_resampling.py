import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import lower, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from logloom.llm import resampling
from logloom.llm.text import texts

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall(lower(text))
    return len(w), [" ".join(w[a : a + k]) for k in (1, 2, 3) for a in range(len(w) - k + 1)]


def brute(docs, target):
    """(doc_id, n_features, weight, score, drawn) of each document; docs are (id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    each = [(i, *features(t)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in each for f in fs)
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    ns, nt = sum(s.values()), sum(t.values())
    out = []
    for i, n, fs in each:
        weight = sum(
            math.floor(1000 * math.log((t[b] + 1) * (ns + 10000) / ((s[b] + 1) * (nt + 10000)))) for b in map(bucket, fs)
        )
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, n, len(fs), weight, score))
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    places = Counter((r[0], r[4], k + 1) for k, r in enumerate(fit[: 5 * len(fit) // 100]))
    return [(i, f, w, s) for i, _, f, w, s in out], places


@given(st.lists(st.text("aZ9é, \n日", max_size=300), max_size=6))
@settings(max_examples=60, deadline=None)
def test_composed_crcs(rows):
    crc, length, first = resampling.payloads(*texts(pa.array(rows, pa.string())))
    got = [[] for _ in rows]
    for text, run in resampling.runs_of_words(crc, length, first, resampling.Shifts()):
        for k, c in zip(text.tolist(), run.tolist()):
            got[k].append(c)
    assert got == [[zlib.crc32(f.encode()) for f in features(t)[1]] for t in rows]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 100, 5000])
def test_appended_bytes(size):
    a, b = b"some text", bytes(range(256)) * 20
    crc = resampling.Shifts().append(np.array([zlib.crc32(a)], np.uint32), np.array([size]))
    assert int(crc[0]) ^ zlib.crc32(b[:size]) == zlib.crc32(a + b[:size])


def check(docs_df, rows, target_df, target):
    got = resampling.resample(docs_df, target_df).collect()
    want, places = brute(rows, target)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=str) == sorted(want, key=str)
    assert Counter((r.doc_id, r.score, r["rank"]) for r in got if r["rank"] is not None) == places


def test_equals_brute_force(spark, make_docs):
    words = prose(3, 300).split()
    rows = [(k, " ".join(words[(k * j * j + j) % 300] for j in range(k % 60))) for k in range(500)]
    rows += [(1000 + k, rows[59][1]) for k in range(30)]
    target = [" ".join(words[k : k + 30]) for k in range(0, 90, 10)]
    check(make_docs(rows), rows, spark.createDataFrame([(t,) for t in target], "text string"), target)


def test_odd_rows(spark, clashing, odd_rows, no_docs):
    target = [None, "", "one two", prose(2, 60)]
    benchmark = spark.createDataFrame([(t,) for t in target], "text string")
    check(clashing, [r[:2] for r in odd_rows], benchmark, target)
    check(clashing, [r[:2] for r in odd_rows], benchmark.where("false"), [])
    assert resampling.resample(no_docs, benchmark).count() == 0
