"""Byte-level BPE and token files against the libraries themselves."""

import hashlib
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logloom.llm import bpe, simple8b, token_files

RANK_FILE = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
RANKS = bpe.read_ranks(RANK_FILE)
PATTERN = public_tokenizers.PATTERN
TIKTOKEN = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
WORDS = open(public_tokenizers.path("word_bpe_49k.json")).read()
ENCODER = bpe.Encoder(RANKS, PATTERN)
LIBRARY = Tokenizer.from_str(WORDS)
LIBRARY.encode_special_tokens = True
PARTS = ["a", "B", "é", "é", "İ", "Σ", "ß", "'s", "don't", "1", "²", "日本", " ", "  ", "\n", "\t",
         "\x1c", "\x85", " ", "<|endoftext|>", "!!", "ﬁ", "가", "\U0001f600", "\x00"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT | st.text(st.characters(exclude_categories=["Cs"])), max_size=5))
def test_bpe_as_tiktoken(texts):
    ids, first = ENCODER.encode(texts)
    back = bpe.decoder(RANKS)
    for t, a, b in zip(texts, first, first[1:]):
        assert ids[a:b].tolist() == TIKTOKEN.encode_ordinary(t)
        assert back(ids[a:b]) == t.encode()


def test_bpe_with_any_ranks():
    r = random.Random(5)
    for _ in range(60):
        tokens = {"".join(r.choice("ab") for _ in range(r.randint(2, 5))) for _ in range(12)}
        order = sorted(tokens)
        r.shuffle(order)
        ranks = {bytes([i]): i for i in range(256)} | {t.encode(): 256 + i for i, t in enumerate(order)}
        plain = tiktoken.Encoding("r", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        words = ["".join(r.choice("ab") for _ in range(r.randint(1, 14))) for _ in range(30)]
        ids, first = bpe.replay([w.encode() for w in words], bpe.Merges(ranks))
        for w, a, b in zip(words, first, first[1:]):
            assert ids[a:b].tolist() == plain.encode_ordinary(w)


def test_bpe_rows(odd_rows, clashing, no_docs):
    got = bpe.digests(clashing, RANK_FILE, PATTERN).collect()
    want = []
    for i, t, *_ in odd_rows:
        want.append((i, *brute.op4([(i, t)], TIKTOKEN)[i]))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digests(no_docs, RANK_FILE, PATTERN).count() == 0


def test_bpe_encode_and_decode(odd_docs):
    encoded = bpe.encode(odd_docs.where("doc_id in (4, 10)"), RANK_FILE, PATTERN)
    back = {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(encoded, RANK_FILE).collect()}
    assert back == {4: "one", 10: "é ñ   日本 \U0001f600 ABC abc"}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70), max_size=3000))
def test_simple8b(ids):
    ids = np.array(ids, np.uint64)
    words, offsets = simple8b.encode(ids)
    assert (simple8b.decode(words) == ids).all()
    parts = [simple8b.decode_block(words, offsets, k) for k in range(len(offsets) - 1)]
    assert not parts or (np.concatenate(parts) == ids).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_words_as_library(texts):
    ids, sizes = token_files.WordEncoder(WORDS).encode(texts)
    edges = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
    for t, a, b in zip(texts, edges, edges[1:]):
        assert ids[a:b].tolist() == LIBRARY.encode(t, add_special_tokens=False).ids


LETTERS = st.text(st.sampled_from("aZéÉßẞøÞþÿ×÷йЙёЁяЯѐàŸµªK'1.,-"), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, max_size=12).map(" ".join))
def test_letters_as_library(text):
    ids, _ = token_files.WordEncoder(WORDS).encode([text])
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_common_letters_need_no_whole_pass(monkeypatch):
    """Pieces of accented and Cyrillic letters go straight to the merges, as ASCII ones do."""
    text = "Élan vital, naïve Straßen. ПЁС ещё"
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    encoder = token_files.WordEncoder(WORDS)
    monkeypatch.setattr(encoder, "whole", None)
    assert encoder.encode([text])[0].tolist() == want


def test_token_files(odd_rows, clashing, no_docs):
    manifest = token_files.write(clashing, WORDS, end_id=1)
    got = token_files.read(manifest, digest=True).collect()
    assert len(got) == len(odd_rows)
    got.sort(key=lambda r: r.start)
    start = 0
    for r in got:  # gapless, in ascending order, null first
        assert r.start == start
        start += r.n_tokens
    keys = [r.doc_id for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    want = []
    for i, t, *_ in odd_rows:
        _, n, crc = brute.op5([(i, t)], LIBRARY)[i]
        want.append((i, n, crc))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert token_files.read(token_files.write(no_docs, WORDS, 1)).count() == 0


def test_token_files_give_ids(make_docs):
    manifest = token_files.write(make_docs([(2, "the cat"), (1, None)]), WORDS, end_id=1)
    rows = token_files.read(manifest).orderBy("start").collect()
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in rows]
    assert ids == [[1], [*LIBRARY.encode("the cat", add_special_tokens=False).ids, 1]]


def test_damaged_file(tmp_path):
    import io

    data = token_files.frame(np.array([1]), np.array([2]), np.array([3, 4], np.uint32))
    assert [x[2].tolist() for x in token_files.read_frames(io.BytesIO(data))] == [[3, 4]]
    with pytest.raises(ValueError):
        list(token_files.read_frames(io.BytesIO(b"XXXX" + data[4:])))


def test_digests_are_plain():
    assert brute.sha(b"") == hashlib.sha256(b"").hexdigest()
    assert zlib.crc32(b"\x01\x00\x00\x00") == brute.op5([(1, "")], LIBRARY)[1][2]
