"""Plain versions of the contracts, one document at a time, to hold the operators against."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def prose(seed: int, n: int) -> str:
    """Invented words, hardly two alike."""
    r = random.Random(seed)
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    return " ".join("".join(r.choices(syllables, k=r.randint(2, 5))) for _ in range(n))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def op2(docs):
    """doc_id -> (n_chars, edited_sha256); docs: (doc_id, text) with distinct ids."""
    rows = sorted(docs, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        t, u = t or "", u or ""
        half = len(t) // 2
        out[i] = (len(t), sha((t[: len(t) - half] + u[:half]).encode()))
    return out


def op4(docs, encoding):
    out = {}
    for i, t in docs:
        ids = encoding.encode_ordinary(t or "")
        packed = b"".join(struct.pack("<I", x) for x in ids)
        out[i] = (len(ids), sha(packed), sha((t or "").encode()))
    return out


def op5(docs, tokenizer):
    out, start = {}, 0
    for i, t in sorted(docs):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        packed = b"".join(struct.pack("<I", x) for x in ids)
        out[i] = (start, len(ids), zlib.crc32(packed))
        start += len(ids)
    return out


def shingles(text, n=5):
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def op6(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = {}
    for i, s in sets.items():
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = {(a, b) for m in by_shingle.values() if len(m) > 1 for a in m for b in m if a < b}
    for a, b in pairs:
        same = len(sets[a] & sets[b])
        if 100 * same >= 80 * (len(sets[a]) + len(sets[b]) - same):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}
