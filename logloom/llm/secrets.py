"""Secret scans: what a candidate adds to a compressed neighbourhood.

Candidates are long runs of key characters with a sensitive word close before them, on
the same or the next line, and the lines that follow a candidate directly. A
zstandard compressor is primed with the text around the candidate and with the
identifiers that are common around candidates in the whole corpus; the candidate's
novelty is the number of bytes it adds to the compressed neighbourhood, for each of its
own bytes. Ordinary names and paths are mostly copies of what the compressor has seen,
random keys are not. The plain patterns of known secrets are always reported.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import blocks, column
from logloom.runtime import pin

# The patterns of the contract, and what their matches must have.
ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?"
    r"([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")

# A candidate: a run of key characters.
LEAST = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]*")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
SENSITIVE = re.compile(
    r"(?i)pass(?:word|wd|phrase)|secret|token|api[_-]?key|credential|auth|private[ _-]?key|bearer|access[_-]?key"
)
# Characters after a sensitive word, line breaks included, in which a candidate may begin;
# after a candidate another one may follow on the next line.
REACH, NEXT_LINE = 48, 2
# Letters alone are a candidate if they change case as often as this; words don't.
CASE_CHANGES = 4
# Characters of text around a candidate that prime the compressor.
AROUND = 400
# Bytes of common identifiers that prime it too, and added bytes for each own byte.
DICTIONARY_BYTES = 16 << 10
NOVELTY = 0.75
# Values of this length are coded by the frequencies of their letters.
ENTROPY_CODED, ENTROPY = 64, 0.9


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns, leftmost without overlap in each kind."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 8:
            found.append(("assign", m.start(), m.end()))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 16:
                found.append(("access", m.start(), m.end()))
    for m in LONG_HEX.finditer(text):
        found.append(("hex", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# Same matches as of HEX with 32 characters or more, found faster.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def candidates(text: str, known: list[tuple[str, int, int]]) -> list[tuple[int, int, str, str]]:
    """(start, end, candidate, surrounding text) of what the patterns left open.

    Candidates do not overlap. Each is looked for once, in the reach of the sensitive
    words before it, so the time is linear in the text.
    """
    starts, ends, most = [], [], 0
    for _, a, b in sorted(known, key=lambda s: s[1]):
        most = max(most, b)
        starts.append(a)
        ends.append(most)
    found = []
    done = 0
    for word in SENSITIVE.finditer(text):
        at, stop = max(word.end(), done), word.end() + REACH
        while at < stop:
            m = CANDIDATE.search(text, at, stop + LEAST - 1)
            if not m:
                break
            a = m.start()
            b = at = done = RUN.match(text, a).end()
            stop = max(stop, b + NEXT_LINE)
            before = bisect_left(starts, b)
            if keyish(text[a:b]) and not (before and ends[before - 1] > a):
                found.append((a, b))
    # no candidate is ordinary because another one, or its copy, is close to it
    pieces, last = [], 0
    for a, b in found:
        pieces += [text[last:a], " " * (b - a)]
        last = b
    blank = "".join([*pieces, text[last:]]) if found else text
    return [(a, b, text[a:b], blank[max(0, a - AROUND) : a] + blank[b : b + AROUND]) for a, b in found]


def keyish(value: str) -> bool:
    """Digits, alone or among letters, or letters that change case too often for words."""
    if re.search("[0-9]", value):
        return True
    return len(re.findall("[a-z][A-Z]|[A-Z][a-z]", value)) >= CASE_CHANGES


def novelty(value: str, around: str, dictionary: bytes) -> float:
    """Bytes ``value`` adds to its compressed neighbourhood, for each of its bytes."""
    primer = dictionary + around.encode()
    data = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False)
    own = value.encode()
    tail = around[-32:].encode()
    return (len(press.compress(tail + own)) - len(press.compress(tail))) / max(1, len(own))


def threshold(value: str, least: float) -> float:
    """Added bytes for each own byte from which ``value`` is novel.

    The compressor codes the letters of a long value by their frequencies, so no value of
    few different letters can reach ``least``. Of those ENTROPY of what random letters of
    the value's alphabet take is asked for.
    """
    if len(value) < ENTROPY_CODED:
        return least
    alphabet = sum(n for kind, n in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[^A-Za-z0-9]", 4)) if re.search(kind, value))
    return min(least, ENTROPY * math.log2(alphabet) / 8)


SCANNED = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base string, "
    "open array<struct<start:int,end:int,value:string,around:string>>"
)


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, spans of the plain patterns, and open candidates of every row."""
    kind = pa.list_(
        pa.struct(
            [("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("around", pa.string())]
        )
    )

    def run(batches):
        for batch in blocks(batches):
            spans, left = [], []
            for text in column(batch, "text").to_pylist():
                base = base_spans(text) if text else []
                spans.append(base)
                left.append([
                    {"start": a, "end": b, "value": v, "around": r}
                    for a, b, v, r in (candidates(text, base) if text else [])
                ])
            counts = [[sum(k == name for k, _, _ in s) for s in spans] for name in KINDS[:3]]
            lines = [joined(s) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_key")]
                + [pa.array(c, pa.int64()) for c in counts]
                + [
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lines]),
                    pa.array(lines),
                    pa.array(left, kind),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "open"],
            )

    keyed = docs.select(F.col(key).cast("long").alias("doc_key"), "text")
    return keyed.mapInArrow(run, SCANNED)


def identifier_dictionary(scanned: DataFrame) -> bytes:
    """The most common identifiers around all candidates, up to DICTIONARY_BYTES.

    The commonest come last, where a compressor reaches them most cheaply; ties go by
    name. Candidates themselves are not in the text around them.
    """
    around = scanned.select(F.explode("open").alias("o")).select("o.around")
    names = around.select(
        F.explode(F.array_distinct(F.regexp_extract_all("around", F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,31}"), 0))).alias("name")
    )
    counted = names.groupBy("name").count().where("count > 1")
    top = counted.orderBy(F.desc("count"), "name").limit(DICTIONARY_BYTES // 4)
    kept, size = [], 0
    for row in top.collect():  # bounded by the size of the dictionary
        size += len(row["name"]) + 1
        if size > DICTIONARY_BYTES:
            break
        kept.append(row["name"])
    return " ".join(reversed(kept)).encode()


def find_secrets(docs: DataFrame, key: str = "doc_id", least: float = NOVELTY) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel) of every row.

    ``spans`` holds the base spans and the novel ones, as kind:start:end by start, then
    kind, in code points with the end exclusive. Null and empty texts have none. Rows
    with equal or null keys stay apart; other columns are not looked at.
    """
    scanned = pin(scan(docs, key))
    dictionary = identifier_dictionary(scanned)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]

    def run(batches):
        for batch in batches:
            rows, counts = [], []
            for base, left in zip(column(batch, "base").to_pylist(), column(batch, "open").to_pylist()):
                new = [
                    ("novel", c["start"], c["end"])
                    for c in left
                    if novelty(c["value"], c["around"], dictionary) >= threshold(c["value"], least)
                ]
                spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
                spans = sorted(spans + new, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                rows.append(joined(spans))
                counts.append(len(new))
            yield pa.RecordBatch.from_arrays(
                [column(batch, c) for c in names] + [pa.array(rows), pa.array(counts, pa.int64())],
                [*names, "spans", "n_novel"],
            )

    return scanned.mapInArrow(
        run,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "spans string, n_novel long",
    )
