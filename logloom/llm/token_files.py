"""Token ids in binary files: encoding, writing in key order, reading back.

A file is a sequence of frames. A frame holds whole documents: a header, a table of
(document id, number of ids), the offsets of its Simple-8b blocks, and their words, all
little-endian. Files are written by tasks through ``pyarrow.fs``, into a folder all
executors share. Each attempt of a task writes a file of its own and returns its name;
only the names of attempts that Spark commits get into the manifest, so lost executors
and speculative copies leave no wrong file in it.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm import simple8b
from logloom.llm.bpe import spread
from logloom.llm.text import blocks, column
from logloom.llm.text import texts as text_bytes
from logloom.runtime import pin, shared_folder

MAGIC = b"S8B1"
# magic, documents, ids, blocks, words
HEADER = "<4sIQII"
NO_ID = -(1 << 63)
# Bytes of text that make a frame; a longer text is a frame of its own.
FRAME_BYTES = 1 << 22
# Words a task remembers; the memory is emptied beyond it, which costs time only.
REMEMBERED = 400_000

# How the tokenizer file cuts white-space separated words.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
# White space to str.split, but not to the tokenizer.
SEPARATORS = np.frombuffer(b"\x1c\x1d\x1e\x1f", np.uint8)
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
# Letters beside ASCII that the tokenizer only lower-cases, each by itself, and the lower ones.
LETTERS, LOWER_LETTERS = "À-ÖØ-öø-ÿА-ЯЁа-яё", "ß-öø-ÿа-яё"
# How the tokenizer writes the bytes of a piece: printable ones as they are, the others in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Table:
    """Runs of ids, one after the other."""

    def __init__(self):
        self.ids = np.zeros(0, np.uint32)
        self.starts = self.sizes = np.zeros(0, np.int64)

    def add(self, runs: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        flat = np.fromiter(chain.from_iterable(runs), np.uint32, int(sizes.sum()))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ids = np.concatenate([self.ids, flat])


class WordEncoder:
    """Encodes texts with a ``tokenizers`` file that drops white space.

    Nothing such a tokenizer does reaches across white space, so each distinct word is
    encoded once in a task. New words are cut into pieces first, because many share
    them, and the distinct pieces go through the library. Where it cuts a piece
    further, which shows in the number of word ends, the word goes through it whole.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.library.encode_special_tokens = True  # their names in a text are plain text
        self.cut = regex.compile(PIECES).findall
        self.spaces = regex.compile(r"\S+").findall
        self.plain = re.compile(r"[!-~]+").fullmatch
        self.simple = re.compile(f"[!-~{LETTERS}]+").fullmatch
        self.lower = re.compile(f"[!-~{LOWER_LETTERS}]+").fullmatch
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = defaultdict(count().__next__)
        self.pieces: dict = defaultdict(count().__next__)
        self.piece_table = Table()
        self.ids = np.zeros(0, np.uint32)
        self.starts = self.sizes = np.zeros(0, np.int64)

    @cached_property
    def ends(self) -> np.ndarray:
        """Which ids end a word."""
        vocabulary = self.library.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        return ends

    def split(self, texts: pa.Array) -> pa.Array:
        """The words of each text; some may be empty."""
        data, _ = text_bytes(texts)
        if np.isin(data, SEPARATORS).any():
            return pa.array([self.spaces(t or "") for t in texts.to_pylist()], pa.list_(pa.string()))
        return pc.utf8_split_whitespace(texts)

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def piece_ids(self, pieces: list) -> list[list[int]]:
        """The ids of each new piece; a tuple stands for a word that goes in whole."""
        tokenize = self.library.model.tokenize
        found: list = [None] * len(pieces)
        others = []
        for k, p in enumerate(pieces):
            if isinstance(p, tuple):
                found[k] = self.whole(p[0])
            elif self.plain(p):
                found[k] = [t.id for t in tokenize(p)]  # lower-case ASCII stays as it is
            elif self.lower(p):
                written = p.encode().decode("latin-1").translate(BYTE_LETTERS)
                found[k] = [t.id for t in tokenize(written)]
            else:
                others.append(k)
        if others:
            ids = np.array(self.whole(" ".join(pieces[k] for k in others)), np.int64)
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(others):
                ids = ids.tolist()
                for k, a, b in zip(others, [0, *ends], ends):
                    found[k] = ids[a:b]
            else:
                for k in others:
                    found[k] = self.whole(pieces[k])
        return found

    def learn(self, words: list[str]) -> None:
        parts = [self.parts(w) for w in words]
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        known = len(self.pieces)
        flat = chain.from_iterable(parts)
        at = np.fromiter(map(self.pieces.__getitem__, flat), np.int64, int(counts.sum()))
        found = self.piece_ids(list(islice(self.pieces, known, None)))
        self.piece_table.add(found)
        sizes = self.piece_table.sizes[at]
        ids = spread(self.piece_table.ids, self.piece_table.starts[at], sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        edges = upto[np.concatenate([[0], np.cumsum(counts)])]
        self.starts = np.concatenate([self.starts, len(self.ids) + edges[:-1]])
        self.sizes = np.concatenate([self.sizes, np.diff(edges)])
        self.ids = np.concatenate([self.ids, ids])

    def parts(self, word: str) -> tuple | list:
        """The pieces of a word, or the word in a tuple if it must go in whole."""
        if not word:
            return ()
        w = word
        if w.isascii() or self.simple(w):
            w = w.lower()
        else:
            low = w.lower()
            if len(low) != len(w) or not unicodedata.is_normalized("NFC", w):
                return ((word,),)  # such a word may be cut elsewhere in the library
            if low != w:
                w = w.translate(LOWER)
        if w.isalpha():
            return (w,)
        if w[-1] in ".,|" and w[:-1].isalpha():
            return (w[:-1], w[-1])
        return self.cut(w)

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.place) > REMEMBERED:
            self.forget()
        known = len(self.place)
        split = self.split(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        counts = pc.list_value_length(split).fill_null(0).to_numpy(zero_copy_only=False)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = map(self.place.__getitem__, distinct)  # gives a new word the next number
        at = np.fromiter(number, np.int64, len(distinct))[words.indices.to_numpy()]
        if len(self.place) > known:
            self.learn(list(islice(self.place, known, None)))
        sizes = self.sizes[at]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        edges = upto[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return spread(self.ids, self.starts[at], sizes), np.diff(edges)


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each text followed by ``end_id``, and the new sizes."""
    out = np.full(len(ids) + len(sizes), end_id, np.uint32)
    last = np.cumsum(sizes + 1) - 1
    keep = np.ones(len(out), bool)
    keep[last] = False
    out[keep] = ids
    return out, sizes + 1


def frame(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = simple8b.encode(ids)
    header = struct.pack(HEADER, MAGIC, len(doc_ids), len(ids), len(offsets) - 1, len(words))
    parts = (doc_ids.astype("<i8"), sizes.astype("<u4"), offsets.astype("<u4"), words.astype("<u8"))
    return header + b"".join(p.tobytes() for p in parts)


def read_frames(stream) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, sizes, ids) of each frame of an open file."""
    while head := stream.read(struct.calcsize(HEADER)):
        magic, docs, n, n_blocks, n_words = struct.unpack(HEADER, head)
        if magic != MAGIC:
            raise ValueError("not a token file")
        doc_ids = np.frombuffer(stream.read(8 * docs), "<i8")
        sizes = np.frombuffer(stream.read(4 * docs), "<u4").astype(np.int64)
        stream.read(4 * (n_blocks + 1))  # only needed to read single blocks
        ids = simple8b.decode(np.frombuffer(stream.read(8 * n_words), "<u8"))
        if len(ids) != n or int(sizes.sum()) != n:
            raise ValueError("damaged frame")
        yield doc_ids, sizes, ids


def write(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id") -> DataFrame:
    """Writes the ids of all texts in ascending key order; returns the manifest.

    The manifest has a row for each file: ``part`` (its place), ``file``, ``docs``,
    ``ids`` and ``start`` (ids before it). Null keys come first and are kept as the
    smallest number; rows with equal keys stay apart. A null or empty text has only
    its end id. An empty table has no files.
    """
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/tokens/{uuid.uuid4().hex}"

    def run(batches):
        encoder = WordEncoder(tokenizer)
        task = TaskContext.get()
        part = task.partitionId()
        name = f"part-{part:06d}-{task.taskAttemptId()}.s8b"
        stream, total_docs, total_ids = None, 0, 0
        for batch in blocks(batches, size=FRAME_BYTES):
            if batch.num_rows == 0:
                continue
            if stream is None:
                fs, path = pafs.FileSystem.from_uri(folder)
                fs.create_dir(path, recursive=True)
                stream = fs.open_output_stream(f"{path}/{name}")
            ids, sizes = with_end(*encoder.encode(column(batch, "text")), end_id)
            keys = column(batch, "key").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            stream.write(frame(keys, sizes, ids))
            total_docs += len(sizes)
            total_ids += len(ids)
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": f"{folder}/{name}", "docs": total_docs, "ids": total_ids}]
            )

    keyed = docs.select(
        F.col(key).cast("long").alias("key"),
        "text",
        F.xxhash64("text").alias("tie"),  # a key of many rows is dealt out by text
    )
    order = [F.asc_nulls_first("key"), F.asc("tie")]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    files = pin(ordered.mapInArrow(run, "part long, file string, docs long, ids long"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))


def read(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids or ids_crc32) of every document, from the files."""
    last, kind = ("ids_crc32", "long") if digest else ("ids", "binary")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["file"])
                at = row["start"]
                with fs.open_input_stream(path) as stream:
                    for doc_ids, sizes, ids in read_frames(stream):
                        ids = ids.astype("<u4")
                        edges = np.concatenate([[0], np.cumsum(sizes)])
                        each = [ids[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])]
                        if digest:
                            each = [zlib.crc32(x) for x in each]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(doc_ids, mask=doc_ids == NO_ID),
                                pa.array(at + edges[:-1]),
                                pa.array(sizes),
                                pa.array(each, pa.int64() if digest else pa.binary()),
                            ],
                            ["doc_id", "start", "n_tokens", last],
                        )
                        at += int(edges[-1])

    files = max(1, manifest.count())
    rows = manifest.select("file", "start").repartition(files)
    return rows.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last} {kind}")
