"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

A word's probability given the words before it is that of its class times that of the
word within the class. Both are softmaxes over sums of weights; the weights are rows of
two hashed tables, picked by features of the context: the word before, the two words
before, the word before last alone (skipping one), and the one before that. Words
outside the model's vocabulary form one more class, within which counts decide.

Training goes once through all training documents, in rounds. In a round every task
takes gradient steps on its own documents, in sparse batches, and the steps of each row
are averaged by the row's own tokens. Counts of words are aggregated over the whole
corpus; words beyond the dictionary that travels with the tasks get theirs by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.cells import CELLS, chunk_batches, total
from logloom.llm.text import blocks, column, mix, signed, texts, word_hashes
from logloom.runtime import pin

CLASSES, CLASS_WORDS = 32, 64
FEATURES = 4
CLASS_ROWS, WORD_ROWS = 1 << 13, 1 << 14
ROUNDS = 4
# Tokens of a task in a round, at least: fewer teach a task little before steps are averaged.
TASK_TOKENS = 1 << 18
BATCH = 4096
STEP = 1.5
# Most frequent words whose counts travel with the tasks: six megabytes at any input.
DICTIONARY = 1 << 19
# Distinct words a task counts before it passes them on.
COUNTED = 1 << 20

END = np.uint64(0x5A0E6D3C1B2F4987)
NO_WORD = np.uint64(0x1F83D9ABFB41BD6B)
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
LOG10 = np.log(10.0)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, each followed by END; first token of each text)."""
    h, first = word_hashes(*texts(column(batch, "text")))
    n = len(first) - 1
    out = np.full(len(h) + n, END)
    keep = np.ones(len(out), bool)
    keep[first[1:] + np.arange(n)] = False
    out[keep] = h
    return out, first + np.arange(n + 1)


def held_out(key) -> F.Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(7)) == 2


def word_counts(training: DataFrame) -> DataFrame:
    """(word, count) over all training documents."""

    def run(batches):
        words, counts, size = [], [], 0

        def flush():
            w, at = np.unique(np.concatenate(words), return_inverse=True)
            c = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
            return w, c

        def out(w, c):
            return pa.RecordBatch.from_arrays([pa.array(signed(w)), pa.array(c)], ["word", "count"])

        for batch in blocks(batches):
            w, c = np.unique(tokens(batch)[0], return_counts=True)
            words.append(w)
            counts.append(c)
            size += len(w)
            if size > COUNTED:
                w, c = flush()
                words, counts, size = [w], [c], len(w)
                if size > COUNTED // 2:
                    yield out(w, c)
                    words, counts, size = [], [], 0
        if words:
            yield out(*flush())

    each = training.select("text").mapInArrow(run, "word long, count long")
    return each.groupBy("word").agg(F.sum("count").alias("count"))


def common_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the words above the count that leaves at most ``most``."""
    sizes = counts.groupBy("count").agg(F.count("*").alias("n"))
    head = sizes.orderBy(F.desc("count")).limit(most).collect()
    taken, least = 0, None
    for row in head:
        taken += row["n"]
        if taken > most:
            break
        least = row["count"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = counts.where(F.col("count") >= least).toArrow()  # at most ``most`` rows
    return (
        rows["word"].to_numpy().view(np.uint64),
        rows["count"].to_numpy().astype(np.int64),
    )


class Vocabulary:
    """The dictionary's counts, and the class and place of the words of the model."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, n: int, distinct: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.n, self.distinct = n, distinct
        self.group = np.full(len(words), CLASSES, np.int64)
        self.place = np.zeros(len(words), np.int64)
        # by count, ties by hash; a class holds neighbours in that order
        top = np.lexsort((self.words, -self.counts))[: CLASSES * CLASS_WORDS]
        self.group[top] = np.arange(len(top)) // CLASS_WORDS
        self.place[top] = np.arange(len(top)) % CLASS_WORDS
        inside = self.counts[top].sum()
        self.rare_n = n - int(inside)
        self.rare_distinct = distinct - len(top)
        mass = np.bincount(self.group[top], weights=self.counts[top], minlength=CLASSES + 1)
        mass[CLASSES] = self.rare_n + self.rare_distinct + 1
        used = mass[:CLASSES] > 0
        self.class_bias = np.where(np.append(used, True), np.log(np.maximum(mass, 1)), -1e4)
        self.word_bias = np.full((CLASSES, CLASS_WORDS), -1e4)
        self.word_bias[self.group[top], self.place[top]] = np.log(self.counts[top])
        self.class_bias = (self.class_bias - np.log(mass.sum())).astype(np.float32)
        self.word_bias = self.word_bias.astype(np.float32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each word in the dictionary, -1 for none."""
        if not len(self.words):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)


def contexts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Feature hashes of each token's context, one row for each feature."""
    n = len(h)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    before = []
    for k in (1, 2, 3):
        w = np.full(n, NO_WORD)
        w[k:] = h[:-k] if k < n else w[k:]
        w[place < k] = NO_WORD
        before.append(w)
    one, two, three = before
    kinds = (one, one * _SALTS[1] + two, two, three)
    return np.stack([mix(x ^ s) for x, s in zip(kinds, _SALTS)])


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
    return x


class Model:
    """Weights of the class table and of the word table, as one flat array."""

    SIZES = CLASS_ROWS * (CLASSES + 1), WORD_ROWS * CLASS_WORDS

    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray | None = None):
        self.v = vocabulary
        a, b = self.SIZES
        flat = np.zeros(a + b, np.float32) if flat is None else flat.astype(np.float32)
        self.flat = flat
        self.classes = flat[:a].reshape(CLASS_ROWS, CLASSES + 1)
        self.word_rows = flat[a:].reshape(WORD_ROWS, CLASS_WORDS)
        self.class_seen = np.zeros(CLASS_ROWS, np.float32)
        self.word_seen = np.zeros(WORD_ROWS, np.float32)

    def class_log(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = (f % np.uint64(CLASS_ROWS)).astype(np.int64)
        x = np.take(self.classes, rows[0], axis=0, mode="clip")
        for r in rows[1:]:
            x += np.take(self.classes, r, axis=0, mode="clip")
        return _log_softmax(x + self.v.class_bias), rows

    def word_log(self, f: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        salted = mix(f + (group.astype(np.uint64) << np.uint64(40)))
        rows = (salted % np.uint64(WORD_ROWS)).astype(np.int64)
        x = np.take(self.word_rows, rows[0], axis=0, mode="clip")
        for r in rows[1:]:
            x += np.take(self.word_rows, r, axis=0, mode="clip")
        return _log_softmax(x + self.v.word_bias[group]), rows

    def log_probability(self, f: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of each token's class, and of the word if it is modelled."""
        out = np.zeros(f.shape[1])
        group = np.where(at >= 0, self.v.group[at] if len(self.v.group) else CLASSES, CLASSES)
        for a in range(0, len(out), BATCH):
            s = slice(a, a + BATCH)
            g = group[s]
            out[s] = self.class_log(f[:, s])[0][np.arange(len(g)), g]
            inside = np.flatnonzero(g < CLASSES)
            if len(inside):
                log, _ = self.word_log(f[:, s][:, inside], g[inside])
                out[a + inside] += log[np.arange(len(inside)), self.v.place[at[s][inside]]]
        return out

    def learn(self, f: np.ndarray, at: np.ndarray) -> None:
        """Gradient steps over the tokens, a batch at a time."""
        group = np.where(at >= 0, self.v.group[at] if len(self.v.group) else CLASSES, CLASSES)
        for a in range(0, f.shape[1], BATCH):
            s = slice(a, a + BATCH)
            g = group[s]
            log, rows = self.class_log(f[:, s])
            _step(self.classes, self.class_seen, rows, log, g)
            inside = np.flatnonzero(g < CLASSES)
            if len(inside):
                log, rows = self.word_log(f[:, s][:, inside], g[inside])
                _step(self.word_rows, self.word_seen, rows, log, self.v.place[at[s][inside]])


# Entries that one addition of whole rows puts together.
FOLD = 8


def segment_sums(values: np.ndarray, entry: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of ``values[entry]`` over consecutive segments of these lengths (1 at least).

    Segments are cut into pieces of FOLD entries; the j-th entries of all pieces are added
    at once, then the pieces of a segment are summed in the same way.
    """
    while True:
        pieces = -(-lengths // FOLD)
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(lengths) - lengths, pieces) + FOLD * inner
        size = np.minimum(np.repeat(lengths, pieces) - FOLD * inner, FOLD)
        order = np.argsort((FOLD - size).astype(np.uint8), kind="stable")
        start = start[order]
        reach = len(size) - np.cumsum(np.bincount(size, minlength=FOLD + 1))
        sums = np.take(values, entry[start], axis=0, mode="clip")
        for j in range(1, FOLD):
            if not reach[j]:
                break
            sums[: reach[j]] += np.take(values, entry[start[: reach[j]] + j], axis=0, mode="clip")
        entry = np.empty(len(order), np.int64)
        entry[order] = np.arange(len(order))
        if len(order) == len(lengths):
            return np.take(sums, entry, axis=0, mode="clip")
        values, lengths = sums, pieces


def _step(table: np.ndarray, seen: np.ndarray, rows: np.ndarray, log: np.ndarray, hit: np.ndarray) -> None:
    """One step of all rows of the batch along the gradient of the log probability.

    A row's step is the mean over its tokens, shortened as the row is met more often.
    """
    gradient = np.negative(np.exp(log, out=log), out=log)
    gradient[np.arange(len(hit)), hit] += 1
    n = len(hit)
    flat = rows.ravel().astype(np.min_scalar_type(len(table) - 1))  # short keys sort by radix
    order = np.argsort(flat, kind="stable")
    sorted_rows = flat[order]
    cuts = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
    lengths = np.diff(np.append(cuts, len(flat)))
    sums = segment_sums(gradient, order % n, lengths)
    met = lengths.astype(np.float32)
    at = sorted_rows[cuts].astype(np.int64)
    seen[at] += met
    sums *= (STEP / np.sqrt(seen[at] * met + 1))[:, None]
    table[at] += sums


def train(training: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """One pass over the training documents, a share of them in each round.

    After a round a row moves by the mean of its steps in the tasks that met it, weighted
    by its own tokens there, so a context that few tasks hold keeps what they learned.
    Tasks with fewer than TASK_TOKENS tokens are put together first.
    """
    shape = Model(vocabulary)
    size, rows = len(shape.flat), CLASS_ROWS + WORD_ROWS
    tasks = max(vocabulary.n // (rounds * TASK_TOKENS), 1)
    flat = None
    for k in range(rounds):
        start = flat

        def run(batches, start=start):
            model = Model(vocabulary, None if start is None else start.copy())
            before = model.flat.copy()
            for batch in blocks(batches):
                h, first = tokens(batch)
                model.learn(contexts(h, first), vocabulary.find(h))
            seen = np.concatenate([model.class_seen, model.word_seen])
            if seen.any():
                step = (model.flat - before) * _per_weight(seen)
                yield from chunk_batches(np.append(step, seen).astype(np.float32))

        share = training.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == k)
        share = share.select("text").coalesce(int(tasks))
        steps = total(share.mapInArrow(run, CELLS), size + rows, "float32", "float64")
        seen = _per_weight(np.maximum(steps[size:], 1))
        flat = ((0 if flat is None else flat) + steps[:size] / seen).astype(np.float32)
    return Model(vocabulary, flat)


def _per_weight(rows: np.ndarray) -> np.ndarray:
    """The value of each row of both tables, repeated for each of its weights."""
    a, b = rows[:CLASS_ROWS], rows[CLASS_ROWS:]
    return np.concatenate([np.repeat(a, CLASSES + 1), np.repeat(b, CLASS_WORDS)])


PARTIAL = (
    "doc_id long, held_out boolean, n_tokens long, known long, log_counts double, log_model double, "
    "rare array<struct<word:long,times:int>>"
)


def partial_scores(docs: DataFrame, model: Model) -> DataFrame:
    """What each document's scores are made of, short of the counts of rare words."""
    v = model.v

    def run(batches):
        log_count = np.log10(v.counts + 1.0)
        for batch in blocks(batches):
            h, first = tokens(batch)
            at = v.find(h)
            log = model.log_probability(contexts(h, first), at) / LOG10
            in_list = at >= 0
            outside = np.ones(len(h), bool)
            outside[in_list] = v.group[at[in_list]] == CLASSES
            counted = np.where(in_list, log_count[at] if len(v.counts) else 0.0, 0.0)
            # words of the rare class that the dictionary knows score by their count here
            log = log + np.where(outside & in_list, counted, 0.0)
            starts = first[:-1]
            words, times, missing = [], [], np.flatnonzero(~in_list)
            cut = np.searchsorted(missing, first)
            for a, b in zip(cut[:-1], cut[1:]):
                w, c = np.unique(h[missing[a:b]], return_counts=True)
                words.append(signed(w))
                times.append(c.astype(np.int32))
            edges = np.cumsum([0, *map(len, words)]).astype(np.int32)
            each = [pa.array(np.concatenate(x)) for x in (words, times)]
            rare = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(each, ["word", "times"]))
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    column(batch, "held_out"),
                    pa.array(np.diff(first)),
                    pa.array(np.add.reduceat(in_list.astype(np.int64), starts)),
                    pa.array(np.add.reduceat(counted, starts)),
                    pa.array(np.add.reduceat(log, starts) - _outside(outside, starts, v)),
                    rare,
                ],
                ["doc_id", "held_out", "n_tokens", "known", "log_counts", "log_model", "rare"],
            )

    return docs.mapInArrow(run, PARTIAL)


def _outside(outside: np.ndarray, starts: np.ndarray, v: Vocabulary) -> np.ndarray:
    """What the words of the rare class divide by, summed for each text."""
    each = np.log10(v.rare_n + v.rare_distinct + 1.0)
    return np.add.reduceat(outside.astype(np.int64), starts) * each


def score(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose ``crc32(key as text) mod 7`` is 2 are held out, all others, null keys
    too, are learned from. A null or empty text is its end alone. Rows with equal keys
    are scored one by one. Without training rows every word is unknown and the model
    has the single class of such words.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    training = rows.where("not held_out")
    counts = pin(word_counts(training))
    n, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    vocabulary = Vocabulary(*common_words(counts, DICTIONARY), n, distinct)
    model = train(training, vocabulary)
    partial = pin(
        partial_scores(rows, model).withColumn("_row", F.monotonically_increasing_id())
    )
    rare = partial.select("_row", F.explode("rare").alias("r")).select("_row", "r.word", "r.times")
    rare = rare.join(counts, "word").groupBy("_row").agg(
        F.sum("times").alias("known_rare"),
        F.sum(F.col("times") * F.log10(F.col("count") + 1.0)).alias("log_rare"),
    )
    joined = partial.drop("rare").join(rare, "_row", "left")
    log_rare = F.coalesce("log_rare", F.lit(0.0))
    each = float(np.log10(n + distinct + 1.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_rare", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") + log_rare - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("log_model") + log_rare).alias("score"),
    )
