"""Toxicity: two interpolated Kneser-Ney models of word pairs, one of each label.

A label's probability of a word ``w`` after a word ``v`` is

    p(w | v) = max(n(v w) - D, 0) / n(v) + b(v) * p(w)

with the label's counts ``n``, its discount ``D`` from the pairs seen once and twice, and
``b(v)`` the share that discounts (and pairs that don't travel) leave over, so that it
sums to one. What the lower order counts is Kneser and Ney's: not how often a word occurs
but in how many different contexts (words before it) it occurs. The contexts of both
labels together give one shared distribution ``q``, discounted and interpolated with a
uniform rest for words never seen. A label's own lower order is

    p(w) = q(w) * r(w) / Z,    r(w) = (contexts of w under the label + BACKOFF)
                                      / (contexts that q lets expect + BACKOFF)

so a rare word is as likely under either label as its shared counts make it, and only a
word with far more contexts under one label than expected tells the labels apart.

A text is scored by its two log likelihoods divided by its number of words. As most words
of a text say little, and say it about its language or topic, the difference of the two is
split by how strongly single words differ, with a part of its own for what the words
before them add, and a logistic curve over these parts, fitted on labelled documents that
the counts have not seen, turns them into a probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.text import blocks, column, hashes, mix, runs, signed, texts
from logloom.runtime import pin

# Expected contexts that the shared distribution weighs in each word's ratio.
BACKOFF = 5.0
# Words whose counts travel with the tasks, at most; the others count as never seen.
WORDS = 1 << 19
# Pairs of words whose counts travel with the tasks, at most, and how often both labels
# together have each at least; after any other pair the lower order decides.
PAIRS = 1 << 19
PAIR_COUNT = 2
# Labelled rows that are learned from, about, the same number of each label at most.
LABELLED_ROWS = 500_000
# Of them those that the logistic curve is fitted on, about; all of its fold if there are fewer.
CALIBRATION_ROWS = 50_000
# A word's log ratio between these bounds falls into one part of the text's difference.
BANDS = np.array([-0.7, 0.7, 1.5, 3.0])
LABELS = ("ordinary", "toxic")
RIDGE = 0.01
START = np.uint64(0x3C6EF372FE94F82B)
_MILLION = 1_000_000


def word_bytes() -> np.ndarray:
    """Which bytes words are made of: letters, digits and all bytes beyond ASCII."""
    member = np.zeros(256, bool)
    member[48:58] = member[65:91] = member[97:123] = True
    member[128:] = True
    return member


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text); a null text has none."""
    data, offsets = texts(column(batch, "text"))
    starts, ends, first = runs(data, offsets, word_bytes())
    return hashes(data, starts, ends), first


def fold(key) -> F.Column:
    """crc32 of the key as text, modulo 5; 0 is never learned from."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, fold, toxic, text) of the documents with a label outside of fold 0.

    A document is toxic if any of its labels says so. Of each label about LABELLED_ROWS / 2
    keys are drawn, all of them if there are fewer, so that the keys can always be
    broadcast and texts stay where they are.
    """
    known = labels.where("toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("_of"), "toxic")
    known = known.withColumn("fold", fold(F.col("_of"))).where("fold <> 0")
    known = known.groupBy("_of", "fold").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    for label, n in sizes.items():
        if n > LABELLED_ROWS // 2:
            share = LABELLED_ROWS // 2 * _MILLION // n
            known = known.where((F.col("toxic") != label) | (_draw("_of") < share))
    rows = docs.join(F.broadcast(known), docs["doc_id"] == known["_of"])
    return rows.select("doc_id", "fold", "toxic", "text")


def _draw(key: str) -> F.Column:
    """A number below a million that the key alone decides."""
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(_MILLION))


def model_counts(training: DataFrame) -> DataFrame:
    """What both models are made of: a row for each word, and one for each frequent pair.

    Of a word (``before`` is null): ``ordinary``, ``toxic``, ``either``, in how many
    contexts it occurs; ``after_*``, how many words follow it; ``once_*`` and ``twice_*``,
    the pairs with so many occurrences that end in it. Of a pair: its occurrences. Texts
    begin with START, which is counted as a context only. The pairs are shuffled once.
    """

    def run(batches):
        for batch in blocks(batches):
            h, first = tokens(batch)
            if not len(h):
                continue
            before = np.empty_like(h)
            before[1:] = h[:-1]
            before[first[:-1][np.diff(first) > 0]] = START
            toxic = np.repeat(column(batch, "toxic").to_numpy(), np.diff(first)) == 1
            _, at, number = np.unique(mix(before) ^ h, return_index=True, return_inverse=True)
            n = [np.bincount(number, mask, len(at)).astype(np.int32) for mask in (~toxic, toxic)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(before[at])), pa.array(signed(h[at])), *[pa.array(x) for x in n]],
                ["before", "word", "ordinary", "toxic"],
            )

    pairs = training.select("toxic", "text").mapInArrow(run, "before long, word long, ordinary int, toxic int")
    pairs = pairs.groupBy("before", "word").agg(*[F.sum(c).alias(c) for c in LABELS])
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    is_ = lambda condition: condition.cast("long")

    def row(word, before, contexts, after, rare):
        columns = {"word": word, "before": before, **contexts, **after, **rare}
        return F.struct(*[c.alias(name) for name, c in columns.items()])

    own = {c: F.col(c) for c in LABELS}
    no_after = {f"after_{c}": none for c in LABELS}
    no_rare = {f"{k}_{c}": none for k in ("once", "twice") for c in LABELS}
    rare = {f"{k}_{c}": is_(F.col(c) == n) for k, n in (("once", 1), ("twice", 2)) for c in LABELS}
    nothing = F.lit(None).cast("long")
    no_contexts = {c: none for c in (*LABELS, "either")}
    rows = F.array(
        row(F.col("word"), nothing, {**{c: is_(F.col(c) > 0) for c in LABELS}, "either": one}, no_after, rare),
        row(F.col("before"), nothing, no_contexts, {f"after_{c}": F.col(c) for c in LABELS}, no_rare),
    )
    pair = F.array(row(F.col("word"), F.col("before"), {**own, "either": F.col("ordinary") + F.col("toxic")}, no_after, no_rare))
    frequent = F.col("ordinary") + F.col("toxic") >= PAIR_COUNT
    each = pairs.select(F.explode(F.when(frequent, F.concat(rows, pair)).otherwise(rows)).alias("r")).select("r.*")
    return each.groupBy("word", "before").agg(*[F.sum(c).alias(c) for c in each.columns[2:]])


def context_counts(training: DataFrame) -> DataFrame:
    """(word, ordinary, toxic, either): in how many contexts each word occurs."""
    return _words(model_counts(training)).select("word", *LABELS, "either")


def _words(counts: DataFrame) -> DataFrame:
    return counts.where("before is null and either > 0")


@dataclass
class Model:
    """Log probabilities of the words in hash order; ``unknown`` is any other word's.

    Both labels' discounted shares of the pairs, by ``mix(before) ^ word``, and what the
    contexts leave to the lower order; a context that is not listed leaves all.
    """

    words: np.ndarray
    shared: np.ndarray
    ratios: np.ndarray  # two rows: ordinary, toxic
    unknown: float
    pairs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    direct: np.ndarray = field(default_factory=lambda: np.zeros((2, 0), np.float32))
    contexts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    left: np.ndarray = field(default_factory=lambda: np.ones((2, 0), np.float32))

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log q, log ratios of both labels) of each word."""
        if not len(self.words):
            return np.full(len(h), self.unknown), np.zeros((2, len(h)))
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        shared = np.where(known, self.shared[at], self.unknown)
        return shared, np.where(known, self.ratios[:, at], self.ratios[:, -1:])

    def after(self, before: np.ndarray, h: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Log probabilities under both labels of words after others, from those of the lower order."""
        if not len(self.contexts):
            return lower
        at = np.minimum(np.searchsorted(self.contexts, before), len(self.contexts) - 1)
        left = np.where(self.contexts[at] == before, self.left[:, at], 1.0)
        pair = mix(before) ^ h
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        direct = np.where(self.pairs[at] == pair, self.direct[:, at], 0.0)
        return np.log(direct + left * np.exp(lower))


def fit(training: DataFrame) -> Model | None:
    """The model of the labelled documents; None unless both labels have words."""
    table = pin(model_counts(training))
    counts = _words(table)
    rare = [f"{k}_{c}" for k in ("once", "twice") for c in LABELS]
    sums = counts.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*LABELS, "either", *rare)],
        F.count("*").alias("distinct"),
        F.count(F.when(F.col("either") == 1, 1)).alias("once"),
        F.count(F.when(F.col("either") == 2, 1)).alias("twice"),
    ).first()
    if not (sums["ordinary"] and sums["toxic"]):
        return None
    discount = sums["once"] / (sums["once"] + 2 * sums["twice"]) if sums["once"] else 0.5
    spread = discount * sums["distinct"] / (sums["distinct"] + 1)

    def share(either):
        return (either - discount + spread) / sums["either"]

    def ratio(own, either, label):
        return (own + BACKOFF) / (share(either) * sums[label] + BACKOFF)

    # what the distributions of both labels sum to before they are normalised
    mass = counts.agg(*[
        F.sum(share(F.col("either")) * ratio(F.col(c), F.col("either"), c)) for c in LABELS
    ]).first()
    unseen = spread / sums["either"]
    norm = np.log(np.array(mass) + unseen)[:, None]
    rows = most_contexts(counts, WORDS).select("word", *LABELS, "either").toArrow().combine_chunks()
    own = {c: rows[c].to_numpy().astype(float) for c in (*LABELS, "either")}
    words = rows["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    ratios = np.stack([np.log(ratio(own[c], own["either"], c)) for c in LABELS])[:, order]
    return Model(
        words[order],
        np.log(share(own["either"][order])).astype(np.float32),
        # the last column is that of all words that are not in the list
        np.hstack([ratios - norm, -norm]).astype(np.float32),
        float(np.log(unseen)) if unseen else -50.0,
        *_higher_order(table, [_discount(sums[f"once_{c}"], sums[f"twice_{c}"]) for c in LABELS]),
    )


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once else 0.5


def _higher_order(table: DataFrame, discounts: list[float]) -> tuple:
    """(pairs, direct, contexts, left) of a ``Model``: the discounted counts of the pairs."""
    known = table.where("before is null").select(F.col("word").alias("before"), *[f"after_{c}" for c in LABELS])
    pairs = most_contexts(table.where("before is not null"), PAIRS).select("before", "word", *LABELS)
    rows = pairs.join(known, "before").toArrow().combine_chunks()
    before, word = (rows[c].to_numpy().view(np.uint64) for c in ("before", "word"))
    direct = []
    for c, discount in zip(LABELS, discounts):
        n, after = (rows[x].to_numpy().astype(float) for x in (c, f"after_{c}"))
        direct.append(np.maximum(n - discount, 0) / np.maximum(after, 1))
    contexts, at = np.unique(before, return_inverse=True)
    left = np.stack([1 - np.bincount(at, d, len(contexts)) for d in direct])
    pair = mix(before) ^ word
    order = np.argsort(pair)
    # discounts leave something wherever they have counts; the rest is rounding
    left = np.maximum(left, 1e-6).astype(np.float32)
    return pair[order], np.stack(direct)[:, order].astype(np.float32), contexts, left


def most_contexts(counts: DataFrame, most: int) -> DataFrame:
    """The rows with the most contexts or occurrences: at most ``most`` of them, equal ones together."""
    sizes = counts.groupBy("either").agg(F.count("*").alias("n")).orderBy(F.desc("either"))
    taken, least = 0, None
    for row in sizes.limit(most).collect():
        taken += row["n"]
        if taken > most:
            break
        least = row["either"]
    return counts.where(F.col("either") >= least) if least is not None else counts.limit(0)


# The bands of single words, and the words before them.
PARTS = len(BANDS) + 2
FEATURES = "doc_id long, n_tokens long, ordinary double, toxic double, parts array<double>"


def features(rows: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: its words, both log likelihoods a word, and the parts of their difference."""
    schema = ", ".join([FEATURES, *[f"{c} int" for c in keep]])

    def run(batches):
        for batch in blocks(batches):
            h, first = tokens(batch)
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            shared, ratios = model.look_up(h)
            difference = ratios[1] - ratios[0]
            band = np.digitize(difference, BANDS)
            per_word = 1 / np.maximum(n, 1)
            before = np.empty_like(h)
            before[1:] = h[:-1]
            before[first[:-1][n > 0]] = START
            logs = model.after(before, h, shared + ratios)
            likelihoods = [np.bincount(doc, x, len(n)) * per_word for x in logs]
            parts = np.bincount(doc * PARTS + band, difference, len(n) * PARTS).reshape(len(n), PARTS)
            parts[:, -1] = np.bincount(doc, logs[1] - logs[0] - difference, len(n))
            parts = (parts * per_word[:, None]).ravel()
            edges = np.arange(len(n) + 1, dtype=np.int32) * PARTS
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "doc_id"),
                    pa.array(n),
                    *[pa.array(x) for x in likelihoods],
                    pa.ListArray.from_arrays(pa.array(edges), pa.array(parts)),
                    *[column(batch, c) for c in keep],
                ],
                ["doc_id", "n_tokens", "ordinary", "toxic", "parts", *keep],
            )

    return rows.select("doc_id", *keep, "text").mapInArrow(run, schema)


class Curve:
    """Logistic regression over the parts and the logarithm of the number of words."""

    def __init__(self, parts: np.ndarray, n_tokens: np.ndarray, label: np.ndarray):
        x = self._matrix(parts, n_tokens)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        a = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        weights = np.zeros(a.shape[1])
        penalty = np.full(a.shape[1], RIDGE)
        penalty[-1] = 1e-6
        for _ in range(50):
            p = _sigmoid(a @ weights)
            gradient = a.T @ (label - p) - penalty * weights
            hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            weights += step / max(1.0, np.abs(step).max() / 2)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = weights

    @staticmethod
    def _matrix(parts, n_tokens):
        return np.column_stack([parts, np.log1p(n_tokens)])

    def column(self, parts, n_tokens) -> F.Column:
        """The probability as an expression of the feature columns."""
        slope = self.weights[:-1] / self.scale
        z = F.lit(float(self.weights[-1] - slope @ self.mean))
        for k in range(PARTS):
            z = z + F.element_at(parts, k + 1) * F.lit(float(slope[k]))
        z = z + F.log1p(n_tokens) * F.lit(float(slope[PARTS]))
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-500.0)), F.lit(500.0))))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def calibrate(rows: DataFrame, model: Model) -> Curve | None:
    """The curve of the rows, or of about CALIBRATION_ROWS of them, drawn by their keys.

    None if the drawn rows have one label only.
    """
    n = rows.count()
    if n > CALIBRATION_ROWS:
        share = CALIBRATION_ROWS * _MILLION // n
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(_MILLION)) < share)
    drawn = features(rows, model, ("label",)).select("parts", "n_tokens", "label").toArrow()
    label = drawn["label"].to_numpy().astype(float)
    if not len(label) or label.min() == label.max():
        return None
    parts = drawn["parts"].combine_chunks().flatten().to_numpy().reshape(-1, PARTS)
    return Curve(parts, drawn["n_tokens"].to_numpy(), label)


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_tokens, toxic_log10, ordinary_log10) of every row.

    ``score`` is the probability of label 1. Rows whose ``crc32(key as text) mod 5`` is 0
    are held out; of the others with a label, remainder 1 fits the curve and 2 to 4 are
    counted. A null key has no label and is not held out; rows with equal keys are learned
    from and scored one by one. A null or empty text, and one without words, is scored by
    its length alone. Where the labels don't suffice (one of them missing among the counted
    or the curve's rows), every score is the share of label 1 among the rows learned from,
    0 without any. The log likelihoods are averages a word, 0 without words.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    known = labelled(rows, labels.select(F.col(key).alias("doc_id"), "toxic"))
    model = fit(known.where("fold <> 1"))
    curve = model and calibrate(known.where("fold = 1").withColumnRenamed("toxic", "label"), model)
    if curve is None:
        model = model or Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros((2, 1)), 0.0)
        base = known.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0]
        chance = F.lit(float(base))
    else:
        chance = curve.column(F.col("parts"), F.col("n_tokens"))
    scored = features(rows, model).withColumn("score", chance)
    log10 = float(np.log(10.0))
    return scored.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_tokens",
        (F.col("toxic") / log10).alias("toxic_log10"),
        (F.col("ordinary") / log10).alias("ordinary_log10"),
    )
