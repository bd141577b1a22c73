"""Language identification: Bayesian fusion of the text with what is declared about it.

Four kinds of evidence meet in one posterior:

- the text, as likelihoods of its letter trigrams under a model of each language;
- the language its markup declares, whose reliability is estimated;
- the address suffix, and
- the host, as priors smoothed from the host to its suffix to the whole corpus.

Models and priors are sums over all rows, made by grouped aggregation. A row's own share
is taken out of its host prior. Any of the three columns may be null, and then says
nothing.

Every declared code is modelled, however few rows declare it, unless its own texts speak
against it: a code is no language of its own if another, larger one explains its texts
at least as well as what is learned from its other texts does, or if the rest of the
corpus does. Models are smoothed towards the corpus, so the model of a small language is
as small as its texts, and only those cells travel with the tasks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.names import own_names
from logloom.llm.text import BLOCK_BYTES, blocks, column, mix, texts
from logloom.runtime import pin

BUCKET_BITS = 15
# Overlapping trigrams are far from independent; their sum counts for this part of it.
TEMPER = 0.25
# Rows' worth of suffix prior in a host prior, and of corpus prior in a suffix prior.
HOST_WEIGHT, SUFFIX_WEIGHT = 20.0, 100.0
# Trigrams' worth of the corpus in the model of a language.
PRIOR = float(1 << 14)
# Parts of a code's texts; each is explained by what is learned from the other parts.
FOLDS = 8
# Cells a task counts before it passes them on.
COUNTED = 1 << 20
# Masses below the rounding of 1.0 are not passed on.
ROUNDING = 2.0**-53
ACCEPT = 0.5

# What is never shown, to its end or to that of the page; then any other tag.
HIDDEN = re.compile(
    r"(?is)<!--.*?(?:-->|\Z)|<(script|style|template|noscript)\b[^>]*>.*?(?:</\1\b[^>]*>|\Z)"
)
TAG = re.compile(r"</?[A-Za-z!?](?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+>|</?[A-Za-z!?][^<>]*+>")

EVIDENCE = ("_declared", "_suffix", "_host")


def with_evidence(docs: DataFrame, declared: Column, suffix: Column, host: Column) -> DataFrame:
    """``docs`` with the columns of EVIDENCE; null where a row says nothing."""
    given = dict(zip(EVIDENCE, (F.lower(declared), suffix, host)))
    return docs.withColumns({k: F.nullif(v.cast("string"), F.lit("")) for k, v in given.items()})


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents: the declared language is ``lang``, the host ``source``; no address."""
    return with_evidence(docs, F.col("lang"), F.lit(None), F.col("source"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Pages: ``<html lang>``, and suffix and host of ``url``; ``text`` is what shows."""
    # by hand, as parse_url refuses addresses with odd characters in their path
    host = F.lower(F.regexp_extract("url", r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1)
    suffix = F.substring_index(host, ".", -1)
    ready = with_evidence(pages, declared, suffix, host)
    kept = [c for c in ready.columns if c != "text"]

    def run(batches):
        for batch in blocks(batches, "_html"):
            seen = [None if h is None else visible(h) for h in column(batch, "_html").to_pylist()]
            columns = [column(batch, c) for c in kept] + [pa.array(seen, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "text"])

    out = ready.select(*kept).schema.add("text", "string")
    return ready.select(*kept, F.col("html").alias("_html")).mapInArrow(run, out)


def visible(markup: str) -> str:
    """The text of a page: no comments, scripts, styles or tags, references resolved."""
    return html.unescape(TAG.sub(" ", HIDDEN.sub(" ", markup)))


def _symbols() -> np.ndarray:
    """A code for each byte: letters without regard to the case of A-Z, all else alike."""
    codes = np.zeros(256, np.uint64)
    letters = [*range(65, 91), *range(97, 123), *range(128, 256)]
    codes[letters] = mix(np.array(letters, np.uint64) | np.uint64(32))
    codes[128:] = mix(np.arange(128, 256, dtype=np.uint64))
    return codes


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of all trigrams with a letter; texts begin and end with a gap."""
    codes = _symbols()[data]
    n = len(codes)
    padded = np.zeros(n + 2 * (len(offsets) - 1) + 2, np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    padded[np.arange(n) + 2 * row + 1] = codes
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    h = mix(a * np.uint64(3) + b * np.uint64(0x9E3779B1) + c * np.uint64(0x85EBCA6B5))
    lettered = (b != 0) | ((a != 0) & (c != 0))
    owner = np.searchsorted(offsets + 2 * np.arange(len(offsets)), np.arange(len(a)) + 1, "right") - 1
    lettered &= owner < len(offsets) - 1
    return (h[lettered] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), owner[lettered]


def bucket_counts(rows: DataFrame) -> DataFrame:
    """(code, bucket, n, f): trigrams of the texts that declare a code, in all and by fold.

    Equal texts are in one fold.
    """
    buckets = 1 << BUCKET_BITS

    def run(batches):
        number, keys, sums, size = {}, [], [], 0

        def merged():
            k, at = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(at, weights=np.concatenate(sums)).astype(np.int64)

        def out(k, n):
            code = pa.array(list(number), pa.string()).take(pa.array(k // (FOLDS * buckets)))
            fold, bucket = (pa.array(x.astype(np.int32)) for x in (k // buckets % FOLDS, k % buckets))
            return pa.RecordBatch.from_arrays([code, fold, bucket, pa.array(n)], ["code", "fold", "bucket", "n"])

        for batch in blocks(batches):
            found, owner = trigrams(*texts(column(batch, "text")))
            spoken = [number.setdefault(c, len(number)) for c in column(batch, EVIDENCE[0]).to_pylist()]
            part = np.array(spoken, np.int64) * FOLDS + column(batch, "fold").to_numpy()
            parts, local = np.unique(part, return_inverse=True)
            at = local[owner] * buckets + found
            if len(parts) * buckets <= 4 * BLOCK_BYTES:
                n = np.bincount(at, minlength=len(parts) * buckets)
                at = np.flatnonzero(n)
                n = n[at]
            else:
                at, n = np.unique(at, return_counts=True)
            keys.append(parts[at // buckets] * buckets + at % buckets)
            sums.append(n)
            size += len(n)
            if size > COUNTED:
                k, n = merged()
                keys, sums, size = [k], [n], len(k)
                if size > COUNTED // 2:
                    yield out(k, n)
                    number, keys, sums, size = {}, [], [], 0
        if keys:
            yield out(*merged())

    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")
    declaring = rows.where(f"{EVIDENCE[0]} is not null").select("text", EVIDENCE[0], fold)
    each = declaring.mapInArrow(run, "code string, fold int, bucket int, n long")
    parts = [F.sum(F.when(F.col("fold") == k, F.col("n")).otherwise(0)) for k in range(FOLDS)]
    return each.groupBy("code", "bucket").agg(F.sum("n").alias("n"), F.array(*parts).alias("f"))


class Model:
    """The cells that each language has, and the corpus for the others."""

    def __init__(self, cells: pa.Table, corpus: np.ndarray):
        self.corpus = (corpus + 0.5) / (corpus + 0.5).sum()
        table = cells.sort_by([("code", "ascending"), ("bucket", "ascending")])
        code = table["code"].to_numpy()
        cuts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, int)
        self.codes = [str(c) for c in code[cuts]]
        self.buckets = np.split(table["bucket"].to_numpy().astype(np.uint16), cuts[1:])
        self.counts = np.split(table["n"].to_numpy().astype(np.float32), cuts[1:])
        self.totals = [float(n.sum(dtype=np.float64)) for n in self.counts]

    def tables(self) -> Iterator[np.ndarray]:
        """Tempered log probability of each trigram bucket, language by language."""
        for buckets, counts, whole in zip(self.buckets, self.counts, self.totals):
            cells = PRIOR * self.corpus
            cells[buckets] += counts
            yield (TEMPER * np.log(cells / (whole + PRIOR))).astype(np.float32)


def _explained(counted: DataFrame, sizes: DataFrame, corpus: np.ndarray) -> DataFrame:
    """(code, own, rest): log probability of each code's texts by fold.

    ``own`` is that under what the other folds have, smoothed towards the rest of the
    corpus, ``rest`` that under the rest alone.
    """

    def run(batches):
        for batch in batches:
            n, f, whole, t, rest = _cells(batch, corpus)
            other = (n[:, None] - f + PRIOR * rest[:, None]) / (whole[:, None] - t + PRIOR)
            own = (f * np.log(other)).sum(axis=1)
            columns = [column(batch, "code"), pa.array(own), pa.array(n * np.log(rest))]
            yield pa.RecordBatch.from_arrays(columns, ["code", "own", "rest"])

    each = counted.join(sizes, "code").mapInArrow(run, "code string, own double, rest double")
    return each.groupBy("code").agg(F.sum("own").alias("own"), F.sum("rest").alias("rest"))


def _cells(batch: pa.RecordBatch, corpus: np.ndarray):
    """Counts of each row in all and by fold, those of its code, and the rest's shares."""
    n, whole = (column(batch, c).to_numpy().astype(float) for c in ("n", "whole"))
    f, t = (column(batch, c).flatten().to_numpy().reshape(-1, FOLDS) for c in ("f", "t"))
    rest = corpus[column(batch, "bucket").to_numpy()] - n + 0.5
    return n, f, whole, t, rest / (corpus.sum() - whole + 0.5 * len(corpus))


def _explained_by(counted: DataFrame, sizes: DataFrame, corpus: np.ndarray, others: Model) -> DataFrame:
    """(code, other, by_other): log probability of each code's texts under larger ones."""

    def run(batches):
        for batch in batches:
            code = column(batch, "code").dictionary_encode()
            names, at = code.dictionary, code.indices.to_numpy()
            n, _, _, _, rest = _cells(batch, corpus)
            bucket = column(batch, "bucket").to_numpy()
            for other, cells, counts, whole in zip(others.codes, others.buckets, others.counts, others.totals):
                dense = np.zeros(len(corpus))
                dense[cells] = counts
                log = n * np.log((dense[bucket] + PRIOR * rest) / (whole + PRIOR))
                sums = pa.array(np.bincount(at, weights=log, minlength=len(names)))
                columns = [names, pa.array([other] * len(names)), sums]
                yield pa.RecordBatch.from_arrays(columns, ["code", "other", "by_other"])

    each = counted.join(sizes, "code").mapInArrow(run, "code string, other string, by_other double")
    each = each.groupBy("code", "other").agg(F.sum("by_other").alias("by_other"))
    larger = sizes.select(F.col("code").alias("other"), F.col("whole").alias("larger"))
    each = each.join(larger, "other").join(sizes.select("code", "whole"), "code")
    return each.where("larger > whole or larger = whole and other < code").select("code", "other", "by_other")


def train(rows: DataFrame) -> Model:
    """The model of every declared code whose texts do not speak against it.

    The code with the most text is always one. The driver sees the cells of codes that
    are languages, not those of all declared codes.
    """
    counted = pin(bucket_counts(rows))
    folds = [F.sum(F.get("f", F.lit(k))) for k in range(FOLDS)]
    sizes = pin(counted.groupBy("code").agg(F.sum("n").alias("whole"), F.array(*folds).alias("t")))
    corpus = np.zeros(1 << BUCKET_BITS)
    for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # fixed size
        corpus[r["bucket"]] = r["n"]
    first = sizes.orderBy(F.desc("whole"), "code").limit(1).select("code")

    def cells(codes: DataFrame) -> Model:
        kept = counted.join(codes.distinct(), "code", "left_semi")
        return Model(kept.select("code", "bucket", "n").toArrow(), corpus)

    explained = pin(_explained(counted, sizes, corpus))
    # what rounding leaves of a code whose texts are all in one fold is no difference
    gain = (F.col("own") - F.col("rest")) / F.abs("rest")
    others = cells(explained.where(gain > 1e-9).select("code").union(first))
    better = _explained_by(counted, sizes, corpus, others).join(explained, "code")
    worse = better.where("by_other >= own").select("code").union(explained.where(gain < -1e-9).select("code"))
    return cells(explained.select("code").join(worse.distinct(), "code", "left_anti").union(first))


def scored(batches: Iterator[pa.RecordBatch], model: Model):
    """(batch, log likelihoods of each text, number of its trigrams) for each block."""
    for batch in blocks(batches):
        found, owner = trigrams(*texts(column(batch, "text")))
        n = batch.num_rows
        like = np.stack(
            [np.bincount(owner, weights=part[found], minlength=n) for part in model.tables()], axis=1
        )
        yield batch, like, np.bincount(owner, minlength=n)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _said(batch: pa.RecordBatch, codes: list[str]) -> np.ndarray:
    """Number of each row's declared language; one more for other codes, -1 for none."""
    number = {c: i for i, c in enumerate(codes)}
    return np.array(
        [number.get(d, len(codes)) if d else -1 for d in column(batch, EVIDENCE[0]).to_pylist()],
        np.int64,
    )


def group_sums(rows: DataFrame, model: Model) -> DataFrame:
    """(said, suffix, host, language, mass): posteriors of the text alone, summed.

    Languages are numbers here; what a block has of a group is summed in the task.
    """

    def run(batches):
        for batch, like, count in scored(batches, model):
            mass = softmax(like) * (count > 0)[:, None]
            said = _said(batch, model.codes).tolist()
            groups: dict[tuple, int] = {}
            keys = zip(said, *(column(batch, c).to_pylist() for c in EVIDENCE[1:]))
            at = np.array([groups.setdefault(k, len(groups)) for k in keys], np.int64)
            sums = np.zeros((len(groups), mass.shape[1]))
            np.add.at(sums, at, mass)
            group, language = np.nonzero(sums > ROUNDING)
            columns = [
                pa.array([k[i] for k in groups], kind).take(pa.array(group))
                for i, kind in enumerate((pa.int32(), pa.string(), pa.string()))
            ]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(language.astype(np.int32)), pa.array(sums[group, language])],
                ["said", *EVIDENCE[1:], "language", "mass"],
            )

    kind = f"said int, {EVIDENCE[1]} string, {EVIDENCE[2]} string, language int, mass double"
    each = rows.select("text", *EVIDENCE).mapInArrow(run, kind)
    return each.groupBy("said", *EVIDENCE[1:], "language").agg(F.sum("mass").alias("mass"))


def identify(rows: DataFrame) -> DataFrame:
    """``rows`` (with EVIDENCE) plus ``_language``, ``_posterior``, ``_by_text`` and ``_kept``.

    All rows and columns stay, repeated rows too. A row is kept if its best language
    has a posterior of ACCEPT or more and its text holds a letter; a null, empty or
    letterless text is judged by the other evidence but not kept. Ties go to the first
    code. Without any declared language of a text with letters there is nothing to learn
    from: every row gets null and is not kept.
    """
    model = train(rows)
    codes = model.codes
    added = "_language string, _posterior double, _by_text string, _kept boolean"
    if not codes:
        none = dict(part.split() for part in added.split(", "))
        return rows.withColumns(
            {c: F.lit(False if c == "_kept" else None).cast(t) for c, t in none.items()}
        ).drop(*EVIDENCE)
    sums = pin(group_sums(rows, model))
    corpus = np.ones(len(codes))
    for r in sums.groupBy("language").agg(F.sum("mass").alias("m")).collect():
        corpus[r["language"]] += r["m"]
    share = corpus / corpus.sum()
    reliable = np.ones((len(codes), len(codes) + 1))
    heard = sums.where("said >= 0").groupBy("language", "said").agg(F.sum("mass").alias("m"))
    for r in heard.collect():  # languages squared
        reliable[r["language"], r["said"]] += r["m"]
    reliable = np.log(reliable / reliable.sum(axis=1, keepdims=True))
    priors = pin(_priors(sums))

    def run(batches):
        for batch, like, count in scored(batches, model):
            kept = batch.num_columns - 2
            own = softmax(like) * (count > 0)[:, None]
            host = _dense(column(batch, "_host_mass"), len(codes))
            base = _dense(column(batch, "_suffix_mass"), len(codes)) + SUFFIX_WEIGHT * share
            base /= base.sum(axis=1, keepdims=True)
            said = _said(batch, codes)
            host = np.maximum(host - own, 0) + HOST_WEIGHT * base
            score = like + np.log(host / host.sum(axis=1, keepdims=True))
            score += np.where(said[:, None] >= 0, reliable.T[said], 0)
            post = softmax(score)
            best = post.argmax(axis=1)
            by_text = like.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                batch.columns[:kept]
                + [
                    pa.array([codes[i] for i in best]),
                    pa.array(post.max(axis=1)),
                    pa.array([codes[i] if n else None for i, n in zip(by_text, count)], pa.string()),
                    pa.array((post.max(axis=1) >= ACCEPT) & (count > 0)),
                ],
                batch.schema.names[:kept] + [c.split()[0] for c in added.split(", ")],
            )

    keys = F.coalesce(EVIDENCE[1], F.lit("")), F.coalesce(EVIDENCE[2], F.lit(""))
    ready = rows.withColumns({"_at_suffix": keys[0], "_at_host": keys[1]})
    ready = ready.join(priors, ["_at_suffix", "_at_host"], "left").select(
        *[rows[c] for c in rows.columns], "_host_mass", "_suffix_mass"
    )
    out = ready.drop("_host_mass", "_suffix_mass").schema
    for part in added.split(", "):
        out = out.add(*part.split())
    return ready.mapInArrow(run, out).drop(*EVIDENCE)


def _dense(masses: pa.Array, size: int) -> np.ndarray:
    """Lists of (language, mass) as rows of ``size`` numbers; null as zeros."""
    out = np.zeros((len(masses), size))
    each = pc.fill_null(pc.list_value_length(masses), 0).to_numpy(zero_copy_only=False)
    flat = masses.flatten()
    row = np.repeat(np.arange(len(masses)), each)
    language, mass = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("language", "mass"))
    out[row, language] = mass
    return out


def _priors(sums: DataFrame) -> DataFrame:
    """(suffix, host) to the masses of the host and of its suffix, as lists.

    Rows without a host share the group of their suffix, whose masses are the prior
    then; they say nothing of their own. Nor do rows without a suffix of theirs.
    """
    suffix, host = F.coalesce(EVIDENCE[1], F.lit("")), F.coalesce(EVIDENCE[2], F.lit(""))
    placed = sums.select(suffix.alias("_at_suffix"), host.alias("_at_host"), "language", "mass")

    def masses(by: list[str], name: str) -> DataFrame:
        each = placed.groupBy(*by, "language").agg(F.sum("mass").alias("mass"))
        listed = F.collect_list(F.struct("language", "mass"))
        listed = F.when(F.col(by[-1]) != "", listed).otherwise(F.expr("filter(array(named_struct('language', 0, 'mass', 0D)), x -> false)"))
        return each.groupBy(*by).agg(listed.alias(name))

    suffixes = masses(["_at_suffix"], "_suffix_mass")
    return masses(["_at_suffix", "_at_host"], "_host_mass").join(suffixes, "_at_suffix")


def identified_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, language, posterior, by_text, kept) of every document."""
    rows = document_evidence(docs.select("doc_id", "text", "lang", "source"))
    return identify(rows).select(
        "doc_id",
        F.col("_language").alias("language"),
        F.col("_posterior").alias("posterior"),
        F.col("_by_text").alias("by_text"),
        F.col("_kept").alias("kept"),
    )


def identified_pages(pages: DataFrame) -> DataFrame:
    """(page_id, language, posterior, by_text, kept) of every page."""
    rows = page_evidence(pages.select("page_id", "url", "html")).drop("url", "html")
    return identify(rows).select(
        "page_id",
        F.col("_language").alias("language"),
        F.col("_posterior").alias("posterior"),
        F.col("_by_text").alias("by_text"),
        F.col("_kept").alias("kept"),
    )


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is sure enough, with their own columns."""
    docs, back = own_names(docs)
    kept = identify(document_evidence(docs)).where("_kept").select(*docs.columns)
    return kept.withColumnsRenamed(back)
