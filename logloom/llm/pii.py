"""Personal data: plain patterns, and bootstrapped extraction from their contexts.

Everything is DataFrame functions. A text is split and matched by the same expression,
so the lengths of what lies between the matches give their places. All matches become
rows with the words around them.

Matches of the plain patterns are the seeds. The words around a seed induce lexical
patterns, and patterns and identifiers form a graph: an edge says that the identifier
occurs in the pattern. Scores go back and forth: a pattern is worth as much as the part
of its identifiers that are believed, shrunk when it has few; an identifier is believed
as much as its patterns together suggest. After some rounds the patterns that are sure
enough give away further identifiers: words with a digit or an at sign that none of the
plain patterns knows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.llm.names import own_names
from logloom.runtime import pin

KINDS = ("email", "ip", "card", "phone")
FOUND = "context"

# The plain patterns. They match what the simpler forms of the contract
# match, leftmost and as far as they go, but never step back or start inside a run that
# has failed, so long texts take linear time and no deep stack.
_LOCAL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without a match of these has no match of the pattern.
NEEDED = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]"}
# What may be an identifier without being known: a word with a digit or an at sign.
WORD = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])[\p{L}0-9][\p{L}0-9@._%+/:#-]{3,62}+(?![\p{L}0-9@._%+/:#-])"
WORD_NEEDED = "[0-9@]"

MATCH = "struct<kind:int,idx:int,gap:int,size:int,value:string,before:string,after:string>"
# Code points of the text before and after a match in which its context is looked for.
BEFORE, AFTER = 64, 32
ROUNDS = 4
# A pattern is sure with this score, which is shrunk by SHRINK unbelieved identifiers,
# and with this many different seeds.
SURE, SHRINK, LEAST_SEEDS = 0.5, 2.0, 3
BELIEVED = 0.5


def _valid(kind: Column, value: Column) -> Column:
    """Whether a match counts; the contract's tests of each kind."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    ip = value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    # from the right, every second digit counts twice, as the sum of its digits
    luhn = F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
                d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
            ),
        ),
        F.lit(0),
        lambda a, d: a + F.coalesce(d, F.lit(0)),
    )
    card = F.when(n.between(14, 19), luhn % 10 == 0).otherwise(False)
    return (
        F.when(kind == 1, ip)
        .when(kind == 2, card)
        .when(kind == 3, n.between(10, 15))
        .otherwise(True)
    )


def _matches(kind: int, pattern: str, needed: str) -> Column:
    """An array of (kind, idx, gap, size, value, before, after), a struct for each match."""
    text = F.col("text")
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
        gaps.alias("gap"),
        F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"),
    )
    made = F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("idx"),
            F.length(z["gap"]).alias("gap"),
            F.length(z["value"]).alias("size"),
            z["value"].alias("value"),
            F.right(z["gap"], F.lit(BEFORE)).alias("before"),
            F.left(z["next"], F.lit(AFTER)).alias("after"),
        ),
    )
    none = F.array().cast(f"array<{MATCH}>")
    made = F.filter(made, lambda m: m["value"].isNotNull())
    return F.when(text.rlike(needed), made).otherwise(none)


def occurrences(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """All matches with their places, and one row without kind for every document.

    (row, doc_id, text_hash, kind, start, end, value, before, after): ``row`` tells rows
    with equal keys apart; ``kind`` is the place in KINDS, or after them for a word that
    may be an identifier and lies in no valid match. Code points, the end exclusive.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = F.array(F.lit(None).cast(MATCH))  # the row that stands for the document
    every = [whole, *(_matches(i, PATTERNS[k], NEEDED[k]) for i, k in enumerate(KINDS))]
    every.append(_matches(len(KINDS), WORD, WORD_NEEDED))
    found = rows.select(
        "row", "doc_id", F.xxhash64("text").alias("text_hash"), F.concat(*every).alias("m")
    ).select("row", "doc_id", "text_hash", F.explode("m").alias("m"))
    found = found.select("row", "doc_id", "text_hash", "m.*")
    upto = W.partitionBy("row", "kind").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    placed = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    valid = placed.where(F.col("kind").isNull() | _valid(F.col("kind"), F.col("value")))
    # a word inside or beside a valid match belongs to it
    by_start = W.partitionBy("row").orderBy("start", "kind")
    word = F.col("kind") == len(KINDS)
    before = F.max(F.when(~word, F.col("end"))).over(
        by_start.rowsBetween(W.unboundedPreceding, -1)
    )
    # downwards: a frame without end would be gone through again for every row
    by_end = W.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"))
    after = F.min(F.when(~word, F.col("start"))).over(by_end.rowsBetween(W.unboundedPreceding, -1))
    same = F.max(F.when(~word, F.col("start") == F.col("start"))).over(
        W.partitionBy("row", "start")
    )
    marked = valid.withColumns({"_before": before, "_after": after, "_same": same})
    clear = (
        (F.coalesce("_before", F.lit(0)) <= F.col("start"))
        & (F.coalesce("_after", F.col("end")) >= F.col("end"))
        & F.col("_same").isNull()
    )
    kept = marked.where(F.col("kind").isNull() | ~word | clear)
    return kept.select(
        "row", "doc_id", "text_hash", "kind", "start", "end", "value", "before", "after"
    )


def edges(found: DataFrame) -> DataFrame:
    """(pattern, item, seed, times): which identifiers occur in which lexical patterns.

    Patterns are the two words before, and the word before with the word after; letters
    in lower case, digits as one sign. Beginnings and ends of texts are words too.
    """

    def words(c: Column) -> Column:
        return F.regexp_replace(F.lower(c), "[0-9]+", "0")

    # the first piece may be the rest of a word that was cut off
    left = F.filter(F.split(words(F.col("before")), r"\s+"), lambda w: w != "")
    right = F.filter(F.split(words(F.col("after")), r"\s+"), lambda w: w != "")
    one = F.coalesce(F.try_element_at(left, F.lit(-1)), F.lit("^"))
    two = F.coalesce(F.try_element_at(left, F.lit(-2)), F.lit("^"))
    next_ = F.coalesce(F.try_element_at(right, F.lit(1)), F.lit("$"))
    patterns = F.array(
        F.concat(two, F.lit(" "), one, F.lit(" _")), F.concat(one, F.lit(" _ "), next_)
    )
    each = found.where("kind is not null").select(
        F.explode(patterns).alias("pattern"),
        F.lower("value").alias("item"),
        (F.col("kind") < len(KINDS)).alias("seed"),
    )
    return each.groupBy("pattern", "item").agg(
        F.max("seed").alias("seed"), F.count("*").alias("times")
    )


def _suggested() -> Column:
    """Belief in an identifier: that not all of its sure patterns are wrong."""
    score = F.when(F.col("score") >= SURE, F.least(F.col("score"), F.lit(0.999))).otherwise(0.0)
    return 1 - F.exp(F.sum(F.log1p(-score)))


def sure_patterns(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score) of the patterns that are sure after ``rounds`` rounds of scoring.

    Only patterns with at least one seed can be sure, so the others take no part.
    """
    seeded = graph.groupBy("pattern").agg(F.count(F.when(F.col("seed"), 1)).alias("seeds"))
    seeded = seeded.where(F.col("seeds") >= LEAST_SEEDS)
    graph = pin(graph.join(seeded, "pattern"))
    belief = graph.select("pattern", "item", "seed", "seeds", F.col("seed").cast("double").alias("b"))
    patterns = None
    for _ in range(rounds):
        # the mean belief of a pattern's identifiers, as if SHRINK others did not hold
        patterns = belief.groupBy("pattern").agg(
            (F.sum("b") / (F.count("*") + F.lit(SHRINK))).alias("score")
        )
        patterns = pin(patterns)
        # an identifier fails only if all its sure patterns fail it
        items = (
            graph.select("pattern", "item", "seed")
            .join(patterns, "pattern")
            .groupBy("item")
            .agg(
                F.max("seed").alias("known"),
                _suggested().alias("p"),
            )
        )
        believed = F.when(F.col("known"), 1.0).when(F.col("p") >= BELIEVED, F.col("p"))
        items = items.select("item", F.coalesce(believed, F.lit(0.0)).alias("b"))
        belief = pin(graph.join(items, "item").select("pattern", "item", "seed", "seeds", "b"))
    return patterns.where(F.col("score") >= SURE)


def discovered(found: DataFrame, patterns: DataFrame, graph: DataFrame) -> DataFrame:
    """(row, start, end) of the words that sure patterns give away."""
    items = graph.where("not seed").join(patterns, "pattern").groupBy("item").agg(
        _suggested().alias("p")
    )
    items = items.where(F.col("p") >= BELIEVED)
    words = found.where(F.col("kind") == len(KINDS))
    return words.join(items, F.lower("value") == F.col("item"), "left_semi").select(
        "row", "doc_id", "text_hash", "start", "end"
    )


def spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """All spans: (row, doc_id, text_hash, kind name or null, order, start, end)."""
    found = pin(occurrences(docs, key))
    graph = pin(edges(found))
    new = discovered(found, sure_patterns(graph), graph)
    names = F.array(*[F.lit(k) for k in (*KINDS, FOUND)])
    base = found.where(F.col("kind").isNull() | (F.col("kind") < len(KINDS)))
    added = new.withColumn("kind", F.lit(len(KINDS)))
    columns = ["row", "doc_id", "text_hash", "kind", "start", "end"]
    every = base.select(*columns).unionByName(added.select(*columns))
    return every.withColumn("name", F.get(names, F.col("kind")))


def find_personal_data(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context) of every row.

    ``spans`` holds base and discovered spans as kind:start:end by start, then kind.
    Null and empty texts have none. Rows with equal or null keys stay apart; other
    columns are not looked at. No rows give no rows.
    """
    every = spans(docs, key)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "end", "name"))
    of = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("s")
    )

    def line(s: Column) -> Column:
        each = F.transform(
            s, lambda x: F.concat_ws(":", x["name"], x["start"].cast("string"), x["end"].cast("string"))
        )
        return F.array_join(each, ",")

    def number(kind: int, name: str) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{name}")

    base = F.filter("s", lambda x: x["kind"] < len(KINDS))
    counts = [number(i, k) for i, k in enumerate((*KINDS, FOUND))]
    return of.select(
        "doc_id",
        *counts[: len(KINDS)],
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("s")).alias("spans"),
        counts[-1],
    )


def redact(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind, as ``<EMAIL>``.

    Of spans that overlap, the one that begins first stands for all; ties go to the
    longer. All rows and columns stay; null texts stay null.
    """
    docs, back = own_names(docs)
    every = spans(docs, key).where("kind is not null").select(
        "doc_id", "text_hash", "start", "end", "name"
    ).distinct()  # repeated rows have the same spans
    order = W.partitionBy("doc_id", "text_hash").orderBy("start", F.desc("end"), "name")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = every.withColumn("reach", reach).where("reach is null or start >= reach")
    last = F.lag("end", 1, 0).over(order)
    pieces = apart.withColumn("from", last).groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "from", "name"))).alias("_spans")
    )
    pieces = pieces.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    on = docs[key].cast("long").eqNullSafe(F.col("_id")) & (
        F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_hash")
    )
    kept = F.transform(
        "_spans",
        lambda s: F.concat(
            F.substring(F.col("text"), s["from"].cast("int") + 1, (s["start"] - s["from"]).cast("int")),
            F.concat(F.lit("<"), F.upper(s["name"]), F.lit(">")),
        ),
    )
    tail = F.substring(
        F.col("text"),
        F.element_at("_spans", -1)["end"].cast("int") + 1,
        F.length("text"),
    )
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(
        F.concat(F.array_join(kept, ""), tail)
    )
    redacted = docs.join(pieces, on, "left").withColumn("text", text).select(*docs.columns)
    return redacted.withColumnsRenamed(back)
