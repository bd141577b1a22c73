"""Next-event models whose heads see different features.

The heads (activity, role, times) count contexts of their own: the last k activities,
roles or both, and beside them the size of the last times and the clock of the last
event, whichever groups the model's specification routes to the head. A head looks up the
longest context that the training part supports; of one length, the one with the features
beside it comes first.

Rows are counted once by all that any head may see; every head's contexts of every length
are rolled up from those counts. A search over configurations numbers the contexts' kinds
(``Family``) and packs what they hold into whole numbers, so heads, lengths and shares of
the cases have their counts and medians from one pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.draws import uniform
from logloom.functions.scaling import fit_scalers
from logloom.operators import positions, resolution
from logloom.operators.positions import grouped_medians, hot_counted, hot_medians
from logloom.plans.specs import ACTIVITIES, CONTEXT, ROLES, TIMES
from logloom.runtime import pin, shuffled

CATEGORIES = {ACTIVITIES: "ac_index_prefix", ROLES: "rl_index_prefix"}
# Floor of a predicted probability, as in the usual cross-entropy.
EPSILON = 1e-7
SEEN = ["ac_index_prefix", "rl_index_prefix", "_times", "_clock"]


@dataclass(frozen=True)
class RoutedModel:
    """``choices``: head, level, ctx, next; ``times``: level, ctx and a column for each time."""

    choices: DataFrame
    times: DataFrame
    heads: dict[str, tuple[str, ...]]
    n: int
    names: tuple[str, ...]


def with_sides(samples: DataFrame, times: list[str]) -> DataFrame:
    """Adds what a head may see beside categories: sizes of the last times, and the clock.

    The size of a time is the number of binary digits of its whole seconds.
    """
    sides = _sides(samples, times)
    return samples.withColumns({c: F.concat_ws(":", *[p.cast("string") for p in parts]) for c, parts in sides.items()})


def _sides(samples: DataFrame, times: list[str]) -> dict[str, list[Column]]:
    """The whole numbers that ``_times`` and ``_clock`` consist of."""
    last = lambda c: F.element_at(F.col(f"{c}_prefix"), -1)
    digits = [F.length(F.bin(F.floor(last(t)).cast("bigint"))) for t in times]
    if "daytime_prefix" in samples.columns:
        seconds = last("daytime")
    else:
        seconds = F.round(last("daytime_norm") * 86400)
    return {"_times": digits, "_clock": [F.floor(seconds / 3600).cast("int"), last("weekday")]}


def contexts(groups: tuple[str, ...], n: int) -> list[Column]:
    """(level, ctx) of a head from the shortest on: 2k is the last k categories, 2k + 1
    those and what is seen beside them."""
    seen = [F.col(c).cast("array<string>") for g, c in CATEGORIES.items() if g in groups]
    beside = [F.col(c) for g, c in ((TIMES, "_times"), (CONTEXT, "_clock")) if g in groups]
    if len(seen) == 2:
        seen = [F.zip_with(*seen, lambda a, r: F.concat_ws(":", a, r))]
    out = []
    for k in range(n + 1 if seen else 1):
        ctx = F.array_join(F.slice(seen[0], -k, k), ",") if k else F.lit("")
        out.append(F.struct(F.lit(2 * k).alias("level"), ctx.alias("ctx")))
        if beside:
            whole = F.concat_ws("|", ctx, *beside)
            out.append(F.struct(F.lit(2 * k + 1).alias("level"), whole.alias("ctx")))
    return out


def fit_routed(
    samples: DataFrame, heads: dict, n: int, end: int, times: list[str], min_support: int = 1
) -> RoutedModel:
    """Fits on training samples of ``ac_index``, ``rl_index``, the times and the clock."""
    labels = {"ac": "ac_index_next", "rl": "rl_index_next"}
    samples = pin(with_sides(samples, times).select(*SEEN, *labels.values(), *[f"{t}_next" for t in times]))
    counted = samples.groupBy(*SEEN, *labels.values()).agg(F.count(F.lit(1)).alias("n"))
    each = [
        F.struct(F.lit(head).alias("head"), c["level"].alias("level"), c["ctx"].alias("ctx"), F.col(label).alias("next"))
        for head, label in labels.items()
        for c in contexts(heads[head], n)
    ]
    counts = counted.select("n", F.explode(F.array(*each)).alias("c"))
    counts = counts.groupBy("c.head", "c.level", "c.ctx", "c.next").agg(F.sum("n").alias("n"))
    best = F.max_by("next", F.struct("n", -F.col("next"))).alias("next")
    choices = counts.groupBy("head", "level", "ctx").agg(F.sum("n").alias("total"), best)
    supported = (F.col("total") >= min_support) | (F.col("level") == 0)
    # the end of a case has no times
    events = samples.where(F.col("ac_index_next") != end)
    rows = events.select(F.explode(F.array(*contexts(heads["time"], n))).alias("c"), *[F.col(f"{t}_next").alias(t) for t in times])
    rows = pin(rows.select("c.level", "c.ctx", *times))
    medians = grouped_medians(rows, ["level", "ctx"], times, size="total")
    return RoutedModel(
        pin(choices.where(supported).drop("total")),
        pin(medians.where(supported).drop("total")),
        heads, n, tuple(times),
    )


def predict_routed(samples: DataFrame, model: RoutedModel) -> DataFrame:
    """Adds ``ac_pred``, ``rl_pred`` and ``<time>_pred`` to the samples.

    What heads see repeats far more often than it differs: it is looked up once for each
    distinct combination.
    """
    samples = with_sides(samples, list(model.names))
    seen = pin(samples.select(*SEEN).distinct())

    def deepest(head: str, table: DataFrame, values: list[str]) -> DataFrame:
        asked = seen.select(*SEEN, F.explode(F.array(*contexts(model.heads[head], model.n))).alias("c"))
        asked = asked.select(*SEEN, "c.level", "c.ctx").join(shuffled(table), ["level", "ctx"])
        found = asked.groupBy(*SEEN).agg(F.max_by(F.struct(*values), "level").alias("_found"))
        names = [f"{head}_pred"] if head != "time" else [f"{t}_pred" for t in values]
        return found.select(*SEEN, *[F.col(f"_found.{v}").alias(name) for v, name in zip(values, names)])

    known = seen
    for head in ("ac", "rl"):
        own = model.choices.where(F.col("head") == head)
        known = known.join(shuffled(deepest(head, own, ["next"])), SEEN)
    known = known.join(shuffled(deepest("time", model.times, list(model.names))), SEEN, "left")
    return samples.join(shuffled(pin(known)), SEEN).drop("_times", "_clock")


def _routes(heads_of: dict[str, dict], head: str) -> dict[tuple[str, ...], int]:
    """A number for each set of features that some model type gives to the head."""
    sets = sorted({heads[head] for heads in heads_of.values()})
    return {groups: i for i, groups in enumerate(sets)}


@dataclass(frozen=True)
class Family:
    """A kind of contexts: the last ``k`` of the categories, and the columns seen beside them."""

    categories: tuple[str, ...]
    k: int
    beside: tuple[str, ...]


def families(groups: tuple[str, ...], n: int) -> list[tuple[int, Family]]:
    """(level, family) of a head from the shortest on, as ``contexts`` has them."""
    seen = tuple(c for g, c in CATEGORIES.items() if g in groups)
    beside = tuple(c for g, c in ((TIMES, "_times"), (CONTEXT, "_clock")) if g in groups)
    out = []
    for k in range(n + 1 if seen else 1):
        own = seen if k else ()
        out.append((2 * k, Family(own, k, ())))
        if beside:
            out.append((2 * k + 1, Family(own, k, beside)))
    return out


# Parts of a time's size or of the clock are below this number.
SIDE_BASE = 1 << 20


def _packed(parts: list[Column]) -> Column:
    """One whole number for what ``with_sides`` joins; NULL is left out as it is there."""
    out = F.lit(0).cast("bigint")
    for part in parts:
        out = F.when(part.isNull(), out).otherwise(out * SIDE_BASE + part + 1)
    return out


@dataclass(frozen=True)
class Windows:
    """The last ``top`` codes of each category, packed into as many BIGINTs as they need.

    ``bases``: codes and NULL of a category are fewer than this.
    """

    bases: dict[str, int]
    top: int

    @classmethod
    def of(cls, parts: list[DataFrame], top: int) -> Windows:
        most = [F.max(F.array_max(c)).alias(c) for c in CATEGORIES.values()]
        found = [df.agg(*most).first() for df in parts]
        return cls({c: max(2, *[(r[c] or 0) + 2 for r in found]) for c in CATEGORIES.values()}, top)

    def _runs(self, category: str) -> list[tuple[int, int]]:
        """(first, codes) of each BIGINT, counted from the last code on."""
        per = 1
        while self.bases[category] ** (per + 1) < 1 << 63:
            per += 1
        return [(i, min(per, self.top - i)) for i in range(0, self.top, per)]

    @property
    def names(self) -> list[str]:
        words = [f"{c}_{i}" for c in CATEGORIES.values() for i, _ in self._runs(c)]
        return [*words, "_times", "_clock"]

    def words(self) -> list[Column]:
        out = []
        for c in CATEGORIES.values():
            for first, codes in self._runs(c):
                word = F.lit(0).cast("bigint")
                for i in range(first + codes, first, -1):
                    word = word * self.bases[c] + F.coalesce(F.element_at(c, -i), F.lit(-1)) + 1
                out.append(word.alias(f"{c}_{first}"))
        return [*out, F.col("_times"), F.col("_clock")]

    def context(self, family: Family, number: int) -> Column:
        """What a context of the family holds of the words; the rest is 0."""
        none, out = F.lit(0).cast("bigint"), [F.lit(number).alias("family")]
        for c in CATEGORIES.values():
            for first, codes in self._runs(c):
                name, held = f"{c}_{first}", family.k - first if c in family.categories else 0
                kept = F.col(name) % F.lit(self.bases[c] ** held).cast("bigint") if 0 < held < codes else F.col(name)
                out.append((kept if held > 0 else none).alias(name))
        out += [(F.col(c) if c in family.beside else none).alias(c) for c in ("_times", "_clock")]
        return F.struct(*out)

    def each(self, numbers: dict[Family, int]) -> Column:
        return F.explode(F.array(*[self.context(f, i) for f, i in numbers.items()])).alias("c")


def _losses(train, valid, wanted, heads_of, end, times, rungs: int) -> DataFrame:
    """(rung, model_type, n_size, norm_method, loss) of the wanted configurations in each rung.

    Bit k of ``_rungs`` tells whether rung k learns from a training sample.
    """
    spark = train.sparkSession
    sizes, methods = sorted({r["n_size"] for r in wanted}), sorted({r["norm_method"] for r in wanted})
    heads_of = {t: heads_of[t] for t in {r["model_type"] for r in wanted}}
    routes = {head: _routes(heads_of, head) for head in ("ac", "rl", "time")}
    labels = {"ac": "ac_index_next", "rl": "rl_index_next"}
    nexts, all_rungs = [f"{t}_next" for t in times], range(rungs)

    def pinned(samples, *more):
        sides = {c: _packed(parts) for c, parts in _sides(samples, times).items()}
        return pin(samples.withColumns(sides).select(*SEEN, *labels.values(), *nexts, *more))

    train, valid = pinned(train, "_rungs"), pinned(valid)
    windows = Windows.of([train, valid], sizes[-1])
    train, valid = (
        x.select(*windows.words(), *[c for c in x.columns if c not in SEEN]) for x in (train, valid)
    )
    chains = {head: [families(groups, sizes[-1]) for groups in routes[head]] for head in routes}
    numbers = {f: i for i, f in enumerate(dict.fromkeys(f for x in chains.values() for c in x for _, f in c))}
    used = {head: {f: numbers[f] for c in x for _, f in c} for head, x in chains.items()}
    chains = {head: [[(level, numbers[f]) for level, f in c] for c in x] for head, x in chains.items()}
    context = ["family", *windows.names]
    learned = [F.col("_rungs").bitwiseAND(1 << k).cast("boolean").cast("bigint").alias(f"n_{k}") for k in all_rungs]
    sums = [F.sum(c).alias(c) for c in (*[f"n_{k}" for k in all_rungs], "asked")]

    def counted(head, numbers):
        """Training samples of each context and label by rung, and the validation samples."""
        rows = train.select(*windows.names, F.col(labels[head]).alias("next"), *learned, F.lit(0).alias("asked"))
        none = [F.lit(0).alias(f"n_{k}") for k in all_rungs]
        rows = rows.unionByName(valid.select(*windows.names, F.col(labels[head]).alias("next"), *none, F.lit(1).alias("asked")))
        cells = rows.groupBy(*windows.names, "next").agg(*sums)
        each = cells.select(windows.each(numbers), "next", *[f"n_{k}" for k in all_rungs], "asked")
        return pin(each.select("c.*", *each.columns[1:]).groupBy(*context, "next").agg(*sums))

    def asked(head, by):
        """Every context of the head for each distinct validation sample."""
        units = valid.groupBy(*windows.names, *by).agg(F.count(F.lit(1)).alias("w"))
        units = pin(units.withColumn("unit", F.monotonically_increasing_id()))
        rows = units.select(windows.each(used[head]), "unit", "w", *[c for c in by])
        return rows.select("c.*", "unit", "w", *by)

    def summed(found, run):
        ordered = found.repartition("unit").sortWithinPartitions("unit")
        parts = pin(ordered.mapInArrow(run, resolution.SUMS))
        return parts.groupBy("rung", "route", "n_size", "part").agg(F.sum("total").alias("total"), F.sum("w").alias("w")).collect()

    ce, counts = {}, {h: counted(h, used[h] | (used["time"] if h == "ac" else {})) for h in labels}
    for head, label in labels.items():
        of_context = W.partitionBy(*context)
        totals = {f"total_{k}": F.sum(f"n_{k}").over(of_context) for k in all_rungs}
        table = counts[head].where(F.col("family").isin(list(used[head].values()))).withColumns(totals).where("asked > 0")
        # a label that the context was never followed by has the least probability
        p = [F.greatest(F.col(f"n_{k}") / F.col(f"total_{k}"), F.lit(EPSILON)) for k in all_rungs]
        p = [F.when(F.col(f"total_{k}") > 0, -F.log(x)).alias(f"ce_{k}") for k, x in zip(all_rungs, p)]
        table = table.select(*context, F.col("next").alias(label), *p).where(
            F.coalesce(*[f"ce_{k}" for k in all_rungs]).isNotNull()
        )
        found = asked(head, [label]).join(shuffled(table), [*context, label])
        found = found.select("unit", "family", "w", *[f"ce_{k}" for k in all_rungs])
        for r in summed(found, resolution.entropies(chains[head], len(numbers), sizes, rungs)):
            ce[head, r["rung"], r["route"], r["n_size"]] = r["total"] / r["w"]
    events = train.where(F.col(labels["ac"]) != end)
    fits = {f"{t}|{k}|{m}": (t, k, m) for t in times for k in all_rungs for m in methods}
    own = [F.when(F.col("_rungs").bitwiseAND(1 << k) != 0, F.col(f"{t}_next")).alias(c) for c, (t, k, _) in fits.items()]
    args = fit_scalers(events.select(*own), {c: m for c, (_, _, m) in fits.items()})
    args = {key: args[c] for c, key in fits.items()}
    counts = counts["ac"].where(F.col("family").isin(list(used["time"].values())))
    medians = _rung_medians(events, windows, used["time"], counts, end, times, rungs)
    closing = valid.withColumn("closing", F.col(labels["ac"]) == end)
    valid = closing.select(*windows.names, "closing", *[F.when(~F.col("closing"), F.col(c)).alias(c) for c in nexts])
    found = asked("time", ["closing", *nexts]).join(shuffled(medians), context).drop(*windows.names)
    mae = {}
    for r in summed(found, resolution.errors(chains["time"], len(numbers), sizes, rungs, times, methods, args)):
        mae[r["rung"], r["route"], r["n_size"], methods[r["part"]]] = r["total"] / r["w"] if r["w"] else None
    out = []
    for k in all_rungs:
        for r in wanted:
            heads, n = heads_of[r["model_type"]], r["n_size"]
            ac, rl, time = (routes[h][heads[h]] for h in ("ac", "rl", "time"))
            at = (k, time, n, r["norm_method"])
            if ("ac", k, ac, n) in ce and ("rl", k, rl, n) in ce and at in mae:
                loss = None if mae[at] is None else ce["ac", k, ac, n] + ce["rl", k, rl, n] + mae[at]
                out.append((k, r["model_type"], n, r["norm_method"], loss))
    return spark.createDataFrame(out, "rung int, model_type string, n_size bigint, norm_method string, loss double")


def _rung_medians(events, windows, numbers, counts, end, times, rungs: int) -> DataFrame:
    """Per asked context and rung: the number of events ``n_<rung>`` and the median ``<time>_<rung>``.

    ``counts`` has the events of each context and label by rung. Contexts that no validation
    sample asks for are left out, ordinary ones are read in a stream of whole contexts.
    """
    context, names = ["family", *windows.names], [f"n_{k}" for k in range(rungs)]
    group, most = F.xxhash64(*context).alias("_group"), F.greatest(*names, F.lit(0))
    # of a large context's labels one at least is large
    some = [r["_group"] for r in counts.where(most * end > positions.HOT_ROWS).select(group).distinct().collect()]
    whole = counts.where(group.isin(some)).groupBy(*context).agg(F.sum(most).alias("rows"))
    hot = hot_counted(whole, context, "rows") if some else []
    nexts = [F.col(f"{t}_next").alias(t) for t in times]
    rows = events.select(windows.each(numbers), "_rungs", *nexts).select("c.*", "_rungs", *times).withColumn("_group", group)
    asked = counts.where("asked > 0").select(group).distinct()
    plain, wanted = rows, shuffled(asked)
    if hot:
        plain, wanted = plain.where(~F.col("_group").isin(hot)), shuffled(asked.where(~F.col("_group").isin(hot)))
    # dealt again after the join, which may split a large partition
    plain = plain.join(wanted, "_group", "left_semi").repartition("_group").sortWithinPartitions("_group")
    kinds = dict(rows.dtypes)
    schema = [f"{c} {kinds[c]}" for c in context]
    for k in range(rungs):
        schema += [f"n_{k} bigint", *[f"{t}_{k} double" for t in times]]
    found = plain.mapInArrow(resolution.medians(context, times, rungs), ", ".join(schema))
    if not hot:
        return pin(found)
    large = asked.where(F.col("_group").isin(hot)).collect()  # of the large ones
    large = rows.where(F.col("_group").isin([r["_group"] for r in large])).drop("_group")
    bits = [F.getbit("_rungs", F.lit(k)).cast("bigint") for k in range(rungs)]
    return pin(found.unionByName(hot_medians(large, context, times, bits)))


def routed_losses(
    train: DataFrame,
    valid: DataFrame,
    configs: DataFrame,
    heads_of: dict[str, dict],
    end: int,
    times: list[str],
) -> DataFrame:
    """``configs`` (model_type, n_size, norm_method) with the validation ``loss`` of each.

    All configurations share one scan of either part: model types that give a head the
    same features share its counts, a shorter ``n_size`` looks up shorter contexts, and
    scales apply to the same times. The loss is the cross-entropy of activity and role
    plus the mean absolute error of the scaled times.
    """
    wanted = configs.select("model_type", "n_size", "norm_method").collect()  # a handful
    losses = _losses(train.withColumn("_rungs", F.lit(1)), valid, wanted, heads_of, end, times, 1)
    return configs.join(losses.drop("rung"), ["model_type", "n_size", "norm_method"]).select(*configs.columns, "loss")


def successive_halving(
    train: DataFrame,
    valid: DataFrame,
    configs: DataFrame,
    heads_of: dict[str, dict],
    end: int,
    times: list[str],
    shares: tuple[float, ...] = (0.25, 0.5, 1.0),
    seed: int = 0,
) -> DataFrame:
    """(rung, model_type, n_size, norm_method, loss): each rung learns from a larger share.

    The better half of a rung's configurations, rounded up, goes on to the next; ties are
    in the order of the configuration. ``train`` has ``caseid``; a case that one rung
    learns from is in all later ones. The rungs' counts and medians come from one pass.
    """
    names = ["model_type", "n_size", "norm_method"]
    drawn = uniform(F.lit("rung"), F.col("caseid"), str(seed))
    bits = [F.when(drawn < share, F.lit(1 << k)).otherwise(F.lit(0)) for k, share in enumerate(shares)]
    train = train.withColumn("_rungs", sum(bits, F.lit(0))).where("_rungs > 0")
    wanted = configs.select(*names).collect()  # a handful
    losses = pin(_losses(train, valid, wanted, heads_of, end, times, len(shares)))
    rungs = []
    for k in range(len(shares)):
        own = pin(configs.join(losses.where(F.col("rung") == k), names).select("rung", *names, "loss"))
        rungs.append(own)
        configs = pin(own.orderBy("loss", *names).limit(-(-own.count() // 2)).select(*names))
    out = rungs[0]
    for more in rungs[1:]:
        out = out.unionByName(more)
    return out
