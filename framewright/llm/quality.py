"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule compares one ratio of a text with a cutoff. Every stratum has a path of rule vectors from lax to strict, ordered on
bad and unlabelled texts. On good labelled texts the exact (Clopper-Pearson) upper bound of the whole verdict's
false-rejection rate, all rules of a vector together, is tested step by step; the last proven step is used. Testing
fixed sequences and sharing delta among the strata make the bound alpha hold in all strata at once with probability 1 - delta.
A stratum with too few labels to prove any step gets none, so nothing there is rejected by the method.

Defined results: null text counts as empty (no words, base_failed); texts whose stratum is null form the stratum '';
repeated rows are judged alike; an id that is labelled twice counts by its best label; null ids are never labelled;
unlabelled tables give no cutoffs; an empty table gives an empty result; texts of any length are measured whole; columns
other than doc_id, text, lang and quality are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
GRAM = 5

#: Rule -> (ratio's name, whether large values are bad, cutoffs from strict to lax).
RULES: dict[str, tuple[bool, tuple[float, ...]]] = {
    "symbols": (True, (0.02, 0.04, 0.06, 0.09, 0.13, 0.2, 0.3, 0.45)),
    "upper": (True, (0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75, 0.9)),
    "bangs": (True, (0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0, 1.5)),
    "dup_lines": (True, (0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.7)),
    "repeats": (True, (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18)),
    "long_words": (True, (7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0)),
    "short_words": (False, (5.0, 4.5, 4.0, 3.5, 3.0, 2.5, 2.0, 1.5)),
}


def covered_words(words: Column) -> Column:
    """Words within GRAM-word windows that occur twice or more, the first occurrence included."""

    def windows(h: Column) -> Column:
        n = F.size(h)
        gram = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(GRAM)])
        return F.when(n >= GRAM, F.transform(F.sequence(F.lit(0), n - GRAM), gram)).otherwise(F.array().cast("array<bigint>"))

    def positions(s: Column) -> Column:
        same = lambda x, i: F.coalesce(F.get(s, i)["g"] == x["g"], F.lit(False))
        found = F.filter(s, lambda x, i: ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))) | same(x, i + 1))
        return F.sort_array(F.transform(found, lambda x: x["p"]))

    def span(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.lit(GRAM), F.coalesce(F.get(p, i + 1) - x, F.lit(GRAM))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(let(let(pairs, positions), span))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the struct column _q: counts of each whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    gone = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("bigint")
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("bigint").alias("n_words"), covered_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))

    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    return docs.withColumns({"_w": let(words, of_words), "_l": let(lines, of_lines)}).withColumn(
        "_q",
        F.struct(
            "_w.*", "_l.*", (F.length(t) - gone(SPACE)).cast("bigint").alias("word_chars"), gone("#*$%&|<>").alias("n_symbols"), gone(UPPER).alias("n_upper"), gone("!").alias("n_bangs"),
        ),
    ).drop("_w", "_l")


def ratios(q: Column) -> dict[str, Column]:
    per = lambda a, b: q[a].cast("double") / F.greatest(q[b], F.lit(1)).cast("double")
    size = per("word_chars", "n_words")
    return {
        "symbols": per("n_symbols", "word_chars"), "upper": per("n_upper", "word_chars"), "bangs": per("n_bangs", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"), "repeats": per("n_repeat_words", "n_words"), "long_words": size, "short_words": size,
    }


def fails(ratio: Column, large_is_bad: bool, cutoff: Column) -> Column:
    return ratio > cutoff if large_is_bad else ratio < cutoff


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 10) | (100 * q["n_repeat_words"] > 20 * q["n_words"])


#: (rule, cutoff, whether large values are bad), rule by rule from strict to lax.
TESTS = tuple((rule, c, large) for rule, (large, cuts) in RULES.items() for c in cuts)
#: Strata up to which their paths are broadcast (a row is under 1 KB); above, they are joined by shuffle.
BROADCAST_STRATA = 10_000


def proven(k: Column, n: Column, alpha: float, level: Column) -> Column:
    """Whether k rejections of n good texts prove a rate within alpha: P(X <= k | n, alpha) <= level, which says that the
    exact upper bound of Clopper and Pearson at confidence 1 - level is alpha at most. The sum runs down from its largest term."""
    odds = math.log(alpha) - math.log1p(-alpha)
    start = F.struct(F.lit(0.0).alias("lc"), F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * (k - i + 1) / (n - k + i) * math.exp(-odds)
        return F.struct((a["lc"] + F.log((n - k + i) / i)).alias("lc"), term.alias("term"), (a["sum"] + term).alias("sum"))

    terms = F.when(k == 0, start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), start, step))
    tail = let(terms, lambda t: t["lc"] + F.log(t["sum"]) + n * math.log1p(-alpha) + k * odds)
    return F.when((n == 0) | (k > alpha * n), False).otherwise(tail <= F.log(level))


def first_step(q: Column, place: Column) -> Column:
    """The first step of a path (place: each test's step) that rejects a text; null if none does."""
    r = ratios(q)
    return F.least(*[F.when(fails(r[rule], large, F.lit(c)), F.get(place, F.lit(i))) for i, (rule, c, large) in enumerate(TESTS)])


def paths(rows: DataFrame) -> DataFrame:
    """s, variant, share, place: each stratum's paths from lax to strict, a step a test. Steps are ordered by how many
    unlabelled texts a test rejects for each bad one, so good labels, on which the steps are tested, have no part in it; tests that
    reject no bad text are in no path (null). The first path has all rules and half of the stratum's level; each other
    one leaves a rule out, so that a rule that rejects good texts doesn't stop the others."""
    r = ratios(F.col("_q"))
    hit = [fails(r[rule], large, F.lit(c)) for rule, c, large in TESTS]
    bad, free = F.col("_good") == 0, F.col("_good").isNull()
    counts = rows.groupBy("s").agg(F.array(*[F.count_if(bad & h) for h in hit]).alias("b"), F.array(*[F.count_if(free & h) for h in hit]).alias("f"))
    each = F.transform(F.col("b"), lambda b, i: F.struct((F.get("f", i) / F.greatest(b, F.lit(1))).alias("ratio"), (-b).alias("b"), i.alias("i")))
    order = F.transform(F.array_sort(F.filter(each, lambda x: x["b"] < 0)), lambda x: x["i"])

    def without(o: Column, gone: list[int]) -> Column:
        return F.filter(o, lambda i: ~i.isin(gone))

    def variants(o: Column) -> Column:
        out = []
        for v, rule in enumerate([None, *RULES]):
            own = [i for i, t in enumerate(TESTS) if t[0] == rule]
            kept = without(o, own) if rule else o
            place = let(kept, lambda p: F.transform(F.sequence(F.lit(0), F.lit(len(TESTS) - 1)), lambda i: F.nullif(F.array_position(p, i), F.lit(0))))
            out.append(F.struct(F.lit(v).alias("variant"), F.lit(0.5 / len(RULES) if rule else 0.5).alias("share"), place.alias("place")))
        return F.array(*out)

    return counts.select("s", F.inline(let(order, variants)))


def fit(rows: DataFrame, alpha: float, delta: float) -> DataFrame:
    """s, place, last: for each stratum a path and the last step that may reject. rows: s, _q, _good (null: unlabelled),
    without those that fail the base rules.

    A path's steps reject nested sets. They are tested in order, on good texts, each at the path's whole level, until one isn't
    proven (a fixed sequence needs no correction for its steps); delta is shared among the strata and their paths. So with
    probability 1 - delta all proven steps of all paths in all strata reject, all rules together, a share of good texts
    within alpha. Of a stratum's paths the one is used that rejects most bad texts."""
    steps = cut(paths(rows))
    at = F.coalesce(first_step(F.col("_q"), F.col("place")), F.lit(len(TESTS) + 1))
    known = rows.where("_good is not null").join(shared(steps), "s").select("s", "variant", "share", "_good", at.alias("at"))
    counts = cut(known.groupBy("s", "variant", "share", "_good", "at").agg(F.count(F.lit(1)).alias("c")))
    good = counts.where("_good = 1")
    level = delta / max(1, good.select("s").distinct().count())
    w = Window.partitionBy("s", "variant")
    running = good.select("s", "variant", F.col("share") * level, "at", F.sum("c").over(w).alias("n"), F.sum("c").over(w.orderBy("at")).alias("k")).toDF("s", "variant", "level", "at", "n", "k")
    ok, none = (proven(k, F.col("n"), alpha, F.col("level")) for k in (F.col("k"), F.lit(0).cast("bigint")))
    ends = running.groupBy("s", "variant").agg(F.min(F.when(~ok, F.col("at"))).alias("stop"), F.bool_and(none).alias("any"))
    last = ends.select("s", "variant", F.when(F.col("any"), F.coalesce(F.col("stop") - 1, F.lit(len(TESTS)))).otherwise(0).alias("last"))
    gains = last.join(counts.where("_good = 0"), ["s", "variant"], "left").groupBy("s", "variant", "last").agg(F.sum(F.when(F.col("at") <= F.col("last"), F.col("c")).otherwise(0)).alias("gain"))
    best = gains.groupBy("s").agg(F.max(F.struct("gain", (-F.col("variant")).alias("v"), "last")).alias("x"))
    chosen = best.select("s", (-F.col("x.v")).alias("variant"), "x.last")
    return steps.join(chosen, ["s", "variant"]).select("s", "place", "last")


def shared(strata: DataFrame) -> DataFrame:
    """Broadcast if there are few."""
    return F.broadcast(strata) if strata.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA else strata


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """docs (doc_id, text, lang) judged by rules calibrated on labels (doc_id, quality).

    Every text is measured once; its counts (a few numbers a document) are written to the shared folder, and both
    calibration and verdicts read them, so no text is shuffled."""
    q = F.col("_q")
    own = cut(measured(docs.select("doc_id", "text", "lang")).select("doc_id", F.coalesce("lang", F.lit("")).alias("s"), "_q"))
    marks = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_good"))
    strata = cut(fit(own.where(~base_failed(q)).join(marks, "doc_id", "left"), alpha, delta))
    judged = own.join(shared(strata), "s", "left")
    keep = ~base_failed(q) & ~F.coalesce(first_step(q, F.col("place")) <= F.col("last"), F.lit(False))
    return judged.select(
        "doc_id", q["n_words"].alias("n_words"), q["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["n_dup_lines"].alias("n_dup_lines"),
        q["n_repeat_words"].alias("n_repeat_words"), base_failed(q).alias("base_failed"), keep.alias("kept"),
    )
