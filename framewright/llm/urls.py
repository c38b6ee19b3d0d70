"""URL filtering by rules, and beyond them by a ratio of character language models.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, give each character of a URL a
probability from its ORDER preceding characters; orders are interpolated by Witten-Bell weights. The difference
of log-likelihoods, divided by the length, is compared with a threshold calibrated on accepted URLs of hosts kept from the
counts, such that a share FALSE_BLOCKS of them at most would be blocked.

URLs to learn from are labelled by two kinds of evidence. `page_label`: visible text of the page (where the table has it) that
is dense with seed words rejects its URL, whatever its host is called; `spam_label`: so does a host that has a seed word.
URLs that neither clearly rejects nor clears teach neither model. The models generalise from these URLs' characters to hosts
without a seed word. A gram is a character with its ORDER preceding
ones. Counts by exact gram are a distributed table with a row per gram of any URL, so the models grow with the
input; shorter contexts are sums over it. A gram's log-ratio joins the URLs that hold it: the HOT commonest at most
from a broadcast, the others by a shuffle. Log-ratios are summed as integers, so sums don't depend on row order.
The threshold is an exact quantile over all URLs of the hosts kept from the counts.

Defined results: null urls and such without '://' have empty host and path, no rule, and are allowed. Without
rejected URLs to learn from, everything beyond the rules is allowed. Repeated rows get equal results; a URL whose pages
differ counts as rejected if one of them is. A null page, where there are pages, clears no URL. URLs and pages of any length are read whole; an empty
table gives an empty result; columns other than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, prepare

ORDER = 5
FALSE_BLOCKS = 0.001
#: Log-ratios are summed in these fractions.
UNIT = 1 << 30
#: Grams that are broadcast at most; urls whose rows the last join deals over SALTS keys at most. No result depends on them.
HOT, HOT_URLS, SALTS = 20_000, 1000, 64
#: Rows of counts that a task holds before it passes them on, and scores of one bin that reach the driver.
HELD, BIN = 500_000, 4096
#: (rule, verdict): a host and all its subdomains, then the start of a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Stems of words that mark a rejected host, and the endings they may have.
SEEDS = (
    "ad", "adult", "advert", "affiliate", "bet", "betting", "bingo", "casino", "cialis", "clickbait", "escort", "fake", "gambl", "jackpot", "loan", "lotter", "lotto", "malware", "nude", "payday", "phish", "pill", "poker",
    "popup", "porn", "porno", "replica", "roulette", "scam", "sex", "slot", "spam", "spyware", "sweepstake", "track", "viagra", "wager", "warez", "xxx",
)
ENDINGS = ("", "e", "y", "s", "es", "ies", "er", "ers", "ed", "ing", "ising", "izing", "mer", "mers", "ming")
#: Stems of this length and longer make a host unclear wherever they stand in it, shorter ones at the start of a word.
WITHIN = 3
#: A seed stem with an ending, as a word of its own.
CERTAIN = rf"(?<!\p{{L}})({'|'.join(SEEDS)})({'|'.join(ENDINGS)})(?!\p{{L}})"
#: Shares of seed words in a page's visible words.
DENSE, THIN = 0.02, 0.005
#: One of so many hosts, by hash, is kept from the counts, with all its URLs.
KEPT = 10


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without '://'."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """Struct rule, verdict of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        h, p = rule.split("/", 1)
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def spam_label(host: Column) -> Column:
    """1 where a word of the host (a run of letters) is a seed stem with an ending; null, so learnt from by neither
    model, where a stem stands in it otherwise; else 0."""
    unclear = rf"({'|'.join(s for s in SEEDS if len(s) >= WITHIN)})|(?<!\p{{L}})({'|'.join(s for s in SEEDS if len(s) < WITHIN)})"
    return F.when(host.rlike(CERTAIN), 1).when(~host.rlike(unclear), 0)


def page_label(html: Column) -> Column:
    """1 where seed words (with an ending) are DENSE among a page's visible words, 0 where they are below THIN, else null, as for no page."""
    visible = F.regexp_replace(F.lower(html), r"(?s)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>", " ")

    def judged(t: Column) -> Column:
        hits = F.regexp_count(t, F.lit(CERTAIN))
        share = hits / F.greatest(F.size(F.split(t, r"\s+")), F.lit(1))
        return F.when((hits >= 3) & (share >= DENSE), 1).when(share < THIN, 0)

    return F.when(html.isNotNull(), let(visible, judged))


def label_of(host: Column, html: Column | None) -> Column:
    """1 where host or page is clearly rejected, 0 where both are clear, else null."""
    by_host = spam_label(host)
    if html is None:
        return by_host
    return let(page_label(html), lambda page: F.when((by_host == 1) | (page == 1), 1).when((by_host == 0) & (page == 0), 0))


def grams(text: str) -> Counter[str]:
    """Counts of the characters of text, each after its ORDER preceding ones (zeros before the start)."""
    padded = "\0" * ORDER + text
    return Counter(padded[i : i + ORDER + 1] for i in range(len(text)))


def counted(texts: DataFrame) -> DataFrame:
    """g, n0, n1 for every gram of texts (_t, n rows, label y or null, kept): its counts among accepted and
    rejected rows that aren't kept from the counts, so 0 where only others hold it; m, how many texts hold it."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[int]] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(g, *v) for g, v in held.items()], columns=["g", "n0", "n1", "m"])

        for f in frames:
            for t, n, y, kept in zip(f["_t"], f["n"].tolist(), f["y"].tolist(), f["kept"], strict=True):
                a, b = (0 if kept or y != v else n for v in (0, 1))
                for g, c in grams(t).items():
                    v = held.setdefault(g, [0, 0, 0])
                    v[0] += a * c
                    v[1] += b * c
                    v[2] += 1
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    return texts.select("_t", "n", "y", "kept").mapInPandas(batches, "g string, n0 bigint, n1 bigint, m bigint").groupBy("g").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "m")])


def ratios(counts: DataFrame) -> DataFrame:
    """g, v: log p(rejected) - log p(accepted) of each gram's last character, in UNITs. From order 0 up, the
    distribution of an order is mixed with the one below by Witten-Bell weights."""
    levels = [counts.select("g", "n0", "n1")]
    for k in range(ORDER, 0, -1):
        levels.insert(0, cut(levels[0].select(F.substring("g", 2, k).alias("g"), "n0", "n1").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))))
    p = None
    for k, level in enumerate(levels):
        context = level.withColumn("c", F.substring("g", 1, k)).groupBy("c").agg(
            F.sum("n0").alias("all0"), F.sum("n1").alias("all1"), F.count_if(F.col("n0") > 0).alias("t0"), F.count_if(F.col("n1") > 0).alias("t1"),
        )
        rows = level.withColumn("c", F.substring("g", 1, k)).join(context, "c")
        rows = rows.join(p.withColumnRenamed("g", "b"), F.substring("g", 2, k) == F.col("b")) if p is not None else rows.withColumns({"p0": F.lit(1 / 256), "p1": F.lit(1 / 256)})
        mixed = [F.when(F.col(f"all{y}") > 0, (F.col(f"n{y}") + F.col(f"t{y}") * F.col(f"p{y}")) / (F.col(f"all{y}") + F.col(f"t{y}"))).otherwise(F.col(f"p{y}")).alias(f"p{y}") for y in (0, 1)]
        p = rows.select("g", *mixed)
    return p.select("g", F.round((F.log("p1") - F.log("p0")) * UNIT).cast("bigint").alias("v"))


def at_ranks(values: DataFrame, ranks: list[int]) -> list[float]:
    """The values at these places (from 0) of the sorted rows of values (v, n times). Histograms are taken on the
    executors, each within the bin that the one before found, until a bin has few values."""
    found = []
    for rank in ranks:
        rows, below = values, 0
        while rows.count() > BIN:
            low, high = rows.agg(F.min("v"), F.max("v")).first()
            bins = rows.withColumn("bin", F.least(F.floor((F.col("v") - low) / (high - low) * BIN), F.lit(BIN - 1)))
            for r in bins.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect():
                if below + r["n"] > rank:
                    break
                below += r["n"]
            rows = bins.where(F.col("bin") == r["bin"]).select("v", "n")
        for v, n in sorted(tuple(r) for r in rows.select("v", "n").collect()):
            below += n
            if below > rank:
                break
        found.append(v)
    return found


def threshold_of(scored: DataFrame) -> float:
    """From all texts (n rows, label y, llr) kept from the counts: above all but FALSE_BLOCKS of the accepted, and
    where these lie apart, in the middle between them and all but a fiftieth of the rejected."""
    values = cut(scored.where("kept and y is not null").groupBy("y", F.col("llr").alias("v")).agg(F.sum("n").alias("n")))
    n = {r["y"]: r["n"] for r in values.groupBy("y").agg(F.sum("n").alias("n")).collect()}
    side = [values.where(F.col("y") == y).select("v", "n") for y in (0, 1)]
    top = at_ranks(side[0], [min(n[0] - 1, math.ceil(n[0] * (1 - FALSE_BLOCKS)))])[0] if 0 in n else 0.0
    top = max(top, 0.0)
    if 1 not in n:
        return top
    place = 0.02 * (n[1] - 1)
    a, b = at_ranks(side[1], [math.floor(place), math.ceil(place)])
    low = a + (b - a) * (place - math.floor(place))
    return top if low <= top else (top + low) / 2


def judged_texts(rows: DataFrame, label: Column) -> tuple[DataFrame, float]:
    """_t, n, llr of each distinct text (column _t: host and path) of rows, and the threshold. Without labelled
    texts of both kinds all llr are 0."""
    prepare(rows.sparkSession)
    texts = rows.select("_t", label.alias("y")).groupBy("_t").agg(F.count("*").alias("n"), F.max("y").alias("y"))
    host = F.regexp_extract("_t", "^[^/]*", 0)
    texts = cut(texts.withColumn("kept", F.pmod(F.crc32(host.cast("binary")), F.lit(KEPT)) == 0).withColumn("u", F.monotonically_increasing_id()))
    counts = cut(counted(texts))
    total = counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("m").alias("m")).first()
    if not total["n0"] or not total["n1"]:
        return texts.select("_t", "n", F.lit(0.0).alias("llr")), math.inf
    values = cut(ratios(counts))
    common = counts.where(F.col("m") > total["m"] / HOT).select("g")
    known = rows.sparkSession.sparkContext.broadcast({r["g"]: r["v"] for r in values.join(F.broadcast(common), "g").collect()})

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot = known.value
        for f in frames:
            out: list[tuple[int, str | None, int]] = []
            for u, t in zip(f["u"].tolist(), f["_t"], strict=True):
                s = 0
                for g, c in grams(t).items():
                    if (v := hot.get(g)) is None:
                        out.append((u, g, c))
                    else:
                        s += c * v
                out.append((u, None, s))
                if len(out) > HELD:
                    yield pd.DataFrame(out, columns=["u", "g", "s"])
                    out = []
            yield pd.DataFrame(out, columns=["u", "g", "s"])

    parts = cut(texts.select("u", "_t").mapInPandas(batches, "u bigint, g string, s bigint"))
    joined = parts.where("g is not null").join(values, "g").select("u", (F.col("s") * F.col("v")).alias("s"))
    sums = parts.where("g is null").select("u", "s").union(joined).groupBy("u").agg(F.sum("s").alias("s"))
    llr = F.col("s") / float(UNIT) / F.greatest(F.length("_t"), F.lit(1))
    scored = cut(texts.join(sums, "u").select("_t", "n", "y", "kept", llr.alias("llr")))
    return scored.select("_t", "n", "llr"), threshold_of(scored)


def filter_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, llr (the normalised log-likelihood ratio) for every url."""
    host, path = parts(F.col("url"))
    html = [F.col("html").alias("_h")] if "html" in pages.columns else []
    read = pages.select(F.col("page_id").cast("bigint").alias("page_id"), host.alias("host"), path.alias("path"), *html).withColumn("_t", F.concat("host", "path"))
    texts, threshold = judged_texts(read, label_of(F.col("host"), F.col("_h") if html else None))
    rows = read.select("page_id", "host", "path", "_t")
    total = texts.agg(F.sum("n")).first()[0] or 0
    often = [r["_t"] for r in texts.where(F.col("n") > max(total / HOT_URLS, 1)).select("_t").collect()]
    # rows of a common url are dealt over SALTS keys
    hot = F.col("_t").isin(often) if often else F.lit(False)
    salted = rows.withColumn("_s", F.when(hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("bigint"))
    spread = texts.select("_t", "llr", F.explode(F.when(hot, F.expr(f"sequence(0L, {SALTS - 1}L)")).otherwise(F.expr("array(0L)"))).alias("_s"))
    rule = rule_for(F.col("host"), F.col("path"))
    own = F.when(F.col("llr") > threshold, "block").otherwise("allow")
    return salted.join(spread, ["_t", "_s"]).withColumn("_r", rule).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", own).alias("verdict"), "llr")
