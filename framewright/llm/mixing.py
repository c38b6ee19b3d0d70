"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A document of source s is repeated Poisson(rate_s) times, where rate_s = weight_s * target rows / rows of s.
The count inverts the Poisson distribution at a uniform number hashed from the seed and the document's id,
so a task that runs again makes the same copies. Copies are then dealt to partitions by a hash of id and
copy and sorted by it within: a global shuffle without a sampling pass.

Defined results: a null source is the source ''; a source that has no weight gets rate 0 unless weights is
None (then weights follow rows ** temperature); repeated rows of one id share their count; an empty table
gives an empty result. Columns named like the operator's own (n_copies, copy, shuffle_key) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, numbered

#: Sources up to which rates are broadcast (a row is under 9 KB); above, Spark joins them by shuffle.
BROADCAST_SOURCES = 2000
#: Rates above this are split into equal parts so that exp(-rate) keeps its precision.
LARGEST_RATE = 400.0


def uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... as an array, up to where doubles end."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    grow = lambda a, k: F.struct((a["p"] * rate / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * rate / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), start, grow)["c"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, target_rows: int | None, source: str) -> DataFrame:
    """One row per source: _source, rate, cdf."""
    counts = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("_source")).agg(F.count("*").alias("n"))
    raw = F.pow(F.col("n").cast("double"), F.lit(temperature))
    if weights is not None:
        known = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
        raw = F.coalesce(F.try_element_at(known, F.col("_source")), F.lit(0.0)) if weights else F.lit(0.0)
    counts = counts.withColumn("raw", raw)
    total = counts.agg(F.sum("raw").alias("all_raw"), F.sum("n").alias("all_n"))
    goal = F.col("all_n").cast("double") if target_rows is None else F.lit(float(target_rows))
    rate = F.when(F.col("all_raw") > 0, F.col("raw") / F.col("all_raw") * goal / F.col("n")).otherwise(0.0)
    rated = counts.join(F.broadcast(total), F.lit(True)).select("_source", rate.alias("rate"))
    parts = F.greatest(F.ceil(F.col("rate") / LARGEST_RATE), F.lit(1)).cast("int")
    return rated.select("_source", "rate", parts.alias("parts"), poisson_cdf(F.col("rate") / parts).alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, target_rows: int | None = None, seed: int = 7, id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """docs repeated to the target mixture and shuffled, with n_copies, copy (from 0) and shuffle_key."""
    docs = docs.drop("n_copies", "copy", "shuffle_key")
    names = docs.columns
    id_col, source = f"c{names.index(id_col)}", f"c{names.index(source)}"
    docs = numbered(docs)
    rates = source_rates(docs, weights, temperature, target_rows, source)
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    rates = F.broadcast(rates) if few else rates
    joined = docs.withColumn("_source", F.coalesce(F.col(source), F.lit(""))).join(rates, "_source")
    def drawn(j: Column) -> Column:
        u = uniform(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), j)
        return let(u, lambda x: F.size(F.filter(F.col("cdf"), lambda c: c <= x)))

    many = F.aggregate(F.sequence(F.lit(1), F.col("parts")), F.lit(0), lambda a, j: a + drawn(j))
    counted = joined.withColumn("n_copies", many).where("n_copies > 0").drop("_source", "rate", "parts", "cdf")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col(id_col).cast("string"), F.col("copy").cast("string")).cast("binary")))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key").toDF(*names, "n_copies", "copy", "shuffle_key")
