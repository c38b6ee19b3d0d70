"""Ranks without a single-partition window, and exact seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.ordering import ORD, linguistic
from ..session import stored
from .frame import Frame

#: Ordinals that share their higher bits are one slice: about a million rows of dense ones, some of a partition of others.
SLICE_BITS = 20


def rank(f: Frame, method: str = "average", ascending: bool = True, na_option: str = "keep", pct: bool = False) -> Frame:
    """Every column's ranks. Distinct values are counted first and written in range partitions, so the running totals go
    over distinct values, with the totals of the partitions before; then ranks are joined back by value. For `first`,
    rows of a value are numbered within each partition of the input, after those of the partitions before, so that a
    frequent value isn't one task's."""
    if method not in ("average", "min", "max", "dense", "first") or na_option not in ("keep", "top", "bottom"):
        raise ValueError("unknown method or na_option")
    out = f._ordered() if method != "first" else f._dense() if f.index or f.order is not None else f._ordered()
    cells = {c: F.col(f"`{c}`") for c in f.columns}
    sizes = out.sdf.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cells.values())], F.count(F.lit(1)).alias("n")).first()
    sdf, names = out.sdf, []
    for i, (c, col) in enumerate(cells.items()):
        order = linguistic(F.col("__v"), f.dtype(c), ascending)
        counts = out.sdf.where(col.isNotNull()).groupBy(col.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        ranged = stored(counts.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "ranks")
        w = Window.partitionBy("__part").orderBy(order)
        heads = ranged.groupBy("__part").agg(F.sum("__n").alias("__s"), F.count(F.lit(1)).alias("__d"))
        before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
        heads = heads.select("__part", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s0"), F.coalesce(F.sum("__d").over(before), F.lit(0)).alias("__d0"))
        ranks = ranged.join(F.broadcast(heads), "__part").select("__v", (F.col("__s0") + F.sum("__n").over(w)).alias("__max"), "__n", (F.col("__d0") + F.row_number().over(w)).alias("__dense"))
        ranks = ranks.select("__v", "__max", (F.col("__max") - F.col("__n") + 1).alias("__min"), "__dense")
        if method == "first":
            sdf = numbered_within(sdf, col)
        sdf = sdf.join(ranks, col == F.col("__v"), "left")
        value = {"average": (F.col("__min") + F.col("__max")) / 2, "min": F.col("__min"), "max": F.col("__max"), "dense": F.col("__dense"), "first": F.col("__min") + F.col("__nth") - 1 if method == "first" else None}[method].cast("double")
        real, missing = sizes[f"n{i}"], sizes["n"] - sizes[f"n{i}"]
        if na_option == "top":
            value = F.when(col.isNull(), 1.0).otherwise(value + missing)
        elif na_option == "bottom":
            value = F.when(col.isNull(), real + 1.0).otherwise(value)
        if pct:
            value = value / F.lit(float(real + (na_option != "keep")) or None)
        sdf = sdf.withColumn(f"__r{i}", value).drop("__v", "__max", "__min", "__dense", "__nth")
        names.append(f"__r{i}")
    rest = [c for c in sdf.columns if c not in f.columns and c not in names]
    return out._new(sdf.select(*[F.col(r).alias(c) for r, c in zip(names, f.columns, strict=True)], *rest), f.columns, index=f.index, order=out.order)


def numbered_within(sdf: DataFrame, col: Column) -> DataFrame:
    """sdf with __nth: the how manieth row of its value each is, by ordinal. Rows are numbered by value and slice of the
    ordinals, and the counts of the slices before are added."""
    slices = sdf.withColumn("__slice", F.shiftright(F.col(ORD), SLICE_BITS)).withColumn("__key", F.to_json(F.struct(col.alias("v"))))
    counts = slices.groupBy("__key", "__slice").agg(F.count(F.lit(1)).alias("__c"))
    before = F.sum("__c").over(Window.partitionBy("__key").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__key", "__slice", F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy("__key", "__slice").orderBy(ORD))
    return slices.withColumn("__own", nth).join(starts, ["__key", "__slice"]).withColumn("__nth", F.col("__own") + F.col("__before")).drop("__key", "__slice", "__own", "__before")


def draws(n: int, k: int, replace: bool, seed: int | None) -> list[int]:
    """k positions of n: a partial Fisher-Yates shuffle on a sparse table, or draws with replacement."""
    import random

    state = (seed if seed is not None else random.SystemRandom().randrange(2**32)) % 2**32

    def uniform() -> float:
        nonlocal state
        state = (1664525 * state + 1013904223) % 2**32  # fixed constants of the generator
        return state / 2**32

    if replace:
        return [int(uniform() * n) for _ in range(k)]
    moved: dict[int, int] = {}
    out = []
    for i in range(k):
        j = i + int(uniform() * (n - i))
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return out


def sample(f: Frame, n: int = 1, frac: float | None = None, replace: bool = False, random_state: int | None = None, ignore_index: bool = False) -> Frame:
    """Exactly n rows (or round(frac * rows)), in drawn order."""
    o = f._dense()
    total = o.sdf.count()
    if frac is not None:
        if frac < 0:
            raise ValueError("frac must be non-negative")
        n = int(frac * total + 0.5)
    if n < 0 or (not replace and n > total) or (replace and n and not total):
        raise ValueError("cannot take a larger sample than rows when replace is false")
    at = draws(total, n, replace, random_state)
    spark = o.sdf.sparkSession
    chosen = spark.createDataFrame(list(enumerate(at)), "__k bigint, __pos bigint")
    out = o.sdf.join(chosen, F.col(ORD) == F.col("__pos")).drop("__pos", ORD).withColumnRenamed("__k", ORD)
    return o._new(out, f.columns, index=f.index and not ignore_index, order=[F.col(ORD)])
