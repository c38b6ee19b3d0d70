"""Counting values and distinct values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.ordering import ORD, by
from .frame import Frame


def value_counts(f: Frame, subset: str | list[str] | None = None, normalize: bool = False, dropna: bool = True, sort: bool = True, ascending: bool = False, limit: int | None = None) -> Frame:
    """Counts (or proportions of the rows kept, before the limit), most frequent first, ties by value."""
    cols = [subset] if isinstance(subset, str) else list(subset or f.columns)
    f._need(cols)
    if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or limit < 0):
        raise ValueError("limit must be a non-negative integer")
    keys = [F.col(f"`{c}`") for c in cols]
    sdf = f.sdf if sort else f._ordered().sdf
    if dropna:
        for k in keys:
            sdf = sdf.where(k.isNotNull())
    counted = sdf.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), *([] if sort else [F.min(ORD).alias(ORD)]))
    name = "count"
    if normalize:
        total = counted.agg(F.sum("count").alias("__total"))
        counted = counted.join(F.broadcast(total), F.lit(True)).withColumn("proportion", F.col("count") / F.col("__total")).drop("__total", "count")
        name = "proportion"
    order = [by(F.col(name), ascending), *[by(k) for k in keys]] if sort else [F.col(ORD)]
    out = f._new(counted, [*cols, name], order=order)
    return out if limit is None else out.head(limit)


def nunique(f: Frame, dropna: bool = True) -> dict[str, int]:
    one = lambda c: F.count_distinct(F.col(f"`{c}`")) + (F.lit(0) if dropna else F.coalesce(F.max(F.col(f"`{c}`").isNull().cast("int")), F.lit(0)))
    return f.sdf.agg(*[one(c).alias(c) for c in f.columns]).first().asDict() if f.columns else {}
