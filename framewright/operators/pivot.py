"""Pivot tables: one grouping-sets aggregate over the raw rows, then a wide projection."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import text_of
from ..plans.ordering import ORD, linguistic
from .aggregates import Agg, aggregate, grouped
from .frame import Frame


def pivot_table(f: Frame, index: str | list[str], values: str | list[str], columns: str | None = None, aggfunc: Agg = "mean", fill_value: Any = None, margins: bool = False, margins_name: str = "All", dropna: bool = True, sort: bool = True) -> Frame:
    """Margins are computed from raw rows; fill_value fills cells without a row, not null aggregates. Heads are listed on
    the driver; more of them than spark.sql.pivotMaxValues are an error, as for Spark's own pivots."""
    idx, vals = [index] if isinstance(index, str) else list(index), [values] if isinstance(values, str) else list(values)
    f._need([*idx, *vals, *([columns] if columns else [])])
    sdf = f.sdf if sort else f._ordered().sdf
    if dropna:
        for c in [*idx, *vals, *([columns] if columns else [])]:
            sdf = sdf.where(F.col(f"`{c}`").isNotNull())
    flat, names = [f"__i{i}" for i in range(len(idx))], [None]
    if columns is not None:
        q = F.coalesce(text_of(F.col(f"`{columns}`"), f.dtype(columns)), F.lit("null"))
        sdf = sdf.withColumns({"__q": q, "__qv": F.col(f"`{columns}`")})
        heads = sdf.groupBy("__q").agg((F.min("__qv") if sort else F.min(ORD)).alias("__at"))
        most = int(f.sdf.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        names = [r["__q"] for r in heads.orderBy(linguistic(F.col("__at"), f.dtype(columns)) if sort else F.col("__at")).limit(most + 1).collect()]
        if len(names) > most:
            raise ValueError(f"column '{columns}' has more than {most} values; see spark.sql.pivotMaxValues")
    base = sdf.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(flat, idx, strict=True)], *[F.col(f"`{v}`") for v in dict.fromkeys(vals)], *([] if sort else [ORD]), *(["__q"] if columns else []))
    # sets of keys to group by: raw cells, then the total column, the total row and the grand total
    kept = [*flat, "__q"] if columns else flat
    sets = [kept, *([flat, ["__q"], []] if columns else [[]])] if margins else [kept]
    long = grouping_sets(base, kept, sets, [aggregate(aggfunc, F.col(f"`{v}`"), f.dtype(v)).alias(f"__v{i}") for i, v in enumerate(vals)], callable(aggfunc), [] if sort else [F.min(ORD).alias(ORD)])

    labels = [F.when(F.col("__total"), F.lit(margins_name if i == 0 else "")).otherwise(text_of(F.col(n), f.dtype(c))).alias(c) if margins else F.col(n).alias(c) for i, (n, c) in enumerate(zip(flat, idx, strict=True))]
    order = [F.col("__total"), *([linguistic(F.col(n), f.dtype(c)) for n, c in zip(flat, idx, strict=True)] if sort else [F.col(ORD)])]
    hidden = ["__total", *flat, *([] if sort else [ORD])]
    if columns is None:
        return f._new(long.select(*labels, *[F.col(f"__v{i}").alias(v) for i, v in enumerate(vals)], *hidden), [*idx, *vals], order=order)
    margin, k = margins_name, 0
    while margin in names:
        k += 1
        margin = f"{margins_name}_{k}"
    wide, outputs = [], []
    for i, v in enumerate(vals):
        for j, q in enumerate([*names, *([None] if margins else [])]):
            here = F.col("__all") if q is None else ~F.col("__all") & (F.col("__q") == q)
            wide += [F.max(F.when(here, F.col(f"__v{i}"))).alias(f"__c{i}_{j}"), F.max(here).alias(f"__p{i}_{j}")]
            head = margin if q is None else q
            outputs.append((head if len(vals) == 1 else f"{v}_{head}", f"__c{i}_{j}", f"__p{i}_{j}"))
    filled = lambda cell, present: cell if fill_value is None else F.when(present, cell).otherwise(F.lit(fill_value))
    rows = long.groupBy("__total", *flat).agg(*wide, *([] if sort else [F.min(ORD).alias(ORD)]))
    return f._new(rows.select(*labels, *[filled(F.col(c), F.col(p)).alias(n) for n, c, p in outputs], *hidden), [*idx, *[n for n, _, _ in outputs]], order=order)


def grouping_sets(base: DataFrame, keys: list[str], sets: list[list[str]], values: list[Column], python: bool, native: list[Column]) -> DataFrame:
    """One aggregate over all sets of keys, with __total (no index key is grouped by) and __all (no head is). Python
    functions, which Spark can't group so, take one aggregate a set."""
    if not python and len(sets) > 1:
        gone = lambda k: F.grouping(k) == 1
        heads = [gone("__q").alias("__all")] if "__q" in keys else []
        return base.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(*values, *native, gone(keys[0]).alias("__total"), *heads)
    parts = []
    for s in sets:
        part = grouped(base, {k: F.col(k) for k in s}, [*([] if python else values), *native], values if python else [])
        parts.append(part.withColumns({"__total": F.lit(keys[0] not in s), "__all": F.lit("__q" not in s)}))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
