"""Named aggregates and the adapter for Python functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calls import per_group
from ..functions.cells import FRACTION, finite, is_numeric, sort_text

NAMES = ("count", "sum", "mean", "min", "max")
Agg = str | Callable[..., Any]


def named(name: str, c: Column, dtype: T.DataType) -> Column:
    if name == "count":
        return F.count(c)
    if name == "sum":
        return F.sum(finite(c, dtype))
    if name == "mean":
        return F.avg(finite(c, dtype))
    if name in ("min", "max"):
        if isinstance(dtype, T.StringType):
            return (F.min_by if name == "min" else F.max_by)(c, sort_text(c))
        real = F.when(~F.isnan(c), c) if isinstance(dtype, FRACTION) else c
        return (F.min if name == "min" else F.max)(real)
    raise ValueError(f"unknown aggregate: {name}")


def aggregate(how: Agg, c: Column, dtype: T.DataType, rows: dict[str, Column] | None = None) -> Column:
    """A named aggregate, or a Python function of a group's values, or of its values and `rows` (the slow path)."""
    if isinstance(how, str):
        return named(how, c, dtype)
    return per_group(how, c.cast("double") if is_numeric(dtype) else c.cast("string"), rows or {}, T.DoubleType() if is_numeric(dtype) else T.StringType())


def grouped(sdf: DataFrame, keys: dict[str, Column], native: list[Column], python: list[Column] = ()) -> DataFrame:
    """sdf aggregated by keys (name -> Column). Spark runs Python aggregates apart from its own: they are joined by key."""
    by = [c.alias(n) for n, c in keys.items()]
    if not python or not native:
        return sdf.groupBy(*by).agg(*native, *python)
    other = sdf.groupBy(*[c.alias(f"__p.{n}") for n, c in keys.items()]).agg(*python)
    same = reduce(lambda x, y: x & y, [F.col(f"`{n}`").eqNullSafe(F.col(f"`__p.{n}`")) for n in keys], F.lit(True))
    return sdf.groupBy(*by).agg(*native).join(other, same).drop(*[f"__p.{n}" for n in keys])
