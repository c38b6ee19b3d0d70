"""Python functions of cells, rows and groups: how many arguments they want, and adapters that run them on Arrow batches.

Missing cells and NaN reach them as None. They are the slow path: Columns and SQL text stay in the JVM.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import prepare

#: What `returns` may name.
RETURNS = {"number": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "date": T.TimestampNTZType()}


def arity(fn: Callable, most: int) -> int:
    """How many of the `most` arguments on offer fn wants: those without a default, at least one."""
    try:
        wanted = inspect.signature(fn).parameters.values()
    except (TypeError, ValueError):  # built-in functions without a signature
        return 1
    if any(p.kind is p.VAR_POSITIONAL for p in wanted):
        return most
    return max(1, min(most, sum(p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD) and p.default is p.empty for p in wanted)))


def plain(v: Any) -> Any:
    return None if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v else v


def as_type(v: Any, dtype: T.DataType) -> Any:
    v = plain(v)
    return v if v is None else float(v) if isinstance(dtype, T.DoubleType) else bool(v) if isinstance(dtype, T.BooleanType) else str(v) if isinstance(dtype, T.StringType) else v


def per_row(fn: Callable[..., Any], cells: list[Column], extra: list[Column], dtype: T.DataType) -> Column:
    """fn(list of a row's cells, *extra) for each row, as one Column."""
    width = len(cells)
    prepare(SparkSession.active())

    @F.pandas_udf(dtype)
    def run(rows: pd.DataFrame) -> pd.Series:
        out = [as_type(fn([plain(v) for v in r[:width]], *[plain(v) for v in r[width:]]), dtype) for r in rows.itertuples(index=False, name=None)]
        return pd.Series(out, dtype=object)

    every = [*cells, *extra]
    return run(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(every)]))


def per_group(fn: Callable[..., Any], c: Column, rows: dict[str, Column], dtype: T.DataType) -> Column:
    """fn(values) or fn(values, rows) for each group: a Series, and a data frame of all the group's cells."""
    names = list(rows) if arity(fn, 2) > 1 else []
    prepare(SparkSession.active())

    def run(*columns):
        if not names:
            return as_type(fn(columns[0]), dtype)
        return as_type(fn(columns[0], pd.DataFrame(dict(zip(names, columns[1:], strict=True)))), dtype)

    run.__annotations__ = {"columns": pd.Series, "return": float if isinstance(dtype, T.DoubleType) else str}
    return F.pandas_udf(run, dtype)(c, *[rows[n] for n in names])
