"""Series: a Frame of one column."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.calls import arity
from ..functions.cells import text_of
from ..plans.ordering import IDX, ORD
from .frame import Frame, column_values


class Series:
    def __init__(self, frame: Frame, name: str | None = None):
        self.frame, self.name = frame, name

    @classmethod
    def create(cls, values: list, index: list | None = None, name: str | None = None, spark: SparkSession | None = None) -> Series:
        return cls(Frame.create({name or "value": list(values)}, index=index, spark=spark), name)

    @property
    def _c(self) -> Column:
        return F.col(f"`{self.frame.columns[0]}`")

    def _of(self, frame: Frame, name: str | None = ...) -> Series:
        return Series(frame, self.name if name is ... else name)

    def to_list(self) -> list:
        return column_values(self.frame._sorted().select(self._c))

    values = to_list

    def index(self) -> list:
        return self.frame.labels()

    def __len__(self) -> int:
        return self.frame.sdf.count()

    def to_dict(self) -> dict:
        return dict(zip(self.index(), self.to_list(), strict=True))

    def iloc(self, i: int) -> Any:
        row = self.frame.iloc(i)
        return None if row is None else row[self.frame.columns[0]]

    def loc(self, label: Any) -> Any:
        return self.frame.at(label, self.frame.columns[0])

    def head(self, n: int = 5) -> Series:
        return self._of(self.frame.head(n))

    def tail(self, n: int = 5) -> Series:
        return self._of(self.frame.tail(n))

    def map(self, fn: Callable, name: str | None = ..., returns: str | None = None, columnar: bool = False) -> Series:
        """fn of a value, its label and its position, as many as it wants; columnar: of the Column."""
        if columnar:
            return self._of(self.frame.applymap(fn, columnar=True), name)
        n = arity(fn, 3)
        # applymap offers the column's name after the value
        own = {1: lambda v: fn(v), 2: lambda v, _, label, place: fn(v, label), 3: lambda v, _, label, place: fn(v, label, place)}[n]
        return self._of(self.frame.applymap(own, returns), name)

    apply = map

    def filter(self, how: Callable | Column | str) -> Series:
        """By Column or SQL text, or by a Python function of a value, its label and its position."""
        if callable(how) and not isinstance(how, Column):
            own, column, n = how, self.frame.columns[0], arity(how, 3)
            test = {1: lambda row: own(row[column]), 2: lambda row, label: own(row[column], label), 3: lambda row, label, place: own(row[column], label, place)}[n]
            return self._of(self.frame.filter(test))
        return self._of(self.frame.filter(how))

    def fillna(self, value: Any) -> Series:
        return self._of(self.frame.fillna(value))

    def dropna(self) -> Series:
        return self._of(self.frame.dropna())

    def _one(self, name: str) -> Any:
        return self.frame._totals(name)[self.frame.columns[0]]

    def sum(self) -> Any:
        return self._one("sum")

    def mean(self) -> Any:
        return self._one("mean")

    def min(self) -> Any:
        return self._one("min")

    def max(self) -> Any:
        return self._one("max")

    def unique(self) -> list:
        """In first-seen order, missing included."""
        rows = self.frame._ordered().sdf.groupBy(self._c.alias("v")).agg(F.min(ORD).alias("o")).orderBy("o")
        return [r["v"] for r in rows.select("v").collect()]

    def value_counts(self, dropna: bool = True) -> Series:
        """Most frequent first, ties as first seen; labels are the values as text."""
        f = self.frame._ordered()
        sdf = f.sdf.where(self._c.isNotNull()) if dropna else f.sdf
        counted = sdf.groupBy(self._c.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(ORD).alias("o"))
        label = F.coalesce(text_of(F.col("v"), f.dtype(f.columns[0])), F.lit("null"))
        name = f"{self.name}_counts" if self.name else "counts"
        out = counted.select(F.col("n").alias(name), label.alias(IDX), "o")
        return Series(f._new(out, [name], True, [F.col(name).desc(), F.col("o")]), name)

    def astype(self, dtype: str) -> Series:
        return self._of(self.frame.astype(dtype))

    def isin(self, values: list) -> Series:
        return self._of(self.frame.isin(values))

    def clip(self, lower: float | None = None, upper: float | None = None) -> Series:
        return self._of(self.frame.clip(lower, upper))

    def replace(self, to_replace: Any, value: Any = ...) -> Series:
        return self._of(self.frame.replace(to_replace, value))
