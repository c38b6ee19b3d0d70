"""Frame: an immutable Spark DataFrame with visible columns, an optional label column and a declared order."""

from __future__ import annotations

import inspect
import json
import random
from collections.abc import Callable, Iterable
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cells
from ..functions.calls import RETURNS, arity, per_row
from ..plans.ordering import IDX, ORD, by, dense, is_steady, linguistic
from ..session import session


def cell_type(values: Iterable[Any]) -> T.DataType:
    """One type for a column of Python cells; text where kinds differ."""
    kinds = {cells.value_kind(v) for v in values if v is not None}
    return {frozenset({"number"}): T.DoubleType(), frozenset({"boolean"}): T.BooleanType(), frozenset({"date"}): T.TimestampNTZType()}.get(frozenset(kinds), T.StringType())


def to_cell(v: Any, dtype: T.DataType) -> Any:
    if v is None:
        return None
    if isinstance(dtype, T.DoubleType):
        return float(v)
    if isinstance(dtype, T.StringType) and not isinstance(v, str):
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return str(int(v)) if float(v).is_integer() else str(v)
        return json.dumps(v) if isinstance(v, (list, dict)) else v.isoformat()
    return v


def column_values(sdf: DataFrame) -> list:
    """The cells of the one column, as the driver's list; as Arrow where Python's values are the same, which takes a fraction
    of the memory that rows do."""
    if isinstance(sdf.schema[0].dataType, (T.BooleanType, T.IntegerType, T.LongType, T.DoubleType, T.StringType)):
        return sdf.toArrow().column(0).to_pylist()
    return [r[0] for r in sdf.collect()]


def keeps_labels(method: Callable) -> Callable:
    """For operations whose rows keep their labels. A frame without own labels has its rows' positions for labels; they
    are counted only where something asks: then the operation runs again on the labelled frame."""
    signature = inspect.signature(method)

    @wraps(method)
    def run(self, *args, **kw):
        out = method(self, *args, **kw)
        if isinstance(out, Frame) and not self.index and not out.index and not signature.bind(self, *args, **kw).arguments.get("ignore_index"):
            out._relabel = lambda: method(self._labelled(), *args, **kw)
        return out

    return run


class Frame:
    _relabel: Callable[[], Frame] | None = None
    _is_dense = False

    def __init__(self, sdf: DataFrame, columns: list[str] | None = None, index: bool = False, order: list[Column] | None = None):
        self.sdf, self.index, self.order = sdf, index, order
        self.columns = list(columns if columns is not None else [c for c in sdf.columns if c not in (ORD, IDX)])

    # construction

    @classmethod
    def create(cls, data: list[dict] | dict[str, list], index: list | None = None, columns: list[str] | None = None, spark: SparkSession | None = None) -> Frame:
        """From records or a dict of columns; missing keys and short columns are padded with null."""
        spark = spark or session()
        if isinstance(data, dict):
            names, n = list(data), max(map(len, data.values()), default=0)
            rows = [[data[c][i] if i < len(data[c]) else None for c in names] for i in range(n)]
        else:
            names = list(dict.fromkeys([*(columns or []), *(k for r in data for k in r)]))
            rows = [[r.get(c) for c in names] for r in data]
        if index is not None and len(index) != len(rows):
            raise ValueError("index length must match row count")
        types = [cell_type(r[i] for r in rows) for i in range(len(names))]
        mixed = [len({cells.value_kind(r[i]) for r in rows if r[i] is not None}) > 1 for i in range(len(names))]
        label = cell_type(index) if index is not None else None
        schema = T.StructType([T.StructField(c, t, metadata={"mixed": True} if m else None) for c, t, m in zip(names, types, mixed, strict=True)] + ([T.StructField(IDX, label)] if label else []) + [T.StructField(ORD, T.LongType())])
        made = [(*[to_cell(v, t) for v, t in zip(r, types, strict=True)], *([to_cell(index[i], label)] if label else []), i) for i, r in enumerate(rows)]
        return cls(spark.createDataFrame(made, schema), names, index is not None, [F.col(ORD)])

    from_records = create
    from_dict = create

    @classmethod
    def from_normalized(cls, sdf: DataFrame, columns: list[str] | None = None) -> Frame:
        return cls(sdf, columns)

    # internals

    def _new(self, sdf: DataFrame, columns: list[str], index: bool = False, order: list[Column] | None = None) -> Frame:
        return Frame(sdf, columns, index, order)

    def _need(self, columns: Iterable[str]) -> None:
        for c in columns:
            if c not in self.columns:
                raise KeyError(f"Column '{c}' does not exist.")

    def dtype(self, column: str) -> T.DataType:
        return self.sdf.schema[column].dataType

    def _by_ordinal(self) -> bool:
        return ORD in self.sdf.columns and self.order is not None and [str(c) for c in self.order] == [str(F.col(ORD))]

    def _ordered(self) -> Frame:
        """The same frame with an ordinal column that its order follows."""
        if self._by_ordinal():
            return self
        sdf = self.sdf.drop(ORD) if self.order is None else self.sdf.orderBy(*self.order).drop(ORD)
        return self._new(sdf.withColumn(ORD, F.monotonically_increasing_id()), self.columns, self.index, [F.col(ORD)])

    def _steady(self) -> Frame:
        """Order that doesn't hang on visible columns, for operations that change them."""
        return self if self.order is None or self._by_ordinal() else self._ordered()

    def _dense(self) -> Frame:
        """The same frame, its ordinals its rows' positions 0, 1, ..."""
        if self._is_dense:
            return self
        as_they_lie = self.order is None or self._by_ordinal() and is_steady(self.sdf)
        sdf = dense(self.sdf.drop(ORD) if self.order is None or as_they_lie else self.sdf, None if as_they_lie else self.order)
        out = self._new(sdf, self.columns, self.index, [F.col(ORD)])
        out._is_dense = True
        return out

    def _labelled(self) -> Frame:
        """With labels and ordinals; labels of frames without own ones are the positions that their rows had when made."""
        if self.index:
            return self._ordered()
        if self._relabel:
            return self._relabel()._ordered()
        d = self._dense()
        out = d._new(d.sdf.withColumn(IDX, F.col(ORD)), self.columns, True, d.order)
        out._is_dense = True
        return out

    def _placed(self) -> Frame:
        """With labels, and positions for ordinals."""
        return self._labelled()._dense()

    def _sorted(self) -> DataFrame:
        return self.sdf if self.order is None else self.sdf.orderBy(*self.order)

    def _select(self, cols: dict[str, Column], index: bool | None = None) -> Frame:
        s = self._steady()
        hidden = [c for c in (ORD, IDX) if c in s.sdf.columns]
        return s._new(s.sdf.select(*[c.alias(n) for n, c in cols.items()], *hidden), list(cols), self.index if index is None else index, s.order)

    def _all(self) -> dict[str, Column]:
        return {c: F.col(f"`{c}`") for c in self.columns}

    def _where(self, condition: Column) -> Frame:
        return self._new(self.sdf.where(condition), self.columns, self.index, self.order)

    # metadata and output

    def result(self) -> DataFrame:
        """The visible columns as a Spark DataFrame, without a sort."""
        return self.sdf.select(*self._all().values())

    @property
    def shape(self) -> tuple[int, int]:
        return self.sdf.count(), len(self.columns)

    @property
    def empty(self) -> bool:
        return self.sdf.isEmpty()

    def labels(self) -> list:
        return column_values(self._labelled()._sorted().select(IDX))

    @keeps_labels
    def copy(self) -> Frame:
        return self._new(self.sdf, list(self.columns), self.index, self.order)

    def values(self) -> list[list]:
        return [list(r) for r in self._sorted().select(*self._all().values()).collect()]

    def dtypes(self) -> dict[str, str]:
        """number, string, boolean or date; mixed where cells of several kinds became text; unknown where all are missing."""
        if not self.columns:
            return {}
        some = self.sdf.agg(*[F.count(c).alias(n) for n, c in self._all().items()]).first()
        mixed = {c for c in self.columns if self.sdf.schema[c].metadata.get("mixed")}
        return {c: ("mixed" if c in mixed else cells.kind(self.dtype(c))) if some[c] else "unknown" for c in self.columns}

    def to_records(self) -> list[dict]:
        return [dict(zip(self.columns, r, strict=True)) for r in self.values()]

    def to_dict(self, orient: str = "records"):
        if orient == "records":
            return self.to_records()
        rows = self.values()
        return {c: [r[i] for r in rows] for i, c in enumerate(self.columns)}

    def to_string(self, max_rows: int = 10) -> str:
        total, shown = self.sdf.count(), self.head(max_rows)
        lines = [json.dumps(r, default=str, ensure_ascii=False) for r in shown.to_records()]
        return "\n".join([*lines, *([f"... ({total - max_rows} more rows)"] if total > max_rows else [])])

    def to_csv(self, path: str | None = None, sep: str = ",", header: bool = True, index: bool = False, distributed: bool = False) -> str | None:
        """One text (and file); distributed: a folder of part files in the frame's order, written by the executors."""
        from ..sources.text import csv_parts, csv_text

        return csv_parts(self, path, sep, header, index) if distributed else csv_text(self, path, sep, header, index)

    def to_json(self, path: str | None = None, orient: str = "records", space: int = 2, lines: bool = False, distributed: bool = False) -> str | None:
        """One text (and file); distributed: a folder of part files, a record a line or (not lines) each a document, written by
        the executors."""
        from ..sources.text import json_parts, json_text

        return json_parts(self, path, orient, lines) if distributed else json_text(self, path, orient, space, lines)

    def to_parquet(self, path: str) -> None:
        from ..sources.files import to_parquet

        to_parquet(self, path)

    def to_excel(self, path: str, sheet_name: str = "Sheet1", index: bool = False) -> None:
        from ..sources.files import to_excel

        to_excel(self, path, sheet_name, index)

    # selection

    @keeps_labels
    def select(self, columns: list[str]) -> Frame:
        self._need(columns)
        return self._select({c: F.col(f"`{c}`") for c in columns})

    @keeps_labels
    def drop(self, columns: str | list[str]) -> Frame:
        gone = [columns] if isinstance(columns, str) else list(columns)
        self._need(gone)
        return self._select({c: v for c, v in self._all().items() if c not in gone})

    @keeps_labels
    def rename(self, names: dict[str, str]) -> Frame:
        new = [names.get(c, c) for c in self.columns]
        if len(set(new)) < len(new):
            raise ValueError("rename would produce duplicate column names")
        return self._select({n: F.col(f"`{c}`") for n, c in zip(new, self.columns, strict=True)})

    def get(self, column: str):
        from .series import Series

        self._need([column])
        return Series(self.select([column]), column)

    __getitem__ = get

    @keeps_labels
    def assign(self, values: dict[str, Any]) -> Frame:
        """Scalars and Column expressions; lists by position; Series by label (the first row of a label)."""
        from .series import Series

        f = self
        for name, v in values.items():
            if isinstance(v, Column):
                f = f._select(f._all() | {name: v})
            elif isinstance(v, Series):
                a, b = f._labelled(), v.frame._labelled()
                first = b.sdf.groupBy(F.col(IDX).alias("__k")).agg(F.min_by(F.col(f"`{v.frame.columns[0]}`"), ORD).alias("__v"))
                joined = a.sdf.join(first, F.col(IDX).eqNullSafe(F.col("__k")), "left").drop("__k")
                f = a._new(joined, [*a.columns, "__v"], a.index, a.order)._select(a._all() | {name: F.col("__v")}, index=self.index)
            elif isinstance(v, (list, tuple)):
                o = f._dense()
                if len(v) != o.sdf.count():
                    raise ValueError("array length must match row count")
                t = cell_type(v)
                given = self.sdf.sparkSession.createDataFrame([(i, to_cell(x, t)) for i, x in enumerate(v)], T.StructType([T.StructField("__pos", T.LongType()), T.StructField("__v", t)]))
                joined = o.sdf.join(given, F.col(ORD) == F.col("__pos")).drop("__pos")
                f = o._new(joined, [*o.columns, "__v"], o.index, o.order)._select(o._all() | {name: F.col("__v")})
            else:
                f = f._select(f._all() | {name: F.lit(v)})
        return f

    @keeps_labels
    def set(self, column: str, values: Any) -> Frame:
        return self.assign({column: values})

    @keeps_labels
    def filter(self, how: Column | str | list[bool] | Callable[..., bool]) -> Frame:
        """By Column or SQL text (pushed down), by a mask, or by a Python function of a row's dict, its label and its
        position, as many as it wants (the slow path; without label and position no rows are counted)."""
        if isinstance(how, str):
            return self._where(F.expr(how))
        if isinstance(how, Column):
            return self._where(how)
        if callable(how):
            names, n = self.columns, arity(how, 3)
            f = self if n == 1 else self._placed()
            keep = per_row(lambda row, *more: how(dict(zip(names, row, strict=True)), *more[: n - 1]), list(self._all().values()), [] if n == 1 else [F.col(IDX), F.col(ORD)], T.BooleanType())
            out = f._where(keep)
            return out if n == 1 else self._new(out.sdf if self.index else out.sdf.drop(IDX), self.columns, self.index, out.order)
        o = self._dense()
        if len(how) != o.sdf.count():
            raise ValueError("mask length must match row count")
        mask = self.sdf.sparkSession.createDataFrame([(i,) for i, x in enumerate(how) if x], "__pos bigint")
        return o._new(o.sdf.join(mask, F.col(ORD) == F.col("__pos"), "left_semi"), self.columns, self.index, o.order)

    query = filter

    @keeps_labels
    def head(self, n: int = 5) -> Frame:
        return self._new(self._sorted().limit(max(0, n)), self.columns, self.index, self.order)

    @keeps_labels
    def tail(self, n: int = 5) -> Frame:
        o = self._ordered()
        return o._new(o.sdf.orderBy(F.col(ORD).desc()).limit(max(0, n)), self.columns, self.index, o.order)

    @keeps_labels
    def iloc(self, at: int | list[int]):
        o = self._dense()
        n = o.sdf.count()
        wanted = [i if i >= 0 else n + i for i in ([at] if isinstance(at, int) else at)]
        wanted = [(k, i) for k, i in enumerate(wanted) if 0 <= i < n]
        chosen = self.sdf.sparkSession.createDataFrame(wanted, "__k bigint, __pos bigint")
        out = o.sdf.join(chosen, F.col(ORD) == F.col("__pos")).drop("__pos", ORD).withColumnRenamed("__k", ORD)
        f = o._new(out, self.columns, self.index, [F.col(ORD)])
        return next(iter(f.to_records()), None) if isinstance(at, int) else f

    def loc(self, label: Any):
        """The first row of a label, or of each label of a list; unknown labels are skipped."""
        o = self._labelled()
        wanted = label if isinstance(label, list) else [label]
        t = o.sdf.schema[IDX].dataType
        fitting = [(k, v) for k, v in enumerate(wanted) if cells.value_kind(v) == cells.kind(t)]
        asked = self.sdf.sparkSession.createDataFrame([(k, to_cell(v, T.DoubleType() if cells.is_numeric(t) else t)) for k, v in fitting], T.StructType([T.StructField("__k", T.LongType()), T.StructField("__l", T.DoubleType() if cells.is_numeric(t) else t)]))
        found = o.sdf.join(F.broadcast(asked), F.col(IDX) == F.col("__l")).groupBy("__k").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in [*self.columns, IDX]]), ORD).alias("__row"))
        f = o._new(found.select("__row.*", F.col("__k").alias(ORD)), self.columns, True, [F.col(ORD)])
        return f if isinstance(label, list) else next(iter(f.to_records()), None)

    def at(self, label: Any, column: str) -> Any:
        self._need([column])
        row = self.loc(label)
        return None if row is None else row[column]

    def set_index(self, column: str, drop: bool = True) -> Frame:
        """Numbers and text stay; other labels become text; a missing one keeps the old label as text."""
        self._need([column])
        s, c, t = self._steady(), F.col(f"`{column}`"), self.dtype(column)
        if cells.kind(t) not in ("number", "string") or not s.sdf.where(c.isNull()).isEmpty():
            s = s._labelled()
            c = F.coalesce(cells.text_of(c, t), cells.text_of(F.col(IDX), s.sdf.schema[IDX].dataType))
        out = s.sdf.withColumn(IDX, c)
        return s._new(out.drop(column) if drop else out, [x for x in self.columns if not (drop and x == column)], True, s.order)

    def reset_index(self, name: str = "index") -> Frame:
        if name in self.columns:
            raise ValueError(f"Column '{name}' already exists.")
        s = self._labelled() if not self.index else self._steady()
        return s._select({name: F.col(IDX)} | self._all(), index=False)

    # missing values and cells

    @keeps_labels
    def dropna(self, subset: list[str] | None = None) -> Frame:
        f = self
        for c in subset or self.columns:
            self._need([c])
            f = f._where(F.col(f"`{c}`").isNotNull())
        return f

    def _cells(self, change: Callable[[str, Column, T.DataType], Column]) -> Frame:
        return self._select({n: change(n, c, self.dtype(n)) for n, c in self._all().items()})

    @keeps_labels
    def fillna(self, value: Any) -> Frame:
        return self._cells(lambda n, c, t: cells.fill(c, t, value.get(n) if isinstance(value, dict) else value))

    @keeps_labels
    def astype(self, dtype: str | dict[str, str]) -> Frame:
        if isinstance(dtype, dict):
            self._need(dtype)
        return self._cells(lambda n, c, t: cells.cast(c, t, dtype) if isinstance(dtype, str) else cells.cast(c, t, dtype[n]) if n in dtype else c)

    @keeps_labels
    def isin(self, values: list | dict[str, list]) -> Frame:
        return self._cells(lambda n, c, t: cells.matches(c, t, values.get(n, []) if isinstance(values, dict) else list(values)))

    @keeps_labels
    def clip(self, lower: float | None = None, upper: float | None = None, columns: list[str] | None = None) -> Frame:
        if lower is not None and upper is not None and lower > upper:
            raise ValueError("lower must be <= upper")
        self._need(columns or [])
        return self._cells(lambda n, c, t: cells.clip(c, t, lower, upper) if columns is None or n in columns else c)

    @keeps_labels
    def replace(self, to_replace: Any, value: Any = ...) -> Frame:
        """A scalar, a list, or a map from text cells to replacements."""
        if isinstance(to_replace, dict):
            pairs = [([k], v) for k, v in to_replace.items()]
        else:
            if value is ...:
                raise ValueError("replace needs a value")
            pairs = [(list(to_replace) if isinstance(to_replace, (list, tuple)) else [to_replace], value)]
        return self._cells(lambda n, c, t: cells.replace(c, t, pairs))

    @keeps_labels
    def applymap(self, fn: Callable, returns: str | None = None, columnar: bool = False) -> Frame:
        """fn of a cell, its column's name, its row's label and position, as many as it wants, on Arrow batches; cells keep
        their type where `returns` names no other. columnar: fn maps a Column to a Column instead."""
        if columnar:
            return self._cells(lambda n, c, t: fn(c))
        n = arity(fn, 4)
        f = self if n < 3 else self._placed()
        made = lambda t: RETURNS[returns] if returns else T.DoubleType() if cells.is_numeric(t) else t
        one = lambda name: lambda row, *more: fn(*[row[0], name, *more][:n])
        out = f._cells(lambda name, c, t: per_row(one(name), [c], [] if n < 3 else [F.col(IDX), F.col(ORD)], made(t)))
        return out if n < 3 else self._new(out.sdf if self.index else out.sdf.drop(IDX), self.columns, self.index, out.order)

    map = applymap

    def apply(self, fn: Callable | str, axis: int | str = 0, returns: str | None = None, columnar: bool = False):
        """axis 0: an aggregate per column (a name, or a function of its values, name and place), as a Series by column.
        axis 1: a Python function of a row's dict, its label and position, as a Series by row; columnar: fn maps the
        dict of Columns to a Column instead."""
        from .aggregates import aggregate
        from .series import Series

        if axis in (1, "columns"):
            names = self.columns
            if columnar:
                return Series(self._select({"value": fn(self._all())}), "apply")
            n = arity(fn, 3)
            f = self if n == 1 else self._placed()
            numeric = any(cells.is_numeric(self.dtype(c)) for c in names)
            made = RETURNS[returns] if returns else T.DoubleType() if numeric else T.StringType()
            value = per_row(lambda row, *more: fn(dict(zip(names, row, strict=True)), *more[: n - 1]), list(self._all().values()), [] if n == 1 else [F.col(IDX), F.col(ORD)], made)
            out = f._select({"value": value})
            if not self.index:
                out._relabel = lambda: self._labelled()._select({"value": value}) if n == 1 else f._select({"value": value})
            return Series(out, "apply")
        if axis not in (0, "index"):
            raise ValueError("axis must be 0, 'index', 1 or 'columns'")
        n = 1 if isinstance(fn, str) else arity(fn, 3)
        of = lambda place, name: fn if isinstance(fn, str) else lambda v: fn(*[v, name, place][:n])
        row = self.sdf.agg(*[aggregate(of(i, name), c, self.dtype(name)).alias(name) for i, (name, c) in enumerate(self._all().items())]).first()
        return Series.create([row[c] for c in self.columns], index=self.columns, name="apply", spark=self.sdf.sparkSession)

    # order

    @keeps_labels
    def sort_values(self, keys: str | list[str], ascending: bool | list[bool] = True, limit: int | None = None, na_position: str = "last") -> Frame:
        """Stable sort by binary order; na_position holds in both directions; with limit, the first rows only."""
        names = [keys] if isinstance(keys, str) else list(keys)
        self._need(names)
        up = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
        if len(up) != len(names):
            raise ValueError("ascending must have one entry per key")
        if limit is not None and (not isinstance(limit, int) or limit < 0):
            raise ValueError("limit must be a non-negative integer")
        base = self if self.order is None else self._ordered()
        ties = [F.col(ORD)] if ORD in base.sdf.columns else []
        order = [by(F.col(f"`{c}`"), a, na_position == "first") for c, a in zip(names, up, strict=True)] + ties
        out = base._new(base.sdf, self.columns, self.index, order)
        return out if limit is None else out.head(limit)

    def sort_index(self, ascending: bool = True) -> Frame:
        o = self._labelled()
        return o._new(o.sdf, self.columns, True, [linguistic(F.col(IDX), o.sdf.schema[IDX].dataType, ascending), F.col(ORD)])

    @keeps_labels
    def drop_duplicates(self, subset: str | list[str] | None = None, keep: str | bool = "first", ignore_index: bool = False) -> Frame:
        """Null equals null. One aggregate by key takes the whole row of the least (greatest) ordinal, with map-side
        combine, so a frequent key isn't one task's, and no row is looked up by a number that a retry could change."""
        cols = [subset] if isinstance(subset, str) else list(subset or self.columns)
        self._need(cols)
        if keep not in ("first", "last", False):
            raise ValueError("keep must be 'first', 'last' or False")
        o = self._ordered()
        rest = [c for c in o.sdf.columns if c not in cols and c != ORD]
        picked = (F.max if keep == "last" else F.min)(ORD).alias("__at")
        row = (F.max_by if keep == "last" else F.min_by)(F.struct(*[F.col(f"`{c}`") for c in rest]), ORD).alias("__row") if rest else None
        n = [F.count(F.lit(1)).alias("__n")] if keep is False else []
        found = o.sdf.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(picked, *([row] if rest else []), *n)
        found = found.where("__n = 1") if n else found
        out = found.select(*[F.col("__row")[c].alias(c) if c in rest else F.col(f"`{c}`") for c in o.sdf.columns if c != ORD], F.col("__at").alias(ORD))
        return o._new(out, self.columns, self.index and not ignore_index, o.order)

    # delegates

    def groupby(self, by: str | list[str], dropna: bool = True, sort: bool = True, as_index: bool = False):
        from .groupby import GroupBy

        return GroupBy(self, by, dropna, sort, as_index)

    def _totals(self, name: str) -> dict[str, Any]:
        from .aggregates import named

        return self.sdf.agg(*[named(name, c, self.dtype(n)).alias(n) for n, c in self._all().items()]).first().asDict()

    def sum(self) -> dict[str, Any]:
        return self._totals("sum")

    def mean(self) -> dict[str, Any]:
        return self._totals("mean")

    def describe(self) -> Frame:
        """count, mean, std (sample), min, max of finite numbers, for columns that have any."""
        numeric = [c for c in self.columns if cells.is_numeric(self.dtype(c))]
        stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
        row = self.sdf.agg(F.lit(1).alias("__one"), *[s(cells.finite(F.col(f"`{c}`"), self.dtype(c))).alias(f"{k}|{c}") for c in numeric for k, s in stats.items()]).first()
        kept = [c for c in numeric if row[f"count|{c}"]]
        return Frame.create([{"stat": k} | {c: row[f"{k}|{c}"] for c in kept} for k in stats], index=list(stats), spark=self.sdf.sparkSession)

    def nunique(self, dropna: bool = True) -> dict[str, int]:
        from .counts import nunique

        return nunique(self, dropna)

    def value_counts(self, subset: str | list[str] | None = None, **options: Any) -> Frame:
        from .counts import value_counts

        return value_counts(self, subset, **options)

    def pivot_table(self, index: str | list[str], values: str | list[str], **options: Any) -> Frame:
        from .pivot import pivot_table

        return pivot_table(self, index, values, **options)

    def merge(self, right: Frame, on: str | list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> Frame:
        from .joins import merge

        return merge(self, right, on, how, suffixes)

    @keeps_labels
    def rank(self, **options: Any) -> Frame:
        from .ranks import rank

        return rank(self, **options)

    def sample(self, n: int = 1, frac: float | None = None, replace: bool = False, random_state: int | None = None, ignore_index: bool = False) -> Frame:
        seed = random.SystemRandom().randrange(2**32) if random_state is None else random_state
        return self._sampled(n, frac, replace, seed, ignore_index)

    @keeps_labels
    def _sampled(self, n: int, frac: float | None, replace: bool, seed: int, ignore_index: bool) -> Frame:
        from .ranks import sample

        return sample(self, n, frac, replace, seed, ignore_index)
