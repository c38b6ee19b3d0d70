"""Cell-level semantics as Column expressions: missing is null only; numbers count where they are finite."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FRACTION = (T.FloatType, T.DoubleType)
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, NUMERIC)


def kind(dtype: T.DataType) -> str:
    if is_numeric(dtype):
        return "number"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "date"
    return "string"


def value_kind(v: Any) -> str:
    return "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "date" if isinstance(v, datetime) else "string"


def finite(c: Column, dtype: T.DataType) -> Column:
    """The cell as a double if it is a finite number, else null."""
    if not is_numeric(dtype):
        return F.lit(None).cast("double")
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d) if isinstance(dtype, FRACTION) else d


def text_of(c: Column, dtype: T.DataType) -> Column:
    """The cell as text; whole numbers without a fraction part."""
    if isinstance(dtype, FRACTION):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e21)
        return F.when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), F.when(c > 0, "Infinity").otherwise("-Infinity")).when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string"))
    if kind(dtype) == "date":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return c.cast("string")


def cast(c: Column, dtype: T.DataType, to: str) -> Column:
    """astype for one column: number, string, boolean or date; what can't be cast is null."""
    have = kind(dtype)
    if to == "string":
        return text_of(c, dtype)
    if to == "number":
        if have == "number":
            return finite(c, dtype)
        if have == "boolean":
            return c.cast("int").cast("double")
        if have == "date":
            return F.unix_millis(c.cast("timestamp")).cast("double")
        t = F.trim(c)
        hexa = F.conv(F.substring(t, 3, 16), 16, 10).cast("double")
        return F.when(t == "", 0.0).when(t.rlike("^0[xX][0-9a-fA-F]{1,13}$"), hexa).when(t.rlike(NUMBER_TEXT), finite(t.try_cast("double"), T.DoubleType()))
    if to == "boolean":
        if have == "boolean":
            return c
        if have == "number":
            d = c.cast("double")
            return (d != 0) & ~F.isnan(d)
        if have == "date":
            return F.when(c.isNotNull(), True)
        t = F.lower(F.trim(c))
        return F.when(t.isin("false", "0", "no", "n", ""), False).when(c.isNotNull(), True)
    if to == "date":
        if have == "date":
            return c.cast("timestamp_ntz")
        return F.try_to_timestamp(text_of(c, dtype)).cast("timestamp_ntz")
    raise ValueError(f"unknown dtype: {to}")


def matches(c: Column, dtype: T.DataType, values: list[Any]) -> Column:
    """Whether the cell is one of the values: by type, null equal to null, NaN to NaN."""
    own = [v for v in values if v is not None and value_kind(v) == kind(dtype)]
    found = F.coalesce(c.isin(own), F.lit(False)) if own else F.lit(False)
    return found | c.isNull() if any(v is None for v in values) else found


def clip(c: Column, dtype: T.DataType, lower: float | None, upper: float | None) -> Column:
    if not is_numeric(dtype) or lower is None and upper is None:
        return c
    if lower is not None and upper is not None and lower > upper:
        raise ValueError("lower must be <= upper")
    d = c.cast("double")
    real = ~F.isnan(d)
    out = F.when(F.lit(False), d)
    if lower is not None:
        out = out.when(real & (d < lower), float(lower))
    if upper is not None:
        out = out.when(real & (d > upper), float(upper))
    return out.otherwise(d)


def widened(c: Column, dtype: T.DataType, value: Any) -> tuple[Column, Column]:
    """The column and a literal in a type that holds both: their own, else text."""
    if value_kind(value) == kind(dtype):
        return (c.cast("double"), F.lit(float(value))) if is_numeric(dtype) and isinstance(value, float) else (c, F.lit(value))
    return text_of(c, dtype), text_of(F.lit(value), T.DoubleType() if value_kind(value) == "number" else T.StringType()) if value_kind(value) == "number" else F.lit(str(value).lower() if isinstance(value, bool) else str(value))


def fill(c: Column, dtype: T.DataType, value: Any) -> Column:
    if value is None:
        return c
    a, b = widened(c, dtype, value)
    return F.coalesce(a, b)


def replace(c: Column, dtype: T.DataType, pairs: list[tuple[list[Any], Any]]) -> Column:
    """Cells that equal one of a pair's values become its replacement; the first pair that fits counts."""
    fitting = [(v, r) for v, r in pairs if any(x is None or value_kind(x) == kind(dtype) for x in v)]
    if not fitting:
        return c
    as_text = any(r is not None and value_kind(r) != kind(dtype) for _, r in fitting)
    out = F.when(F.lit(False), F.lit(None))
    for values, r in fitting:
        new = F.lit(None) if r is None else widened(F.lit(None).cast("string"), T.StringType(), r)[1] if as_text else F.lit(r)
        out = out.when(matches(c, dtype, values), new)
    return out.otherwise(text_of(c, dtype) if as_text else c)


def sort_text(c: Column) -> Column:
    """Text by linguistic root order, for use as a sort key only."""
    return F.collate(c, "UNICODE")
