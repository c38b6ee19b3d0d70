"""Merging by null-safe keys, and concatenation along rows or labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType

from ..functions.cells import is_numeric, text_of
from ..plans.ordering import IDX, ORD
from .frame import Frame

WHOLE = (ByteType, ShortType, IntegerType, LongType)
HOWS = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def merge(left: Frame, right: Frame, on: str | list[str], how: str = "inner", suffixes: tuple[str, str] = ("_x", "_y")) -> Frame:
    """Equi-join in which null keys match null. Rows follow the left order, then the right; rows that only the
    right has come last. Neither side is moved for the order: it's sort keys that apply when rows are read."""
    keys = [on] if isinstance(on, str) else list(on)
    if not keys:
        raise ValueError("merge needs at least one key")
    if how not in HOWS:
        raise ValueError(f"unknown how: {how}")
    left._need(keys), right._need(keys)
    both = (set(left.columns) & set(right.columns)) - set(keys)
    a, b = left._ordered(), right._ordered()
    l = a.sdf.select(*[F.col(f"`{c}`").alias(f"l.{c}") for c in left.columns], F.col(ORD).alias("__lo"))  # noqa: E741
    r = b.sdf.select(*[F.col(f"`{c}`").alias(f"r.{c}") for c in right.columns], F.col(ORD).alias("__ro"))
    cond = reduce(lambda x, y: x & y, [F.col(f"`l.{k}`").eqNullSafe(F.col(f"`r.{k}`")) for k in keys])
    joined = l.join(r, cond, HOWS[how])
    key = lambda k: F.when(F.col("__lo").isNull(), F.col(f"`r.{k}`")).otherwise(F.col(f"`l.{k}`"))
    cols = {c + suffixes[0] if c in both else c: key(c) if c in keys and how in ("right", "outer") else F.col(f"`l.{c}`") for c in left.columns}
    cols |= {c + suffixes[1] if c in both else c: F.col(f"`r.{c}`") for c in right.columns if c not in keys}
    out = joined.select(*[c.alias(n) for n, c in cols.items()], F.col("__lo"), F.col("__ro"))
    return left._new(out, list(cols), order=[F.col("__lo").asc_nulls_last(), F.col("__ro").asc_nulls_last()])


def label_type(frames: list[Frame]) -> str:
    """One type for all frames' labels: whole numbers, numbers, or text where they differ."""
    types = [f.sdf.schema[IDX].dataType for f in frames]
    if all(is_numeric(t) for t in types):
        return "double" if any(not isinstance(t, WHOLE) for t in types) else "bigint"
    return "string"


def as_label(t: DataType, to: str) -> Column:
    return text_of(F.col(IDX), t) if to == "string" else F.col(IDX).cast(to)


def concat(frames: list[Frame], axis: int = 0, ignore_index: bool = False) -> Frame:
    """axis 0: rows with their labels, columns by name in first-seen order. axis 1: full alignment by label; of rows that
    share a label the last counts, and repeated column names get _1, _2. No frames make an empty one."""
    if axis not in (0, 1):
        raise ValueError("axis must be 0 or 1")
    if not frames:
        return Frame.create([])
    if axis == 0:
        labelled = not ignore_index and any(f.index for f in frames)
        out = stacked([f._labelled() for f in frames] if labelled else frames, labelled)
        if not ignore_index and not labelled:
            out._relabel = lambda: stacked([f._labelled() for f in frames], True)
        return out
    frames = [f._labelled() for f in frames]
    out, names, to = None, [], label_type(frames)
    for i, o in enumerate(frames):
        latest = F.max_by(F.struct(*[F.col(f"`{c}`").alias(c) for c in o.columns], F.lit(1).alias("__one")), ORD).alias(f"__v{i}")
        part = o.sdf.groupBy(as_label(o.sdf.schema[IDX].dataType, to).alias(f"__k{i}")).agg(latest, F.min(F.struct(F.lit(i).alias("f"), F.col(ORD).alias("o"))).alias(f"__o{i}"))
        if out is None:
            out = part.withColumnsRenamed({"__k0": IDX, "__o0": ORD})
        else:
            both = out.join(part, F.col(IDX).eqNullSafe(F.col(f"__k{i}")), "full")
            is_new = F.col(ORD).isNull()
            out = both.withColumn(IDX, F.when(is_new, F.col(f"__k{i}")).otherwise(F.col(IDX))).withColumn(ORD, F.coalesce(ORD, f"__o{i}")).drop(f"__k{i}", f"__o{i}")
    cols, seen = [], {}
    for i, f in enumerate(frames):
        for c in f.columns:
            n = f"{c}_{seen[c]}" if seen.get(c) else c
            seen[c] = seen.get(c, 0) + 1
            names.append(n)
            cols.append(F.col(f"__v{i}")[c].alias(n))
    return frames[0]._new(out.select(*cols, IDX, ORD) if not ignore_index else out.select(*cols, ORD), names, index=not ignore_index, order=[F.col(ORD)])


def stacked(frames: list[Frame], labelled: bool) -> Frame:
    cols = list(dict.fromkeys(c for f in frames for c in f.columns))
    to = label_type(frames) if labelled else ""
    parts = []
    for i, f in enumerate(frames):
        o = f._ordered()
        label = [as_label(o.sdf.schema[IDX].dataType, to).alias(IDX)] if labelled else []
        parts.append(o.sdf.select(*[F.col(f"`{c}`") for c in f.columns], F.struct(F.lit(i).alias("f"), F.col(ORD).alias("o")).alias(ORD), *label))
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return frames[0]._new(out, cols, index=labelled, order=[F.col(ORD)])
