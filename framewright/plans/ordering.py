"""Row order as data: hidden order columns, sort keys, dense positions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import sort_text
from ..session import stored

ORD, IDX = "__ord", "__idx"
#: monotonically_increasing_id holds the partition above these bits and the row within it in them.
ROW_BITS = 33
#: Operators that keep rows in the order of a scan's partitions and do so again when a task is repeated.
STEADY = {"Project", "Filter", "Scan", "FileScan", "BatchScan", "LocalTableScan", "ColumnarToRow", "WholeStageCodegen", "InputAdapter", "RDDScan"}


def by(c: Column, ascending: bool = True, nulls_first: bool = False) -> Column:
    if ascending:
        return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()
    return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()


def linguistic(c: Column, dtype: T.DataType, ascending: bool = True) -> Column:
    """The order of group keys, labels and ranks: missing last, text by root collation."""
    return by(sort_text(c) if isinstance(dtype, T.StringType) else c, ascending)


def is_steady(sdf: DataFrame) -> bool:
    """Whether the plan is a chain of narrow operators over one scan, so that its rows' places never change."""
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    names = [m.group(1) for line in plan.splitlines() if (m := re.match(r"[\s:+\-*()\d]*([A-Za-z]+)", line))]
    return set(names) <= STEADY


def dense(sdf: DataFrame, order: list[Column] | None, name: str = ORD) -> DataFrame:
    """sdf with dense positions 0.. in the given order (None, or steady rows: as they lie). Rows are counted per
    partition; the sums of the partitions before (a row a partition) are broadcast and added to a row's place in its own.
    Rows that have to be sorted are written first, in one range exchange, as a repeated sort could cut its ranges elsewhere."""
    placed = (sdf if order is None else sdf.orderBy(*order)).withColumn("__m", F.monotonically_increasing_id())
    if order is not None or not is_steady(sdf):
        placed = stored(placed, "positions")
    part = F.shiftright(F.col("__m"), ROW_BITS)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n")).orderBy("__part").collect()  # a row a partition
    starts, at = [], 0
    for r in counts:
        starts.append((r["__part"], at))
        at += r["n"]
    offsets = sdf.sparkSession.createDataFrame(starts, "__part bigint, __start bigint")
    row = F.col("__m").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    joined = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return joined.withColumn(name, F.col("__start") + row).drop("__part", "__start", "__m")
