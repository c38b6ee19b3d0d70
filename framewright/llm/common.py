"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, prepare, shared_dir, stored

__all__ = ["cut", "discard", "fold_of", "held_out", "let", "numbered", "prepare", "shared_dir", "table"]


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, and what
    follows survives the loss of executors without computing df again."""
    return stored(df, "cut")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body names it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: fold 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    """Null ids count as learnable."""
    return F.coalesce(fold_of(doc_id) == 1, F.lit(False))


def numbered(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ... in place of their names, which could clash with an operator's own."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
