"""A PySpark-native analytics engine with a labelled, order-aware frame API."""

from .operators.frame import Frame
from .operators.groupby import GroupBy
from .operators.joins import concat, merge
from .operators.pivot import pivot_table
from .operators.series import Series
from .session import session
from .sources.files import read_excel, read_excel_sync, read_parquet
from .sources.text import parse_csv, parse_json, parse_table, parse_tsv, read_csv, read_csv_sync, read_json, read_json_sync, read_table, read_table_sync, read_tsv, read_tsv_sync

DataFrame = Frame


def to_csv(frame: Frame, path: str | None = None, **options) -> str | None:
    return frame.to_csv(path, **options)


def to_parquet(frame: Frame, path: str) -> None:
    frame.to_parquet(path)


def to_excel(frame: Frame, path: str, **options) -> None:
    frame.to_excel(path, **options)


__all__ = [
    "DataFrame", "Frame", "GroupBy", "Series", "concat", "merge", "parse_csv", "parse_json", "parse_table", "parse_tsv", "pivot_table", "read_csv", "read_csv_sync", "read_excel", "read_excel_sync",
    "read_json", "read_json_sync", "read_parquet", "read_table", "read_table_sync", "read_tsv", "read_tsv_sync", "session", "to_csv", "to_excel", "to_parquet",
]
