"""CSV, TSV, JSON and JSON lines."""

from __future__ import annotations

import csv
import io
import json
import re
import tempfile
from collections.abc import Iterator
from contextlib import ExitStack
from functools import partial
from itertools import chain, groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import kind, text_of
from ..operators.frame import Frame
from ..plans.ordering import IDX, ORD, ROW_BITS
from ..session import fresh_path, prepare, session, stored

#: Texts that count as missing, in any case.
NA = ("", "NaN", "NA", "null", "None")
QUOTED = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": "", "nullValue": "\0"}
NUMBER = r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"


def with_index(f: Frame, index_col: str | int | None) -> Frame:
    if index_col is None:
        return f
    name = f.columns[index_col] if isinstance(index_col, int) and -1 < index_col < len(f.columns) else index_col
    if name not in f.columns:
        raise ValueError("index_col does not match any column.")
    return f.set_index(name)


def typed(sdf: DataFrame, columns: list[str], na_values: list[str] | None) -> DataFrame:
    """Text columns as numbers or booleans where all their cells are; one aggregate finds the types."""
    missing = [v.strip().lower() for v in (NA if na_values is None else na_values)]
    cell = {c: F.when(~F.lower(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))).isin(missing), F.trim(F.col(f"`{c}`"))) for c in columns}
    if not columns:
        return sdf
    real = lambda v: v.rlike(NUMBER) & (F.abs(v.try_cast("double")) < float("inf"))
    seen = sdf.agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(cell.values())], *[F.count_if(real(v)).alias(f"d{i}") for i, v in enumerate(cell.values())], *[F.count_if(F.lower(v).isin("true", "false")).alias(f"b{i}") for i, v in enumerate(cell.values())]).first()

    def as_typed(i: int, v):
        n = seen[f"n{i}"]
        return v.cast("double") if n and seen[f"d{i}"] == n else (F.lower(v) == "true") if n and seen[f"b{i}"] == n else v

    return sdf.select(*[as_typed(i, v).alias(c) for i, (c, v) in enumerate(cell.items())], *[c for c in sdf.columns if c not in columns])


def shape_of(path: str, sep: str, spark: SparkSession) -> tuple[int, bool]:
    """How many cells the longest row has, and whether a quoted cell holds line ends (an odd number of quotes on a line).
    Separators within quotes don't count. Only where such cells exist, rows are read as a whole: Spark's parser reports
    them as they stand in the file when they don't fit a schema."""
    cells = lambda c: F.size(F.split(F.regexp_replace(c, r'"(?:[^"]|"")*+"?', ""), _literal(sep), -1))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    lines = spark.read.text(path).agg(F.max(cells(F.col("value"))), F.bool_or(quotes % 2 == 1)).first()
    if not lines[1]:
        return lines[0] or 0, False
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("_c0", "_whole")])
    whole = spark.read.csv(path, schema=schema, multiLine=True, columnNameOfCorruptRecord="_whole", mode="PERMISSIVE", sep=sep, **QUOTED)
    return max(1, whole.where("_c0 is not null or _whole is not null").agg(F.max(F.coalesce(cells(F.col("_whole")), F.lit(1)))).first()[0] or 0), True


#: Bits of a row's place within its file, below its file's number.
FILE_BITS = 40


def file_rows(sdf: DataFrame) -> DataFrame:
    """Rows of text files with the file, the place where their split begins, and an ordinal that follows each file."""
    return sdf.select("*", F.input_file_name().alias("__file"), F.input_file_block_start().alias("__block")).withColumn(ORD, F.monotonically_increasing_id())


def by_file(sdf: DataFrame, files: list[tuple[str, int | None]]) -> DataFrame:
    """file_rows in the order of the given files, without the row that is named beside a file. Spark deals files out by size.
    A place is its split's first byte and the row's number in the task: splits other than a file's last have tasks of
    their own, and no more rows than bytes."""
    ranks = sdf.sparkSession.createDataFrame([(f, k, at) for k, (f, at) in enumerate(files)], "__file string, __rank bigint, __at bigint")
    kept = sdf.join(F.broadcast(ranks), "__file").where(F.col("__at").isNull() | (F.col(ORD) != F.col("__at")))
    return kept.withColumn(ORD, F.shiftleft("__rank", FILE_BITS) + place()).drop("__file", "__block", "__rank", "__at")


def read_csv(path: str, sep: str = ",", header: bool = True, names: list[str] | None = None, index_col: str | int | None = None, na_values: list[str] | None = None, multiline: bool | None = None, spark: SparkSession | None = None) -> Frame:
    """Files as text columns, then one type per column. Rows longer than the header add columns `col_N`. Large files are
    split among tasks unless a quoted cell holds line ends (multiline, found out where it is None). A folder's files follow
    each other by name, and a first row that repeats the header of the first file is a header."""
    spark = spark or session()
    width, found = shape_of(path, sep, spark)
    wide = [f"_c{i}" for i in range(width)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in wide])
    read = lambda skip: file_rows(spark.read.csv(path, schema=schema, sep=sep, multiLine=found if multiline is None else multiline, header=skip, mode="PERMISSIVE", **QUOTED))
    filled = F.greatest(F.lit(0), F.lit(0), *[F.length(F.trim(F.coalesce(F.col(c), F.lit("")))) for c in wide]) > 0

    def first_rows(sdf: DataFrame) -> list:
        """A row a file: where its rows begin and where those with cells do, and the first of these."""
        own = F.when(filled, F.col(ORD))
        found = sdf.groupBy("__file").agg(F.min(ORD).alias("begin"), F.min(own).alias("at"), F.min_by(F.array(*wide), own).alias("row")).where("at is not null").collect() if wide else []
        return sorted(found, key=lambda r: r["__file"])

    def cells(row: list) -> list[str]:
        last = max((i for i, v in enumerate(row) if v is not None), default=-1)
        return [(v or "").lstrip("\ufeff").strip() for v in row[: last + 1]]

    sdf = read(False)
    files = first_rows(sdf)
    head = cells(files[0]["row"]) if files else []
    is_head = lambda r: header and cells(r["row"]) == head
    if len(files) > 1:
        if header and all(is_head(r) and r["begin"] == r["at"] for r in files):
            sdf = by_file(read(True), [(r["__file"], None) for r in files])
        else:
            if header:  # splits may be cut anew at every reading, so the rows are numbered once
                sdf = stored(sdf, "lines")
                files = first_rows(sdf)
            sdf = by_file(sdf, [(r["__file"], r["at"] if is_head(r) else None) for r in files])
    else:
        sdf = sdf.drop("__file", "__block")
        sdf = sdf.where(F.col(ORD) != files[0]["at"]) if header and files else sdf
    sdf = sdf.where(filled) if wide else sdf
    own = list(names or ([h or f"col_{i}" for i, h in enumerate(head)] if header else [f"col_{i}" for i in range(len(head))]))
    columns = own + [f"col_{i}" for i in range(len(own), width)]
    out = sdf.select(*[(F.col(f"_c{i}") if i < width else F.lit(None).cast("string")).alias(n) for i, n in enumerate(columns)], ORD)
    return with_index(Frame(typed(out, columns, na_values), columns, False, [F.col(ORD)]), index_col)


def _literal(sep: str) -> str:
    return "\\Q" + sep + "\\E"


def parse_csv(text: str, sep: str = ",", header: bool = True, names: list[str] | None = None, index_col: str | int | None = None, na_values: list[str] | None = None, spark: SparkSession | None = None) -> Frame:
    """A text that the driver holds."""
    rows = [r for r in csv.reader(io.StringIO(text.lstrip("﻿"), newline=""), delimiter=sep) if any(c.strip() for c in r)]
    head = rows[0] if rows else []
    body = rows[1:] if header else rows
    own = list(names or ([h.strip() or f"col_{i}" for i, h in enumerate(head)] if header else [f"col_{i}" for i in range(len(head))]))
    columns = own + [f"col_{i}" for i in range(len(own), max(map(len, body), default=0))]
    made = [(*[r[i] if i < len(r) else None for i in range(len(columns))], k) for k, r in enumerate(body)]
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField(ORD, T.LongType())])
    sdf = (spark or session()).createDataFrame(made, schema)
    return with_index(Frame(typed(sdf, columns, na_values), columns, False, [F.col(ORD)]), index_col)


read_csv_sync = read_csv


def read_table(path: str, sep: str = "\t", **options: Any) -> Frame:
    return read_csv(path, sep=sep, **options)


def parse_table(text: str, sep: str = "\t", **options: Any) -> Frame:
    return parse_csv(text, sep=sep, **options)


read_table_sync = read_tsv = read_tsv_sync = read_table
parse_tsv = parse_table


NESTED = (T.StructType, T.ArrayType, T.MapType)


def flat(f: Frame, numbers: bool = False) -> Frame:
    """Nested cells as JSON text; whole numbers as doubles where `numbers` (JSON has one kind of number)."""
    cell = lambda n, c, t: F.to_json(c, {"ignoreNullFields": "false"}) if isinstance(t, NESTED) else c.cast("double") if numbers and isinstance(t, T.LongType) else c
    return f._cells(cell)


def first_seen(keys: DataFrame) -> list[str]:
    """Names by first place, from rows (a: array of names, at: the row's number); as many as there are columns."""
    seen = keys.select("at", F.posexplode("a").alias("i", "k")).groupBy("k").agg(F.min(F.struct("at", "i")).alias("first"))
    return [r["k"] for r in seen.orderBy("first").select("k").collect()]


def place() -> Column:
    """Of a row of file_rows within its file."""
    return F.col("__block") + F.col(ORD).bitwiseAND(F.lit((1 << ROW_BITS) - 1))


def as_lines(pieces: DataFrame) -> str:
    """A folder of JSON lines in the order of the files, each an array of records that comes in pieces cut at `}`. The
    pieces of a file pass through one task, in order; it holds a batch of them and an unfinished record."""
    spark = prepare(pieces.sparkSession)
    path = fresh_path(spark, "records")
    sorted_pieces = pieces.withColumn("__place", place()).repartitionByRange("__file").sortWithinPartitions("__file", "__place")
    sorted_pieces.select("__file", "value").mapInArrow(record_lines, "value string").write.text(path)
    return path


def record_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A line a record; what isn't JSON becomes a line that isn't, which its reader reports."""
    decode, space = json.JSONDecoder().raw_decode, re.compile(r"\s*")
    file, rest, opened, closed, after = None, "", False, False, False  # after: True after a record, None after a comma
    for batch in chain(batches, [None]):
        runs = [(None, None)] if batch is None else [(f, [v for _, v in run]) for f, run in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), key=lambda x: x[0])]
        for name, values in runs:
            if name != file:
                if file is not None and (rest.strip() or not closed):
                    yield text_batch(["broken"])
                file, rest, opened, closed, after = name, "", False, False, False
                text = "}".join(values).lstrip("\ufeff") if values else ""
            else:
                text = rest + "}" + "}".join(values)
            if name is None:
                continue
            at, lines = 0, []
            while not closed:
                at = space.match(text, at).end()
                mark = text[at : at + 1]
                if not opened and mark == "[":
                    opened, at = True, at + 1
                elif opened and mark == "]" and after is not None:
                    closed, at = True, at + 1
                elif after and mark == ",":
                    after, at = None, at + 1
                elif opened and not after and mark == "{":
                    try:
                        end = decode(text, at)[1]
                    except ValueError:  # unfinished, or broken: then it stays to the end
                        break
                    lines.append(text[at:end].replace("\n", " ").replace("\r", " "))
                    at, after = end, True
                elif mark:
                    lines.append("broken")
                    at, closed = len(text), True
                else:
                    break
            rest = text[at:].strip()[:200] if closed else text[at:]
            if lines:
                yield text_batch(lines)


def read_json(path: str, orient: str | None = None, lines: bool = False, index_col: str | int | None = None, spark: SparkSession | None = None) -> Frame:
    """An array of records, an object of column lists, or (lines) one record a line; columns in first-seen order. Files
    are parsed by the executors: by the line (arrays are written as lines first), column lists whole."""
    if lines and orient == "list":
        raise ValueError("lines needs orient 'records'")
    spark = spark or session()
    if lines:
        texts = file_rows(spark.read.text(path)).where(F.trim("value") != "")
        names = first_seen(texts.select(F.json_object_keys("value").alias("a"), F.struct("__file", ORD).alias("at")))
        files = {r[0] for r in texts.select("__file").distinct().collect()}
        sdf = file_rows(spark.read.json(path))
    else:
        pieces = file_rows(spark.read.text(path, lineSep="}"))
        text = F.regexp_replace("value", "^[\ufeff\\s]+", "")
        begun = pieces.where(text != "").groupBy("__file").agg(F.min_by(F.substring(text, 1, 1), ORD)).collect()  # a row a file
        files, starts = {r[0] for r in begun}, {r[1] for r in begun}
        shape = "list" if starts == {"{"} else "records" if starts == {"["} else None
        if shape is None or orient not in (None, shape):
            raise ValueError("JSON does not have the shape of its orient")
        if shape == "records":
            return read_json(as_lines(pieces), lines=True, index_col=index_col, spark=spark)
        whole = file_rows(spark.read.text(path, wholetext=True).select(text.alias("value"))).where("value <> ''")
        sdf = file_rows(spark.read.json(path, multiLine=True))
        names = first_seen(whole.select(F.json_object_keys("value").alias("a"), F.col("__file").alias("at")))
        if any(not isinstance(sdf.schema[c].dataType, T.ArrayType) for c in names):
            raise ValueError("JSON columns must be arrays")
        sdf = sdf.select(F.inline(F.arrays_zip(*[F.col(f"`{c}`") for c in names])).alias(*names), "__file", "__block").withColumn(ORD, F.monotonically_increasing_id()) if names else sdf
    if "_corrupt_record" in sdf.columns and "_corrupt_record" not in names:
        raise ValueError("JSON must hold records or column lists")
    if not names:
        return Frame.create([], spark=spark)
    sdf = sdf.select(*[F.col(f"`{c}`") for c in names], "__file", "__block", ORD)
    sdf = by_file(sdf, [(x, None) for x in sorted(files)]) if len(files) > 1 else sdf.drop("__file", "__block")
    return with_index(flat(Frame(sdf, names, False, [F.col(ORD)]), numbers=True), index_col)


def parse_json(text: str, orient: str | None = None, lines: bool = False, index_col: str | int | None = None, spark: SparkSession | None = None) -> Frame:
    if lines and orient == "list":
        raise ValueError("lines needs orient 'records'")
    data = [json.loads(x) for x in text.splitlines() if x.strip()] if lines else json.loads(text.lstrip("﻿"))
    if orient == "list" and not isinstance(data, dict) or orient == "records" and not isinstance(data, list):
        raise ValueError("JSON does not have the shape of its orient")
    if not isinstance(data, (list, dict)) or isinstance(data, list) and not all(isinstance(r, dict) for r in data):
        raise ValueError("JSON must hold records or column lists")
    plain = lambda v: json.dumps(v, ensure_ascii=False, separators=(",", ":")) if isinstance(v, (list, dict)) else v
    data = {k: [plain(x) for x in v] for k, v in data.items()} if isinstance(data, dict) else [{k: plain(x) for k, x in r.items()} for r in data]
    return with_index(Frame.create(data, spark=spark), index_col)


read_json_sync = read_json


def _text(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return str(int(v)) if v.is_integer() and abs(v) < 1e21 else str(v)
    return v.isoformat(timespec="milliseconds") + "Z" if hasattr(v, "isoformat") else str(v)


def csv_text(f: Frame, path: str | None, sep: str, header: bool, index: bool) -> str:
    """One text, from sorted rows as they arrive; csv_parts writes large frames."""

    def cell(v: Any) -> str:
        t = _text(v)
        return '"' + t.replace('"', '""') + '"' if sep in t or "\n" in t or '"' in t else t

    g = f._labelled() if index else f
    cols = [*([IDX] if index else []), *f.columns]
    out = [sep.join(cell("index" if c == IDX else c) for c in cols)] if header else []
    out += [sep.join(map(cell, r)) for r in g._sorted().select(*[F.col(f"`{c}`") for c in cols]).toLocalIterator()]
    text = "\n".join(out) + "\n"
    if path:
        with open(path, "w", encoding="utf-8") as file:
            file.write(text)
    return text


def csv_parts(f: Frame, path: str, sep: str, header: bool, index: bool) -> None:
    """Part files in path, each with its header, written in the frame's order: cells as in csv_text."""
    g = f._labelled() if index else f
    cols = {**({"index": IDX} if index else {}), **{c: c for c in f.columns}}
    types = g.sdf.schema
    cells = [text_of(F.col(f"`{c}`"), types[c].dataType).alias(n) for n, c in cols.items()]
    g._sorted().select(*cells).write.csv(path, sep=sep, header=header, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def json_parts(f: Frame, path: str, orient: str, lines: bool) -> None:
    """Part files in path, in the frame's order; nulls are written. A record a line, or (not lines) each file a document of
    its own: an array of its records, or an object of its column lists. Documents are written as rows arrive."""
    if orient not in ("records", "list") or lines and orient == "list":
        raise ValueError("lines needs orient 'records'")
    cells = {n: text_of(c, f.dtype(n)) if kind(f.dtype(n)) == "date" else c for n, c in f._all().items()}
    if orient == "records":
        rows = f._sorted().select(F.to_json(F.struct(*[c.alias(n) for n, c in cells.items()]), {"ignoreNullFields": "false"}).alias("value"))
    else:  # a cell's JSON is that of {"v":cell} without its frame
        one = [F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) for c in cells.values()]
        rows = f._sorted().select(*[F.substr(j, F.lit(6), F.length(j) - 6).alias(f"c{i}") for i, j in enumerate(one)])
    if not lines:
        prepare(rows.sparkSession)
        # a frame without rows may have no partition that could write
        base = rows.sparkSession.createDataFrame([], rows.schema).repartition(1) if f.empty else rows
        rows = base.mapInArrow(array_lines if orient == "records" else partial(list_lines, names=list(cells)), "value string")
    rows.write.text(path)


def text_batch(lines: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(lines, pa.string())], ["value"])


def array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of one JSON array of the records."""
    before = "["
    for batch in batches:
        if batch.num_rows:
            first, *rest = batch.column(0).to_pylist()
            yield text_batch([before + first, *["," + r for r in rest]])
            before = ","
    yield text_batch(["[]" if before == "[" else "]"])


def list_lines(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The lines of one JSON object of lists. Columns wait in files of the task's, as each comes as a whole."""
    with ExitStack() as stack:
        files = [stack.enter_context(tempfile.TemporaryFile("w+", encoding="utf-8", newline="\n")) for _ in names]
        before = ""
        for batch in batches:
            if batch.num_rows:
                for file, column in zip(files, batch.columns, strict=True):
                    file.write(before + ",".join(column.to_pylist()) + "\n")
                before = ","
        for i, (name, file) in enumerate(zip(names, files, strict=True)):
            yield text_batch([("]," if i else "{") + json.dumps(name, ensure_ascii=False) + ":["])
            file.seek(0)
            for line in file:
                yield text_batch([line.rstrip("\n")])
        yield text_batch(["]}" if names else "{}"])


def json_text(f: Frame, path: str | None, orient: str, space: int, lines: bool) -> str:
    if lines and orient != "records":
        raise ValueError("lines needs orient 'records'")
    whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else _text(v) if hasattr(v, "isoformat") else v
    if orient == "list":
        text = json.dumps({k: list(map(whole, v)) for k, v in f.to_dict("list").items()}, ensure_ascii=False, indent=space or None)
    else:
        rows = [{k: whole(v) for k, v in r.items()} for r in f.to_records()]
        text = "\n".join(json.dumps(r, ensure_ascii=False, separators=(",", ":")) for r in rows) if lines else json.dumps(rows, ensure_ascii=False, indent=space or None)
    if path:
        with open(path, "w", encoding="utf-8") as file:
            file.write(text + "\n")
    return text
