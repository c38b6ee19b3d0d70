"""Parquet by Spark's reader and writer; Excel by the standard library."""

from __future__ import annotations

import re
import zipfile
from datetime import datetime, timedelta
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions.cells import kind
from ..operators.frame import Frame
from ..plans.ordering import IDX
from ..session import session
from .text import flat, with_index

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_parquet(path: str, columns: list[str] | None = None, index_col: str | int | None = None, spark: SparkSession | None = None) -> Frame:
    """Only the columns asked for are read; nested cells become JSON text."""
    sdf = (spark or session()).read.parquet(path)
    missing = [c for c in columns or [] if c not in sdf.columns]
    if missing:
        raise KeyError(f"Column '{missing[0]}' does not exist.")
    return with_index(flat(Frame(sdf.select(*columns) if columns else sdf)), index_col)


def to_parquet(f: Frame, path: str) -> None:
    """Numbers as doubles, dates as timestamps, booleans, and text for the rest; in the frame's order."""
    as_written = {"number": "double", "boolean": "boolean", "date": "timestamp", "string": "string"}
    cols = [F.col(f"`{c}`").cast(as_written[kind(f.dtype(c))]).alias(c) for c in f.columns]
    f._sorted().select(*cols).write.mode("overwrite").parquet(path)


def column_number(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def sheet_rows(path: str, sheet_name: str | int | None) -> list[list[Any]]:
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        sheets = [(s.get("name"), s.get(f"{REL}id")) for s in book.iter(f"{MAIN}sheet")]
        target = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        by_name = dict(sheets)
        if isinstance(sheet_name, str) and sheet_name not in by_name or isinstance(sheet_name, int) and not 0 <= sheet_name < len(sheets):
            raise ValueError(f"Sheet '{sheet_name}' does not exist.")
        ref = by_name[sheet_name] if isinstance(sheet_name, str) else sheets[sheet_name or 0][1]
        shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        dates = set()
        if "xl/styles.xml" in z.namelist():
            style = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {n.get("numFmtId") for n in style.iter(f"{MAIN}numFmt") if re.search("[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", n.get("formatCode") or ""))}
            formats = style.find(f"{MAIN}cellXfs")
            dates = {str(i) for i, x in enumerate(formats if formats is not None else []) if x.get("numFmtId") in own | {str(k) for k in (*range(14, 23), 45, 46, 47)}}
        rows = []
        for r in ElementTree.fromstring(z.read("xl/" + target[ref].removeprefix("/xl/"))).iter(f"{MAIN}row"):
            row: list[Any] = []
            for i, c in enumerate(r.iter(f"{MAIN}c")):
                at = column_number(c.get("r")) if c.get("r") else i
                row += [None] * (at + 1 - len(row))
                v, t = c.find(f"{MAIN}v"), c.get("t")
                text = v.text if v is not None else None
                if t == "inlineStr":
                    row[at] = "".join(x.text or "" for x in c.iter(f"{MAIN}t"))
                elif text is not None:
                    row[at] = shared[int(text)] if t == "s" else text == "1" if t == "b" else text if t == "str" else datetime(1899, 12, 30) + timedelta(days=float(text)) if c.get("s") in dates else float(text) if t in (None, "n") else None
            rows.append(row)
        return rows


def read_excel(path: str, sheet_name: str | int | None = None, header: bool = True, names: list[str] | None = None, index_col: str | int | None = None, spark: SparkSession | None = None) -> Frame:
    """One sheet (the driver reads it: the format isn't splittable and sheets end at a million rows)."""
    rows = [r for r in sheet_rows(path, sheet_name) if any(v is not None and v != "" for v in r)]
    head = rows[0] if rows else []
    body = rows[1:] if header else rows
    own = list(names or ([str(h) if h is not None else f"col_{i}" for i, h in enumerate(head)] if header else [f"col_{i}" for i in range(len(head))]))
    columns = own + [f"col_{i}" for i in range(len(own), max(map(len, body), default=0))]
    return with_index(Frame.create({c: [r[i] if i < len(r) else None for r in body] for i, c in enumerate(columns)}, spark=spark or session()), index_col)


read_excel_sync = read_excel


def to_excel(f: Frame, path: str, sheet_name: str = "Sheet1", index: bool = False) -> None:
    def cell(v: Any) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        if isinstance(v, datetime):
            return f'<c s="1"><v>{(v - datetime(1899, 12, 30)) / timedelta(days=1)!r}</v></c>'
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    g = f._labelled() if index else f
    cols = [*([IDX] if index else []), *f.columns]
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = [["index" if c == IDX else c for c in cols], *g._sorted().select(*[F.col(f"`{c}`") for c in cols]).toLocalIterator()]
    data = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in rows)
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}.styles+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="{escape(sheet_name)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{data}</sheetData></worksheet>")
