"""Decoders of files of tables without nesting: bytes to (table, header, declared types, rows of text or null).

A declared type of MIXED stands for the kinds of the values, which then come with each text.
"""

from __future__ import annotations

import io
import math
import re
import sqlite3
import struct
import zipfile
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from typing import Any

import numpy as np

from tabulore.functions.text import plain
from tabulore.operators.profile import MIXED

Table = tuple[str, list[str], list[str] | None, Iterator[list]]


def float32_text(x) -> str:
    return plain(float(np.format_float_positional(np.float32(x), unique=True))) if math.isfinite(x) else plain(float(x))


# NumPy


def dtype_label(dtype: np.dtype) -> str:
    if dtype.subdtype:
        inner, shape = dtype.subdtype
        out = dtype_label(inner)
        for _ in shape:
            out = f"Vec<{out}>"
        return out
    if dtype.fields:
        return "Struct"
    labels = {"b": "bool", "i": "i64", "u": "i64", "f": "f64", "S": "String", "U": "String", "M": "Timestamp", "m": "Timestamp", "c": "Complex", "V": "Bytes"}
    return labels.get(dtype.kind, "Object")


def dtype_text(value: np.ndarray, dtype: np.dtype) -> str:
    """value: one element, as an array without dimensions or with those of its own subarray."""
    if value.ndim:
        return ";".join(dtype_text(x, x.dtype) for x in (np.asarray(v) for v in value.reshape(-1)))
    kind, size = dtype.kind, dtype.itemsize
    if kind == "b":
        return "true" if value else "false"
    if kind in "iu":
        return str(int(value))
    if kind in "Mm":
        return str(int(value.view(f"{dtype.byteorder}u8" if dtype.byteorder in "<>" else "u8")))
    if kind == "f" and size == 4:
        return float32_text(value)
    if kind == "f" and size == 8:
        return plain(float(value))
    if kind == "S":
        return bytes(value.tobytes()).split(b"\0")[0].decode("utf-8", "replace")
    if kind == "U":
        return str(value).split("\0")[0]
    return value.tobytes().hex()


def array_table(name: str, array: np.ndarray, nrows: int | None) -> Table:
    dtype = array.dtype
    if dtype.fields:
        array = array.reshape(-1)
        names = list(dtype.names)
        types = [dtype_label(dtype.fields[n][0]) for n in names]
        rows = ([dtype_text(np.asarray(r[n]), np.asarray(r[n]).dtype) for n in names] for r in islice(array, nrows))
        return name, names, types, rows
    if array.ndim > 2:
        raise ValueError(f"a {array.ndim}-dimensional array without fields has no rows and columns; 1 or 2 dimensions are read")
    array = array.reshape(-1, 1) if array.ndim < 2 else array
    width = array.shape[1]
    names = ["value"] if width == 1 else [f"col_{i}" for i in range(width)]
    rows = ([dtype_text(np.asarray(x), dtype) for x in row] for row in islice(array, nrows))
    return name, names, [dtype_label(dtype)] * width, rows


def npy(data: bytes, table: str, nrows: int | None) -> list[Table]:
    return [array_table(table, np.load(io.BytesIO(data), allow_pickle=False), nrows)]


def npz(data: bytes, table: str, nrows: int | None) -> list[Table]:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        if not held.files:
            raise ValueError("the archive has no arrays")
        return [array_table(name, held[name], nrows) for name in held.files]


# Spreadsheets


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _cells_xlsx(book: zipfile.ZipFile) -> Iterator[tuple[str, list[list[str | None]]]]:
    shared: list[str] = []
    if "xl/sharedStrings.xml" in book.namelist():
        for item in ET.fromstring(book.read("xl/sharedStrings.xml")):
            shared.append("".join(t.text or "" for t in item.iter() if _local(t) == "t"))
    targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for sheet in (e for e in ET.fromstring(book.read("xl/workbook.xml")).iter() if _local(e) == "sheet"):
        target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        path = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        cells: dict[tuple[int, int], str] = {}
        row_at = 0
        for row in (e for e in ET.fromstring(book.read(path)).iter() if _local(e) == "row"):
            row_at = int(row.get("r", row_at + 1))
            column = 0
            for cell in row:
                place = re.match(r"[A-Z]+", cell.get("r", ""))
                column = _letters(place.group()) if place else column + 1
                text = _xlsx_text(cell, shared)
                if text is not None and text != "":
                    cells[(row_at, column)] = text
        yield sheet.get("name"), _grid(cells)


def _letters(text: str) -> int:
    n = 0
    for c in text:
        n = n * 26 + ord(c) - 64
    return n


def _xlsx_text(cell: ET.Element, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _local(t) == "t")
    value = next((v.text for v in cell if _local(v) == "v"), None)
    if value is None:
        return None
    if kind == "s":
        return shared[int(value)]
    if kind == "b":
        return "true" if value == "1" else "false"
    return plain(float(value)) if kind == "n" else value


def _cells_ods(book: zipfile.ZipFile) -> Iterator[tuple[str, list[list[str | None]]]]:
    def get(e: ET.Element, name: str) -> str | None:
        return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)

    for sheet in (e for e in ET.fromstring(book.read("content.xml")).iter() if _local(e) == "table"):
        cells: dict[tuple[int, int], str] = {}
        row_at = 0
        for row in (e for e in sheet.iter() if _local(e) == "table-row"):
            repeated, column = int(get(row, "number-rows-repeated") or 1), 0
            found: dict[int, str] = {}
            for cell in row:
                times, kind = int(get(cell, "number-columns-repeated") or 1), get(cell, "value-type")
                if kind in ("float", "percentage", "currency"):
                    text = plain(float(get(cell, "value")))
                elif kind == "boolean":
                    text = get(cell, "boolean-value")
                elif kind == "date":
                    text = get(cell, "date-value")
                else:
                    text = "\n".join("".join(p.itertext()) for p in cell if _local(p) == "p") if kind else ""
                if text:
                    found.update((column + k, text) for k in range(times))
                column += times
            if found:
                cells.update(((row_at + k, c), t) for k in range(repeated) for c, t in found.items())
            row_at += repeated
        yield get(sheet, "name"), _grid(cells)


def _grid(cells: dict[tuple[int, int], str]) -> list[list[str | None]]:
    """The used range."""
    if not cells:
        return []
    rows, columns = sorted({r for r, _ in cells}), sorted({c for _, c in cells})
    return [[cells.get((r, c)) for c in range(columns[0], columns[-1] + 1)] for r in range(rows[0], rows[-1] + 1)]


def spreadsheet(data: bytes, table: str, nrows: int | None) -> list[Table]:
    if not zipfile.is_zipfile(io.BytesIO(data)):
        raise ValueError("only xlsx and ods workbooks are read here; save an xls workbook as xlsx")
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = book.namelist()
        if "xl/workbook.bin" in names:
            raise ValueError("only xlsx and ods workbooks are read here; save an xlsb workbook as xlsx")
        sheets = list(_cells_ods(book) if "content.xml" in names else _cells_xlsx(book))
    out = [(name, [h or "" for h in grid[0]], None, islice(iter(grid[1:]), nrows)) for name, grid in sheets if grid]
    if not out:
        raise ValueError("the workbook has no sheet with cells")
    return out


# SQLite


def _stored(value: Any) -> tuple[str | None, str | None]:
    """Kind and text of a stored value."""
    if value is None:
        return None, None
    if isinstance(value, int):
        return "i64", str(value)
    if isinstance(value, float):
        return "f64", plain(value)
    if isinstance(value, bytes):
        return "Blob", f"<blob: {len(value)} bytes>"
    return "String", value


def sqlite(data: bytes, table: str, nrows: int | None) -> list[Table]:
    held = sqlite3.connect(":memory:")
    held.deserialize(data)
    held.text_factory = lambda b: b.decode("utf-8", "replace")
    names = [n for (n,) in held.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    if not names:
        raise ValueError("the database has no tables")
    out = []
    for name in names:
        quoted = '"' + name.replace('"', '""') + '"'
        found = held.execute(f"SELECT * FROM {quoted}" + ("" if nrows is None else f" LIMIT {int(nrows)}"))
        header = [d[0] for d in found.description]
        out.append((name, header, [MIXED] * len(header), ([_stored(v) for v in row] for row in found)))  # a row at a time
    return out


# dBase


def dbase(data: bytes, table: str, nrows: int | None) -> list[Table]:
    count, start, width = struct.unpack("<IHH", data[4:12])
    #: Field types.
    labels = {"C": "String", "M": "String", "N": "f64", "F": "f64", "B": "f64", "O": "f64", "Y": "f64", "I": "i64", "+": "i64", "L": "bool", "D": "Date", "T": "Timestamp", "@": "Timestamp"}
    fields, at = [], 32
    while data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(data[at + 11]), data[at + 16]))
        at += 32

    def text(kind: str, raw: bytes) -> str | None:
        held = raw.decode("latin-1").rstrip("\0").strip()
        if kind in "NF":
            return plain(float(held)) if held and "*" not in held else None
        if kind == "L":
            return {"t": "true", "y": "true", "f": "false", "n": "false"}.get(held[:1].lower())
        if kind == "D":
            return held or None
        if kind == "I":
            return str(struct.unpack("<i", raw)[0])
        if kind in "BO":
            return plain(struct.unpack("<d", raw)[0])
        if kind == "Y":
            return plain(struct.unpack("<q", raw)[0] / 10_000)
        if kind in "T@":
            day, ms = struct.unpack("<ii", raw)
            if not day:
                return None
            moment = datetime(1970, 1, 1) + timedelta(days=day - 2440588, milliseconds=ms)
            return moment.strftime("%Y%m%d %H:%M:%S")
        return held or None

    def rows() -> Iterator[list[str | None]]:
        for i in range(count):
            record = data[start + i * width : start + (i + 1) * width]
            if len(record) < width or record[:1] == b"*":
                continue
            at, out = 1, []
            for _, kind, size in fields:
                out.append(text(kind, record[at : at + size]))
                at += size
            yield out

    return [(table, [n for n, _, _ in fields], [labels.get(k, "String") for _, k, _ in fields], islice(rows(), nrows))]


# Stata and SAS, by pandas


def stata(data: bytes, table: str, nrows: int | None) -> list[Table]:
    import pandas as pd
    from pandas.io.stata import StataReader

    with StataReader(io.BytesIO(data), convert_categoricals=False, convert_dates=False, preserve_dtypes=True, convert_missing=True) as reader:
        frame = reader.read(nrows=nrows)
        kinds = [str(t) for t in getattr(reader, "_typlist", [])]
    from pandas.io.stata import StataMissingValue

    header = [str(c) for c in frame.columns]
    label = lambda t: {"b": "i64", "h": "i64", "l": "i64", "f": "f64", "d": "f64"}.get(t, "String")
    types = [label(k) for k in kinds]

    def text(value: Any, kind: str, raw: str) -> str | None:
        if isinstance(value, StataMissingValue) or value is None or value is pd.NaT:
            return None
        if kind == "i64":
            return str(int(value))
        if kind == "f64":
            if math.isnan(float(value)):
                return None
            return float32_text(value) if raw == "f" else plain(float(value))
        if raw in ("Q", "32768"):
            return "<strL: long string not resolved>"
        return str(value).strip() or None

    rows = ([text(v, k, raw) for v, k, raw in zip(row, types, kinds)] for row in frame.itertuples(index=False, name=None))
    return [(table, header, types, rows)]


#: How the names of SAS's formats of dates, of moments and of times of day begin, the longest first.
SAS_MOMENTS = ("DATETIME", "DATEAMPM", "DTDATE", "E8601DT", "B8601DT", "MDYAMPM", "NLDATM")
SAS_TIMES = ("TIME", "TOD", "HHMM", "HOUR", "MMSS", "E8601TM", "B8601TM", "NLTIM")
SAS_DATES = ("DATE", "DAY", "DDMMYY", "MMDDYY", "YYMMDD", "JULIAN", "MONYY", "WEEKDATE", "WORDDATE", "YYMM", "YYQ", "YEAR", "E8601DA", "B8601DA", "NLDATE")
SAS_EPOCH = datetime(1960, 1, 1)


def sas_kind(numeric: bool, form: str) -> str:
    for kind, names in (("Timestamp", SAS_MOMENTS), ("Time", SAS_TIMES), ("Date", SAS_DATES)):
        if numeric and form.upper().startswith(names):
            return kind
    return "f64" if numeric else "String"


def sas_text(value: Any, kind: str) -> str | None:
    """Numbers count days, or seconds, since 1960, or seconds since midnight."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if kind == "String":
        return value.hex() if isinstance(value, bytes) else str(value).strip() or None
    if kind == "f64":
        return plain(float(value))
    if kind == "Date":
        return (SAS_EPOCH + timedelta(days=math.floor(value))).strftime("%Y-%m-%d")
    if kind == "Timestamp":
        return (SAS_EPOCH + timedelta(seconds=math.floor(value))).strftime("%Y-%m-%d %H:%M:%S")
    seconds = int(value) if 0 <= value < 86400 else 0
    return f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"


def sas7bdat(data: bytes, table: str, nrows: int | None) -> list[Table]:
    from pandas.io.sas.sas7bdat import SAS7BDATReader

    with SAS7BDATReader(io.BytesIO(data), convert_dates=False, encoding="utf-8") as reader:
        frame = reader.read(nrows=None if nrows is None else max(1, nrows))
        types = [sas_kind(frame[c].dtype.kind in "fiu", str(form or "")) for c, form in zip(frame.columns, reader.column_formats)]
    rows = ([sas_text(v, k) for v, k in zip(row, types)] for row in frame.itertuples(index=False, name=None))
    return [(table, [str(c) for c in frame.columns], types, rows)]


DECODERS = {"npy": npy, "npz": npz, "xlsx": spreadsheet, "sqlite": sqlite, "dbase": dbase, "stata": stata, "sas7bdat": sas7bdat}
