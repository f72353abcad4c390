"""Queries that write a small table of the driver's in every format, read it back, and render dictionaries; with SQL that says the same.

The SQL spells out what a reader must say: names, types, how values are written, and the titles of the renderings."""

from __future__ import annotations

import csv
import gzip
import io
import json
import posixpath
import sqlite3
import struct
import uuid
import zipfile
from collections.abc import Callable
from datetime import date
from typing import Any
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulore.plans.dictionary import profile, profile_path
from tabulore.plans.render import render
from tabulore.plans.shared import shared_folder

Row = dict[str, Any]
Query = Callable[[SparkSession, str], DataFrame]
SHOWN = ["name", "current_type", "ideal_type", "missing_pct", "sample_values", "notes"]
MADE = "s_suppkey AS id, s_name AS name, lpad(CAST(s_nationkey AS {text}), 5, '0') AS zip, s_acctbal AS balance, s_nationkey % 2 = 0 AS ok, CASE WHEN s_suppkey % 3 <> 0 THEN concat('n|', CAST(s_nationkey AS {text})) END AS note, {day} AS day"
SPARK_DAY, SQL_DAY = "date_add(DATE'2024-01-01', cast(s_suppkey % 28 as int))", "DATE '2024-01-01' + CAST(s_suppkey % 28 AS INTEGER)"


def made(spark: SparkSession, sf_dir: str) -> list[Row]:
    found = spark.read.parquet(f"{sf_dir}/supplier.parquet").withColumn("rec", F.col("_metadata.row_index"))
    rows = spark.sql(f"SELECT rec, {MADE.format(text='STRING', day=SPARK_DAY)} FROM {{rows}} ORDER BY rec", rows=found).collect()
    return [{k: v for k, v in r.asDict().items() if k != "rec"} for r in rows]


def stored(spark: SparkSession, name: str, data: bytes) -> str:
    """The path of a file of these bytes in the shared folder."""
    folder = f"{shared_folder(spark)}/formats-{uuid.uuid4().hex}"
    fs, at = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(posixpath.join(at, name), compression=None) as out:
        out.write(data)
    return f"{folder}/{name}"


# Writers


def text_of(value: Any) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def delimited(rows: list[Row], by: str) -> bytes:
    out = io.StringIO()
    to = csv.writer(out, delimiter=by)
    to.writerows([list(rows[0]), *([text_of(v) for v in r.values()] for r in rows)])
    return out.getvalue().encode()


def plain_json(row: Row) -> Row:
    return {k: v.isoformat() if isinstance(v, date) else v for k, v in row.items()}


def json_lines(rows: list[Row]) -> bytes:
    return "".join(json.dumps(plain_json(r)) + "\n" for r in rows).encode()


def msgpack_of(x: Any) -> bytes:
    if x is None or isinstance(x, bool):
        return {None: b"\xc0", True: b"\xc3", False: b"\xc2"}[x]
    if isinstance(x, (int, float)):
        return struct.pack(">Bq", 0xD3, x) if isinstance(x, int) else struct.pack(">Bd", 0xCB, x)
    if isinstance(x, str):
        return struct.pack(">BI", 0xDB, len(x.encode())) + x.encode()
    return struct.pack(">BI", 0xDF, len(x)) + b"".join(msgpack_of(k) + msgpack_of(v) for k, v in x.items())


def cbor_of(x: Any) -> bytes:
    if x is None or isinstance(x, bool):
        return {None: b"\xf6", True: b"\xf5", False: b"\xf4"}[x]
    if isinstance(x, float):
        return struct.pack(">Bd", 0xFB, x)
    head = lambda major, n: struct.pack(">BQ", major << 5 | 27, n)
    if isinstance(x, int):
        return head(0, x) if x >= 0 else head(1, -1 - x)
    if isinstance(x, str):
        return head(3, len(x.encode())) + x.encode()
    return head(5, len(x)) + b"".join(cbor_of(k) + cbor_of(v) for k, v in x.items())


def avro(rows: list[Row]) -> bytes:
    def long(n: int) -> bytes:
        n, out = n << 1 ^ n >> 63, bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    text = lambda s: long(len(s.encode())) + s.encode()
    kinds = {"id": "long", "name": "string", "zip": "string", "balance": "double", "ok": "boolean", "note": ["null", "string"], "day": {"type": "int", "logicalType": "date"}}
    schema = json.dumps({"type": "record", "name": "Row", "fields": [{"name": k, "type": v} for k, v in kinds.items()]})
    body = b"".join(
        long(r["id"]) + text(r["name"]) + text(r["zip"]) + struct.pack("<d", r["balance"]) + bytes([r["ok"]]) + (long(0) if r["note"] is None else long(1) + text(r["note"])) + long((r["day"] - date(1970, 1, 1)).days)
        for r in rows
    )
    return b"Obj\x01" + long(2) + text("avro.schema") + text(schema) + text("avro.codec") + text("null") + long(0) + b"-" * 16 + long(len(rows)) + long(len(body)) + body + b"-" * 16


def yaml(rows: list[Row]) -> bytes:
    return "".join(f"- {json.dumps(k)}: {json.dumps(v)}\n" if not i else f"  {json.dumps(k)}: {json.dumps(v)}\n" for r in rows for i, (k, v) in enumerate(plain_json(r).items())).encode()


def toml(rows: list[Row]) -> bytes:
    return "".join("[[rows]]\n" + "".join(f"{k} = {v.isoformat() if isinstance(v, date) else json.dumps(v)}\n" for k, v in r.items() if v is not None) for r in rows).encode()


def ini(rows: list[Row]) -> bytes:
    return ("[rows]\n" + "".join(f"{k} = {text_of(v)}\n" for r in rows for k, v in r.items() if v is not None)).encode()


def xml(rows: list[Row]) -> bytes:
    return ("<rows>" + "".join(f"<row id={quoteattr(text_of(r['id']))}>" + "".join(f"<{k}>{escape(text_of(v))}</{k}>" for k, v in r.items() if k != "id" and v is not None) + "</row>" for r in rows) + "</rows>").encode()


def array(rows: list[Row]) -> np.ndarray:
    kinds = [("id", "<i8"), ("name", "S30"), ("zip", "S5"), ("balance", "<f8"), ("ok", "?")]
    return np.array([(r["id"], r["name"].encode(), r["zip"].encode(), r["balance"], r["ok"]) for r in rows], dtype=kinds)


def saved(save: Callable, *args: Any, **more: Any) -> bytes:
    out = io.BytesIO()
    save(out, *args, **more)
    return out.getvalue()


def arrow(rows: list[Row]) -> bytes:
    table, out = pa.Table.from_pylist(rows), io.BytesIO()
    with pa.ipc.new_file(out, table.schema) as to:
        to.write_table(table, max_chunksize=64)
    return out.getvalue()


def xlsx(rows: list[Row]) -> bytes:
    def cell(v: Any) -> str:
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        return "<c/>" if v is None else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    def write(out: io.BytesIO) -> None:
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("xl/workbook.xml", '<workbook xmlns="m" xmlns:r="rel"><sheets><sheet name="rows" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="p"><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
            body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [list(rows[0]), *(list(r.values()) for r in rows)])
            z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="m"><sheetData>{body}</sheetData></worksheet>')

    return saved(write)


def database(rows: list[Row]) -> bytes:
    with sqlite3.connect(":memory:") as held:
        held.execute("CREATE TABLE rows (id INTEGER, name TEXT, zip TEXT, balance REAL, ok INTEGER, note TEXT, day TEXT)")
        held.executemany("INSERT INTO rows VALUES (?, ?, ?, ?, ?, ?, ?)", [[v.isoformat() if isinstance(v, date) else v for v in r.values()] for r in rows])
        held.commit()
        return held.serialize()


def dbase(rows: list[Row]) -> bytes:
    fields = [("ID", "N", 9, lambda r: f"{r['id']:9d}"), ("NAME", "C", 30, lambda r: r["name"].ljust(30)), ("ZIP", "C", 5, lambda r: r["zip"]), ("OK", "L", 1, lambda r: "FT"[r["ok"]]), ("NOTE", "C", 8, lambda r: (r["note"] or "").ljust(8)), ("DAY", "D", 8, lambda r: f"{r['day']:%Y%m%d}")]
    head = b"".join(n.encode().ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w, _ in fields)
    body = "".join(" " + "".join(f(r) for *_, f in fields) for r in rows)
    return struct.pack("<B3BIHH20x", 3, 124, 1, 1, len(rows), 32 + len(head) + 1, 1 + sum(w for _, _, w, _ in fields)) + head + b"\r" + body.encode()


def stata(rows: list[Row]) -> bytes:
    import pandas as pd

    return saved(lambda out: pd.DataFrame([{k: v or "" if k == "note" else v for k, v in r.items() if k in ("id", "name", "zip", "balance", "note")} for r in rows]).to_stata(out, write_index=False))


# What is said of them: name, declared type, SQL of the text

ID, NAME, ZIP, NOTE = ("id", "i64", "CAST(id AS VARCHAR)"), ("name", "String", "name"), ("zip", "String", "zip"), ("note", "String", "note")
BALANCE, OK = ("balance", "f64", "CAST(balance AS VARCHAR)"), ("ok", "bool", "CAST(ok AS VARCHAR)")
WHOLE_BALANCE = ("balance", "f64", r"regexp_replace(CAST(balance AS VARCHAR), '\.0$', '')")
DAY, DATE = ("day", "String", "CAST(day AS VARCHAR)"), ("day", "Date", "CAST(day AS VARCHAR)")
TYPED = [BALANCE, DAY, ID, NAME, NOTE, OK, ZIP]  # of records, whose keys are sorted
SAID = list[tuple[str, str | None, str]]


def naive(columns: SAID) -> SAID:
    return [(n, None, s) for n, _, s in columns]


def strings(columns: SAID) -> SAID:
    return [(n, "String", s) for n, _, s in columns]


IN_ORDER = [ID, NAME, ZIP, BALANCE, OK, NOTE, DAY]
#: File name, writer, options of the reader, what is said, and rows that are read (None: all).
FORMATS: dict[str, tuple[str, Callable[[list[Row]], bytes], dict, SAID, int | None]] = {
    "read_csv": ("t.csv", lambda r: delimited(r, ","), {}, naive(IN_ORDER), None),
    "read_csv_nrows": ("t.csv", lambda r: delimited(r, ","), {"nrows": 7}, naive(IN_ORDER), 7),
    "read_csv_delimiter": ("t.csv", lambda r: delimited(r, ";"), {"delimiter": ";"}, naive(IN_ORDER), None),
    "read_tsv": ("t.tsv", lambda r: delimited(r, "\t"), {}, naive(IN_ORDER), None),
    "read_csv_gzip": ("t.csv.gz", lambda r: gzip.compress(delimited(r, ",")), {}, naive(IN_ORDER), None),
    "read_jsonl": ("t.jsonl", json_lines, {}, TYPED, None),
    "read_jsonl_nrows": ("t.ndjson", json_lines, {"nrows": 9}, TYPED, 9),
    "read_jsonl_zstd": ("t.jsonl.zst", lambda r: zstandard.compress(json_lines(r)), {}, TYPED, None),
    "read_json_array": ("t.json", lambda r: json.dumps(list(map(plain_json, r)), indent=1).encode(), {}, TYPED, None),
    "read_arrow": ("t.arrow", arrow, {}, [ID, NAME, ZIP, BALANCE, OK, NOTE, DATE], None),
    "read_avro": ("t.avro", avro, {}, TYPED, None),
    "read_avro_nrows": ("t.avro", lambda r: avro(r[:8]) + b"broken", {"nrows": 5}, TYPED, 5),
    "read_msgpack": ("t.msgpack", lambda r: b"".join(msgpack_of(plain_json(x)) for x in r), {}, TYPED, None),
    "read_cbor": ("t.cbor", lambda r: b"".join(cbor_of(plain_json(x)) for x in r), {}, TYPED, None),
    "read_yaml": ("t.yaml", yaml, {}, TYPED, None),
    "read_toml": ("t.toml", toml, {}, [(f"rows.{n}", k, s) for n, k, s in TYPED], None),
    "read_ini": ("t.ini", ini, {}, strings(TYPED), None),
    "read_xml": ("t.xml", xml, {}, strings([("@id", *ID[1:]), BALANCE, DAY, NAME, NOTE, OK, ZIP]), None),
    "read_npy": ("t.npy", lambda r: saved(np.save, array(r)), {}, [ID, NAME, ZIP, WHOLE_BALANCE, OK], None),
    "read_npz": ("t.npz", lambda r: saved(np.savez, rows=array(r)), {}, [ID, NAME, ZIP, WHOLE_BALANCE, OK], None),
    "read_xlsx": ("t.xlsx", xlsx, {}, naive([ID, NAME, ZIP, WHOLE_BALANCE, OK, NOTE, DAY]), None),
    "read_sqlite": ("t.sqlite", database, {}, [ID, NAME, ZIP, WHOLE_BALANCE, ("ok", "i64", "CAST(CAST(ok AS INTEGER) AS VARCHAR)"), NOTE, DAY], None),
    "read_dbase": ("t.dbf", dbase, {}, [("ID", "f64", ID[2]), ("NAME", "String", "name"), ("ZIP", "String", "zip"), ("OK", "bool", OK[2]), ("NOTE", "String", "note"), ("DAY", "Date", "strftime(day, '%Y%m%d')")], None),
    "read_stata": ("t.dta", stata, {}, [ID, NAME, ZIP, WHOLE_BALANCE, NOTE], None),
}


def read_back(name: str) -> Query:
    file, write, options, said, _ = FORMATS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = stored(spark, file, write(made(spark, sf_dir)))
        found = profile(spark, path, **options).filter(F.col("name").isin([n for n, _, _ in said]))
        return found.select(*SHOWN).withColumn("sample_values", F.array_join("sample_values", ", "))

    return run


def source_sql(limit: int | None) -> str:
    held = f"SELECT {MADE.format(text='VARCHAR', day=SQL_DAY)}, row_number() OVER () AS rn FROM supplier"
    return f"SELECT * FROM ({held})" + (f" WHERE rn <= {limit}" if limit else "")


def read_back_sql(name: str, profile_sql: Callable[[str, str, SAID], str]) -> str:
    _, _, _, said, limit = FORMATS[name]
    found = profile_sql("t", source_sql(limit), said)
    if name == "read_ini":  # every key of the one section holds a list, so nothing in it is missing
        return f"SELECT name, 'Vec<' || current_type || '>' AS current_type, 'Vec<' || ideal_type || '>' AS ideal_type, 0.0::DOUBLE AS missing_pct, sample_values, replace(replace(notes, '; has missing values -> wrap in Option<T> / handle nulls', ''), 'has missing values -> wrap in Option<T> / handle nulls', '') AS notes FROM ({found})"
    return f"SELECT {', '.join(SHOWN)} FROM ({found})"


# Renderings

KINDS = "CASE ideal_type WHEN 'String' THEN 'string' WHEN 'enum / category' THEN 'string' WHEN 'i64' THEN 'integer' WHEN 'f64' THEN 'number' WHEN 'bool' THEN 'boolean' WHEN 'NaiveDate / DateTime' THEN 'string' END"


def rendered(spark: SparkSession, sf_dir: str, output: str) -> str:
    found, fmt = profile_path(spark, stored(spark, "t.csv", delimited(made(spark, sf_dir), ",")))
    return render("t.csv", fmt, found, output)


def render_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = rendered(spark, sf_dir, "md")
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line int, text string")


def render_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = json.loads(rendered(spark, sf_dir, "json"))
    rows = [(doc["file"], doc["format"], t, i, c["name"], c["current_type"], c["ideal_type"], c["description"], c["missing_pct"], ", ".join(c["sample_values"]), c["notes"]) for t, columns in doc["tables"].items() for i, c in enumerate(columns)]
    return spark.createDataFrame(rows, "file string, format string, table_name string, col_ord int, name string, current_type string, ideal_type string, description string, missing_pct double, sample_values string, notes string")


def render_json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = json.loads(rendered(spark, sf_dir, "json-schema"))
    rows = [(doc["$schema"], t, s["type"], i, n, json.dumps(p["type"]), p.get("format"), n in s["required"]) for t, s in doc["tables"].items() for i, (n, p) in enumerate(s["properties"].items())]
    return spark.createDataFrame(rows, "dialect string, table_name string, kind string, place int, name string, type string, format string, required boolean")


def markdown_sql(found: str) -> str:
    cell = lambda c: f"replace({c}, '|', '\\|')"
    line = " || ' | ' || ".join([cell("name"), cell("current_type"), cell("ideal_type"), "''", "format('{:.1f}%', missing_pct)", cell("sample_values"), cell("notes")])
    head = ["# Data Dictionary: t.csv", "", "| Column | Current Type | Ideal Type | Description | Missing % | Sample Values | Notes |", "|---|---|---|---|---|---|---|"]
    fixed = " UNION ALL ".join(f"SELECT {i} AS line, '{t}' AS text" for i, t in [*enumerate(head), (len(head) + len(IN_ORDER), "")])
    return f"SELECT CAST(line AS INTEGER) AS line, text FROM ({fixed} UNION ALL SELECT {len(head)} + col_ord, '| ' || {line} || ' |' FROM ({found}))"


def queries() -> dict[str, Query]:
    return {name: read_back(name) for name in FORMATS} | {"render_markdown": render_markdown, "render_json": render_json, "render_json_schema": render_json_schema}


def oracle_sql(profile_sql: Callable[[str, str, SAID], str]) -> dict[str, str]:
    out = {name: read_back_sql(name, profile_sql) for name in FORMATS}
    found = profile_sql("t", source_sql(None), naive(IN_ORDER))
    out["render_markdown"] = markdown_sql(found)
    out["render_json"] = f"SELECT 't.csv' AS file, 'csv' AS format, * FROM ({found})"
    kind = f"'\"' || {KINDS} || '\"'"
    out["render_json_schema"] = f"""SELECT 'http://json-schema.org/draft-07/schema#' AS dialect, table_name, 'object' AS kind, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS place, name,
  CASE WHEN missing_pct > 0 THEN '[' || {kind} || ', "null"]' ELSE {kind} END AS type, CASE WHEN ideal_type = 'NaiveDate / DateTime' THEN 'date-time' END AS format, missing_pct = 0 AS required FROM ({found})"""
    return out
