"""Typed columns: DataFrames and Parquet in the JVM, Arrow IPC files by pyarrow on the executors."""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator
from datetime import date, datetime, time
from decimal import Decimal
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulore.functions.text import shortest
from tabulore.operators.leaves import COLUMNS, HEADER, SLOT, TYPES, column_leaves, record_leaves, spread
from tabulore.operators.profile import NESTED
from tabulore.sources.lines import text_records

LABELS = {
    T.BooleanType: "bool", T.ByteType: "i64", T.ShortType: "i64", T.IntegerType: "i64", T.LongType: "i64", T.FloatType: "f64", T.DoubleType: "f64",
    T.StringType: "String", T.DateType: "Date", T.TimestampType: "Timestamp", T.TimestampNTZType: "Timestamp", T.DecimalType: "Decimal", T.BinaryType: "Binary", T.NullType: "Null",
}
NESTED_TYPES = (T.ArrayType, T.MapType, T.StructType)


def label(kind: T.DataType) -> str:
    if isinstance(kind, NESTED_TYPES):
        return NESTED
    return LABELS.get(type(kind), kind.simpleString())


def text_of(column: Column, kind: T.DataType) -> Column:
    """As it is profiled; spelled() makes a sample of it what is shown."""
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(column))
    if isinstance(kind, T.TimestampNTZType):
        return F.replace(column.cast("string"), F.lit(" "), F.lit("T"))
    if isinstance(kind, T.TimestampType):
        return F.concat(F.replace(column.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
    return column.cast("string")


def spelled(kind: str, text: str) -> str:
    if kind == "f64":
        return shortest(text)
    if kind == "Timestamp" and "." in text:
        whole, _, rest = text.partition(".")
        digits = rest.rstrip("Z")
        return f"{whole}.{digits.ljust(-(-len(digits) // 3) * 3, '0')}{'Z' if rest.endswith('Z') else ''}"
    return text


def is_plain_array(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and label(kind.elementType) in ("bool", "i64", "f64", "String")


def array_leaves(table: str, df: DataFrame, name: str, kind: T.ArrayType, counts_rows: bool) -> DataFrame:
    """An array of scalars, pooled in the JVM. counts_rows: with the slot of the table's rows, of which there is one."""
    root, path, of = json.dumps([]), json.dumps([name], ensure_ascii=False), label(kind.elementType)
    column, zero = F.col(f"`{name}`"), F.lit(0).cast("long")
    pooled = df.select("rec", F.posexplode(column).alias("seq", "x")).filter("x is not null")
    text = F.col("x").cast("string")
    if of == "f64":  # JSON has neither NaN nor infinities
        pooled = pooled.filter(~F.isnan("x") & (F.abs("x") < float("inf")))
    leaves = pooled.select(F.lit(table).alias("table"), F.lit(path).alias("key"), F.lit(of).alias("kind"), text.alias("text"), "rec", "seq", zero.alias("present"), F.lit(False).alias("arrays"), zero.alias("objects"))
    counts = df.agg(F.count("*").alias("rows"), F.count(column).alias("present"))
    made = [(path, F.col("present"), F.col("present") > 0, zero)] + ([(root, zero, F.lit(False), F.col("rows"))] if counts_rows else [])
    slots = [counts.select(F.lit(table).alias("table"), F.lit(key).alias("key"), F.lit(SLOT).alias("kind"), F.lit(None).cast("string").alias("text"), zero.alias("rec"), F.lit(0).alias("seq"), n.alias("present"), a.alias("arrays"), o.alias("objects")) for key, n, a, o in made]
    return reduce(DataFrame.unionByName, [leaves, *slots])


def frame_leaves(df: DataFrame, table: str, rec: Column | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Leaves of a DataFrame's columns, and their names and labels. Only nested columns that aren't arrays of
    scalars leave the JVM, as JSON."""
    fields = df.schema.fields
    df = df.withColumn("rec", F.monotonically_increasing_id() if rec is None else rec)
    df = df if rec is None else spread(df)
    values = [F.lit(None).cast("string") if label(f.dataType) == NESTED else text_of(F.col(f"`{f.name}`"), f.dataType) for f in fields]
    parts = [column_leaves(table, df.select("rec", F.array(*values).alias("values")))] if any(label(f.dataType) != NESTED for f in fields) else []
    nested = [f for f in fields if label(f.dataType) == NESTED]
    arrays = [f for f in nested if is_plain_array(f.dataType)]
    others = [f for f in nested if not is_plain_array(f.dataType)]
    parts += [array_leaves(table, df, f.name, f.dataType, not others and not i) for i, f in enumerate(arrays)]
    if others:
        as_json = F.to_json(F.struct(*(F.col(f"`{f.name}`") for f in others)), {"ignoreNullFields": "false"})
        parts.append(text_records(table, df.select("rec", as_json.alias("value"))))
    return reduce(DataFrame.unionByName, parts), [(f.name, label(f.dataType)) for f in fields]


def arrow_label(kind: pa.DataType) -> str:
    if pa.types.is_dictionary(kind):
        return arrow_label(kind.value_type)
    tests = [("bool", "is_boolean"), ("i64", "is_integer"), ("f64", "is_floating"), ("String", "is_string"), ("String", "is_large_string"), ("Date", "is_date"), ("Timestamp", "is_timestamp"), ("Decimal", "is_decimal"), ("Binary", "is_binary"), ("LargeBinary", "is_large_binary"), ("Null", "is_null"), (NESTED, "is_nested")]
    return next((name for name, test in tests if getattr(pa.types, test)(kind)), str(kind))


def arrow_text(value: Any, kind: pa.DataType) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return shortest(str(np.float32(value)) if kind == pa.float32() else repr(value))
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, datetime):
        text = value.replace(tzinfo=None).isoformat()
        text = text.rstrip("0") if "." in text else text
        return spelled("Timestamp", text) + ("Z" if value.tzinfo else "")
    if isinstance(value, (date, time)):
        return value.isoformat()
    return f"{value:f}" if isinstance(value, Decimal) else str(value)


def as_json(value: Any) -> Any:
    """A nested value as JSON has it."""
    if isinstance(value, dict):
        return {str(k): as_json(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [as_json(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    return value if isinstance(value, (bool, int, str)) or value is None else arrow_text(value, pa.null())


def ipc_leaves(data: bytes, table: str, nrows: int | None) -> Iterator[pd.DataFrame]:
    opened = pa.ipc.open_file(io.BytesIO(data)) if data[:6] == b"ARROW1" else pa.ipc.open_stream(io.BytesIO(data))
    schema = opened.schema
    types = [arrow_label(f.type) for f in schema]
    yield pd.DataFrame([(table, "", kind, json.dumps(v), -1, 0, 0, False, 0) for kind, v in ((HEADER, schema.names), (TYPES, types))], columns=COLUMNS)
    batches = (opened.get_batch(i) for i in range(opened.num_record_batches)) if hasattr(opened, "num_record_batches") else iter(opened)
    nested = [i for i, t in enumerate(types) if t == NESTED]
    left, at = nrows, 0
    for batch in batches:
        if left is not None:
            batch, left = batch.slice(0, left), left - min(left, batch.num_rows)
        columns = [c.dictionary_decode() if isinstance(c, pa.DictionaryArray) else c for c in batch.columns]
        held = []
        for i, c in enumerate(columns):
            if i not in nested:
                held += [(table, str(i), "flat", arrow_text(v, c.type), at + r, 0, 0, False, 0) for r, v in enumerate(c.to_pylist())]
        yield pd.DataFrame(held, columns=COLUMNS)
        if nested:
            lists = [columns[i].to_pylist(maps_as_pydicts="lossy") for i in nested]
            yield from record_leaves(table, ((at + r, {schema.names[i]: as_json(v) for i, v in zip(nested, row)}) for r, row in enumerate(zip(*lists))))
        at += batch.num_rows
        if left == 0:
            break


