"""The leaf relation: one row for each value that is profiled, and the counters of nested paths.

Columns: table; key (a column's place, or a path as a JSON array of keys); kind (the value's kind; SLOT for the
counters of a path; HEADER and TYPES for the names and declared types of a table without nesting); text; rec and seq
(order of first sight); present, arrays, objects (counters). All of them merge by sum, max and min.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulore.functions.text import float_text

SLOT, HEADER, TYPES, OBJECT, FLAT = "#slot", "#header", "#types", "object", "flat"
COLUMNS = ["table", "key", "kind", "text", "rec", "seq", "present", "arrays", "objects"]
SCHEMA = "table string, key string, kind string, text string, rec long, seq int, present long, arrays boolean, objects long"


def compact(value: Any) -> str:
    """JSON with sorted keys, without blanks, with floats as they are spelled here."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{compact(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(compact, value)) + "]"
    return float_text(value) if isinstance(value, float) else json.dumps(value, ensure_ascii=False)


def scalar(value: Any) -> tuple[str, str]:
    """Kind and text. Whole numbers beyond 64 bits are floats."""
    if isinstance(value, bool):
        return "bool", "true" if value else "false"
    if isinstance(value, int) and -(1 << 63) <= value < 1 << 64:
        return "i64", str(value)
    if isinstance(value, (int, float)):
        return "f64", float_text(value)
    return "String", value


def pool(value: Any) -> Iterator[Any]:
    """What arrays of any depth hold, without nulls."""
    todo = [value]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo.extend(reversed(x))
        elif x is not None:
            yield x


class Walker:
    """Leaves of records of one table, and the counters of its paths."""

    def __init__(self, table: str) -> None:
        self.table = table
        self.slots: dict[tuple[str, ...], list] = {}
        self.rows: list[tuple] = []

    def slot(self, path: tuple[str, ...], rec: int, seq: int) -> list:
        if path not in self.slots:
            self.slots[path] = [0, False, 0, rec, seq]
        return self.slots[path]

    def add(self, record: dict, rec: int) -> None:
        self.slot((), rec, 0)[2] += 1
        seq = 0
        todo = [((), record)]
        while todo:
            path, parent = todo.pop()
            inner = []
            for name in sorted(parent):
                value, at = parent[name], (*path, name)
                seq += 1
                slot = self.slot(at, rec, seq)
                if value is None:
                    continue
                slot[0] += 1
                slot[1] |= isinstance(value, list)
                key = json.dumps(at, ensure_ascii=False)
                for x in pool(value):
                    seq += 1
                    if isinstance(x, dict):
                        slot[2] += 1
                        inner.append((at, x))
                        self.rows.append((self.table, key, OBJECT, compact(x), rec, seq, 0, False, 0))
                    else:
                        self.rows.append((self.table, key, *scalar(x), rec, seq, 0, False, 0))
            todo.extend(reversed(inner))

    def take(self) -> pd.DataFrame:
        rows, self.rows = self.rows, []
        return pd.DataFrame(rows, columns=COLUMNS)

    def end(self) -> pd.DataFrame:
        rows = [(self.table, json.dumps(p, ensure_ascii=False), SLOT, None, rec, seq, present, arrays, objects) for p, (present, arrays, objects, rec, seq) in self.slots.items()]
        return pd.DataFrame(rows, columns=COLUMNS)


def record_leaves(table: str, records: Iterable[tuple[int, dict]], at_once: int = 20_000) -> Iterator[pd.DataFrame]:
    walker = Walker(table)
    for rec, record in records:
        walker.add(record, rec)
        if len(walker.rows) >= at_once:
            yield walker.take()
    yield walker.take()
    yield walker.end()


def table_leaves(table: str, header: list[str], types: list[str] | None, rows: Iterable[list[str | None]], at_once: int = 20_000) -> Iterator[pd.DataFrame]:
    """A table without nesting that was decoded in Python."""
    frame = lambda held: pd.DataFrame(held, columns=COLUMNS)
    meta = [(HEADER, json.dumps(header)), (TYPES, json.dumps(types))]
    yield frame([(table, "", kind, text, -1, 0, 0, False, 0) for kind, text in meta])
    held: list[tuple] = []
    for rec, row in enumerate(rows):
        for i in range(len(header)):
            value = row[i] if i < len(row) else None
            kind, text = value if isinstance(value, tuple) else (FLAT, value)
            held.append((table, str(i), kind or FLAT, text, rec, 0, 0, False, 0))
        if len(held) >= at_once:
            yield frame(held)
            held = []
    yield frame(held)


def spread(df: DataFrame, rec: str = "rec", least: int = 1 << 20) -> DataFrame:
    """A scan of one large file that can't be split, dealt to all cores by rec before anything expensive."""
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    adapts = "AdaptiveSparkPlan" in plan.executedPlan().toString()  # it shuffles already, and counting its partitions would run it
    if adapts or int(str(plan.optimizedPlan().stats().sizeInBytes())) < least or plan.toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores, rec)


def column_leaves(table: str, rows: DataFrame) -> DataFrame:
    """rows (rec, values array<string>), a null for a missing value, as leaves; unpivoted in the JVM.

    A value's key is its place in the array."""
    each = rows.select("rec", F.posexplode("values").alias("at", "text"))
    none = [F.lit(0).alias("seq"), F.lit(0).cast("long").alias("present"), F.lit(False).alias("arrays"), F.lit(0).cast("long").alias("objects")]
    return each.select(F.lit(table).alias("table"), F.col("at").cast("string").alias("key"), F.lit(FLAT).alias("kind"), "text", "rec", *none)
