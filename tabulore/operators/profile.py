"""Leaves to column profiles.

One pass aggregates flags, counts and an estimate of distinct values by (table, key, kind), so a task's output is a few rows a
column. Exact distinct values are counted only for columns whose estimate is small; the first distinct samples of
the others come from a bounded stretch of rows, and if those repeat too much, from further stretches that begin at the next
value unseen. Columns whose values all begin like dates are held against the formats that one of their samples fits.
What reaches the driver is of the size of the profile, and the cascade is decided there.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulore.functions import predicates as P
from tabulore.functions.text import round1
from tabulore.operators.leaves import HEADER, OBJECT, SLOT, TYPES

PROFILE_SCHEMA = "table_name string, col_ord int, name string, current_type string, ideal_type string, description string, missing_pct double, sample_values array<string>, notes string"
MOST_CATEGORIES, FEW = 50, 150
#: Declared types of columns that are labelled by the kinds of their values, and of those that are profiled as paths.
MIXED, NESTED = "mixed?", "nested?"
MISSING_NOTE = "has missing values -> wrap in Option<T> / handle nulls"
EMPTY_NOTE = "column is empty/all null"
FLAGS = P.FLAGS
#: Of a column, or of a path: table, key, and whether its values are objects.
BY = ["table", "key", "objects"]
Key = tuple[str, str, bool]


@dataclass
class Values:
    """Of a column's values, or of a path's pooled scalars."""

    total: int = 0
    n: int = 0
    flags: dict[str, int] = field(default_factory=lambda: dict.fromkeys(FLAGS, 0))
    dates: dict[int, int] = field(default_factory=dict)
    kinds: dict[str, int] = field(default_factory=dict)
    estimate: int = 0
    unique: int | None = None
    samples: list[str] = field(default_factory=list)

    def all(self, flag: str) -> bool:
        return self.flags[flag] == self.n


def value_stats(leaves: DataFrame, n_samples: int) -> dict[Key, Values]:
    """By (table, key, whether of objects)."""
    spark, want = leaves.sparkSession, max(1, n_samples)
    leaves = leaves.filter(~F.col("kind").isin(SLOT, HEADER, TYPES)).select("table", "key", "kind", "text", "rec", "seq")
    counts = [F.count("*").alias("total"), F.count("text").alias("n"), F.approx_count_distinct("text", 0.05).alias("estimate")]
    seen = P.with_flags(leaves, "text").groupBy("table", "key", "kind").agg(*counts, *(F.count_if(name).alias(name) for name in FLAGS))
    out: dict[Key, Values] = defaultdict(Values)
    for row in seen.collect():
        v = out[(row["table"], row["key"], row["kind"] == OBJECT)]
        v.total, v.n, v.estimate = v.total + row["total"], v.n + row["n"], v.estimate + row["estimate"]
        v.kinds[row["kind"]] = row["n"]
        for name in FLAGS:
            v.flags[name] += row[name]
    leaves = leaves.filter("text is not null").withColumn("objects", F.col("kind") == OBJECT)

    def known(rows: list[tuple], more: str = "") -> DataFrame:
        """Rows about columns, as many as the profile has."""
        return F.broadcast(spark.createDataFrame(rows, f"table string, key string, objects boolean{more}"))

    def take(found: DataFrame) -> None:
        """found: text and first by column; the first ones become samples."""
        ranked = found.withColumns({"rank": F.row_number().over(Window.partitionBy(*BY).orderBy("first")), "unique": F.count("*").over(Window.partitionBy(*BY))})
        for row in sorted(ranked.filter(F.col("rank") <= want).collect(), key=lambda r: r["rank"]):
            v = out[tuple(row[c] for c in BY)]
            if len(v.samples) < want:
                v.samples.append(row["text"])
            if v.estimate <= FEW:
                v.unique = row["unique"]

    # rows of tables without nesting are told apart by rec alone, which hash aggregation can take the least of
    def firsts(rows: DataFrame, flat: bool) -> DataFrame:
        return rows.groupBy(*BY, "text").agg((F.min("rec") if flat else F.min(F.struct("rec", "seq"))).alias("first"))

    for flat in (True, False):
        if keys := [k for k, v in out.items() if v.n and v.estimate <= FEW and k[1].startswith("[") is not flat]:
            take(firsts(leaves.join(known(keys), BY, "left_semi"), flat))
        since, reach = {k: 0 for k, v in out.items() if v.estimate > FEW and k[1].startswith("[") is not flat}, max(1024, 16 * want)
        while since:
            new = leaves.join(known([(*k, r) for k, r in since.items()], ", since long"), BY)
            if had := [(*k, text) for k in since for text in out[k].samples]:
                new = new.join(known(had, ", text string"), [*BY, "text"], "left_anti")
            take(firsts(new.filter("rec >= since and rec < since + " + str(reach)), flat))
            if short := [k for k in since if len(out[k].samples) < want]:
                # where the next stretch begins: the first row further on whose value isn't a sample yet
                had = [(*k, text) for k in short for text in out[k].samples]
                rest = leaves.join(known([(*k, since[k] + reach) for k in short], ", since long"), BY).filter("rec >= since")
                rest = rest.join(known(had, ", text string"), [*BY, "text"], "left_anti") if had else rest
                since = {tuple(r[c] for c in BY): r["rec"] for r in rest.groupBy(*BY).agg(F.min("rec").alias("rec")).collect()}
            else:
                since = {}
    maybe = {k: v for k, v in out.items() if v.n and v.all("dateable") and not v.flags["leading_zero"]}
    like = {k: formats for k, v in maybe.items() if (formats := P.formats_like(v.samples[0]))}
    if formats := sorted({i for found in like.values() for i in found}):
        dates = P.with_dates(leaves.join(known(list(like)), BY, "left_semi"), "text", formats)
        for row in dates.groupBy(*BY).agg(*(F.count_if(f"date_{i}").alias(f"date_{i}") for i in formats)).collect():
            out[tuple(row[c] for c in BY)].dates = {i: row[f"date_{i}"] for i in formats}
    return out


def naive_type(v: Values) -> str:
    if not v.n:
        return "String"
    return next((name for name, flag in (("bool", "naive_bool"), ("i64", "i64"), ("f64", "f64")) if v.all(flag)), "String")


def cascade(v: Values, current: str) -> tuple[str, str]:
    """Ideal type and note: the first rule that fits wins. v has values."""
    if v.flags["leading_zero"]:
        lost = " - a naive numeric parse already lost them" if current in ("i64", "f64") else ""
        return "String", f"leading zeros in raw values (likely an ID/code){lost}"
    if v.all("bool_word"):
        return "bool", "values are yes/no/true/false"
    for i, (name, _, _) in enumerate(P.DATE_FORMATS):
        if v.dates.get(i) == v.n:
            return "NaiveDate / DateTime", f'all values match date format "{name}"'
    for kind in ("i64", "f64"):
        if v.all(f"clean_{kind}"):
            return kind, "" if current == kind else "numeric strings"
    if v.unique is not None and v.unique <= MOST_CATEGORIES and v.unique / v.n < 0.05:
        return "enum / category", f"low cardinality ({v.unique} unique values)"
    return "String", ""


def missing_pct(total: int, present: int) -> float:
    return round1((total - present) / total * 100) if total else 0.0


def with_missing(note: str, pct: float) -> str:
    return "; ".join(filter(None, [note, MISSING_NOTE if pct > 0 else ""]))


def flat_profile(name: str, v: Values, declared: str | None) -> dict:
    current = declared or naive_type(v)
    if current == MIXED:
        current = kind_label(v.kinds) if v.n else "null"
    ideal, note = cascade(v, current) if v.n else ("String", EMPTY_NOTE)
    pct = missing_pct(v.total, v.n)
    return {"name": name, "current_type": current, "ideal_type": ideal, "description": "", "missing_pct": pct, "sample_values": v.samples, "notes": with_missing(note, pct)}


def kind_label(kinds: dict[str, int]) -> str:
    some = {k: n for k, n in kinds.items() if n}
    if len(some) == 1:
        return next(iter(some))
    return "mixed(" + ", ".join(f"{k}: {some[k]}" for k in sorted(some, key=str.encode)) + ")"


def nested_profiles(slots: dict[tuple[str, ...], dict], stats: dict[tuple[str, ...], Values], objects: dict[tuple[str, ...], Values], root: str | None = None) -> list[dict]:
    """Depth first, siblings by first sight. root: only the paths below this name."""
    children = defaultdict(list)
    for path in slots:
        if path:
            children[path[:-1]].append(path)
    out: list[dict] = []

    def visit(path: tuple[str, ...]) -> None:
        slot, scalars, inner = slots[path], stats.get(path, Values()), objects.get(path, Values())
        name = ".".join(path)
        total, kinds = slots[path[:-1]]["objects"], {**scalars.kinds, **({OBJECT: inner.n} if inner.n else {})}
        pct = missing_pct(total, slot["present"])
        wrap = (lambda t: f"Vec<{t}>") if slot["arrays"] else (lambda t: t)
        row = {"name": name, "description": "", "missing_pct": pct, "sample_values": scalars.samples or inner.samples}
        if not slot["present"]:
            out.append(row | {"current_type": "null", "ideal_type": "String", "notes": EMPTY_NOTE})
            return
        if not kinds:
            label, ideal, note = "empty", "empty", "array is always empty - can't infer an element type"
        else:
            label = kind_label(kinds)
            if inner.n and scalars.n:
                ideal, note = "String", f"mix of scalars and objects - object fields listed separately under {name}.*"
            elif inner.n:
                ideal, note = "struct", f"flattened into {name}.* below"
            else:
                ideal, note = cascade(scalars, label)
        out.append(row | {"current_type": wrap(label), "ideal_type": wrap(ideal), "notes": with_missing(note, pct)})
        for child in sorted(children[path], key=lambda p: slots[p]["first"]):
            visit(child)

    for path in sorted(children[()], key=lambda p: slots[p]["first"]):
        if root in (None, path[0]):
            visit(path)
    return out


def slots_of(leaves: DataFrame) -> dict[str, dict[tuple[str, ...], dict]]:
    """By table and path: present, arrays, objects, first."""
    merged = leaves.filter(F.col("kind") == SLOT).groupBy("table", "key").agg(F.sum("present").alias("present"), F.max("arrays").alias("arrays"), F.sum("objects").alias("objects"), F.min(F.struct("rec", "seq")).alias("first"))
    out: dict[str, dict[tuple[str, ...], dict]] = defaultdict(dict)
    for r in merged.collect():
        out[r["table"]][tuple(json.loads(r["key"]))] = {"present": r["present"], "arrays": r["arrays"], "objects": r["objects"], "first": tuple(r["first"])}
    return out


def profiles(leaves: DataFrame, n_samples: int, columns: dict[str, list[tuple[str, str | None]]] | None = None, spell: Callable[[str, str], str] = lambda kind, text: text) -> dict[str, list[dict]]:
    """Profiles by table. columns: names and declared types of tables whose header isn't in the leaves. spell: a
    sample of a declared type or kind, as it is shown."""
    stats = value_stats(leaves, n_samples)
    flat = dict(columns or {})
    meta = {(r["table"], r["kind"]): json.loads(r["text"]) for r in leaves.filter(F.col("kind").isin(HEADER, TYPES)).select("table", "kind", "text").collect()}
    for (table, kind), names in meta.items():
        if kind == HEADER:
            flat[table] = list(zip(names, meta[(table, TYPES)] or [None] * len(names)))
    paths: dict[str, tuple[dict, dict]] = defaultdict(lambda: ({}, {}))
    for (table, key, is_object), v in stats.items():
        if key.startswith("["):
            paths[table][is_object][tuple(json.loads(key))] = v
            v.samples = [spell(next(iter(v.kinds)), s) if len(v.kinds) == 1 else s for s in v.samples]
    slots, out = slots_of(leaves), {}
    for table in {*flat, *slots}:
        if table not in flat:
            out[table] = nested_profiles(slots[table], *paths[table])
            continue
        out[table] = []
        for i, (name, declared) in enumerate(flat[table]):
            if declared == NESTED:
                out[table] += nested_profiles(slots[table], *paths[table], root=name)
                continue
            column = flat_profile(name, stats.get((table, str(i), False), Values()), declared)
            out[table].append(column | {"sample_values": [spell(declared or "", s) for s in column["sample_values"]]})
    return out


def as_frame(spark, tables: dict[str, list[dict]]) -> DataFrame:
    rows = [(t, i, *(c[k] for k in ("name", "current_type", "ideal_type", "description", "missing_pct", "sample_values", "notes"))) for t in sorted(tables) for i, c in enumerate(tables[t])]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)
