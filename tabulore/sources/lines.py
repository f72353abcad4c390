"""Delimited and fixed-width text, logs, and JSON lines: decoded in the JVM but for JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulore.functions.predicates import blank_to_null, dash_to_null
from tabulore.operators.leaves import SCHEMA, column_leaves, record_leaves

#: Fixed values of the log grammars.
COMMON = r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}|-) (\d+|-)'
COMBINED = COMMON + r' "([^"]*)" "([^"]*)"$'
RFC5424 = r"(?s)^<(\d{1,3})>(\d+) (\S+) (\S+) (\S+) (\S+) (\S+) (-|\[[^\]]*\]) ?(.*)$"
RFC3164 = r"(?s)^<(\d{1,3})>([A-Za-z]{3}\s+\d{1,2}\s\d{2}:\d{2}:\d{2}) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?: ?(.*)$"
FACILITIES = (
    "kernel", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "security", "console", "solaris-cron",
    "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7",
)
SEVERITIES = ("emergency", "alert", "critical", "error", "warning", "notice", "informational", "debug")
WEB = ("host", "ident", "authuser", "timestamp", "method", "path", "protocol", "status", "bytes")
WEB_MORE = ("referer", "user_agent")
SYSLOG_3164 = ("facility", "severity", "timestamp", "hostname", "tag", "pid", "message")
SYSLOG_5424 = ("facility", "severity", "version", "timestamp", "hostname", "app_name", "procid", "msgid", "structured_data", "message")

#: No line has it, so groups may be taken apart at it.
BETWEEN = "\ue000\x01\ue000"
Columns = list[tuple[str, str | None]]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """rec (order in the file), value; a carriage return before a line feed is no part of a line."""
    text = spark.read.option("lineSep", "\n").text(path).withColumn("rec", F.monotonically_increasing_id())
    return text.select("rec", F.regexp_replace("value", r"\r$", "").alias("value"))


#: What an error says of a line that doesn't fit; ROW_BITS as in monotonically_increasing_id.
BAD_LINE, ROW_BITS = r"line (\d+) (doesn't match [^:]+: [^\n]*)", 33


def with_line_number(spark: SparkSession, path: str, error: Exception) -> Exception:
    """An error about a line of a file that is read in parts, with the line's number in the file: the lines of the parts
    before are counted only now."""
    found = re.search(BAD_LINE, str(error))
    if not found:
        return error
    part, row = (int(found[1]) - 1) >> ROW_BITS, (int(found[1]) - 1) & (1 << ROW_BITS) - 1
    before = lines(spark, path).filter(F.shiftright("rec", ROW_BITS) < part).count() if part else 0
    return ValueError(f"line {before + row + 1} {found[2]}")


def filled(text: DataFrame, nrows: int | None) -> DataFrame:
    text = text.filter(~F.col("value").rlike(r"(?U)^\s*$"))
    return text if nrows is None else text.limit(nrows)


def csv(spark: SparkSession, path: str, table: str, nrows: int | None, delimiter: str, one_line: bool = False) -> tuple[DataFrame, Columns]:
    """one_line: no field holds a line feed, so a file may be read in parts."""
    rows = spark.read.csv(path, sep=delimiter, header=False, inferSchema=False, quote='"', escape='"', multiLine=not one_line, mode="FAILFAST", emptyValue="", enforceSchema=True)
    rows = rows.withColumn("rec", F.monotonically_increasing_id())
    names = [c for c in rows.columns if c != "rec"]
    first = rows.limit(1).first()
    if first is None:
        return column_leaves(table, spark.createDataFrame([], "rec long, values array<string>")), []
    body = rows.filter(F.col("rec") > first["rec"])
    if nrows is not None:
        body = body.limit(nrows)
    body = body.select("rec", F.array(*(blank_to_null(F.col(c)) for c in names)).alias("values"))
    return column_leaves(table, body), [(first[c] or "", None) for c in names]


def fixed_width(text: DataFrame, table: str, nrows: int | None, widths: list[int]) -> tuple[DataFrame, Columns]:
    """text (rec, value): the first line is the header."""
    if not widths:
        raise ValueError("fixed-width input needs --widths")
    starts = [1 + sum(widths[:i]) for i in range(len(widths))]
    fields = [F.regexp_replace(F.substring("value", s, w), r"(?U)^\s+|\s+$", "") for s, w in zip(starts, widths)]
    head = text.select("rec", F.array(*fields).alias("values")).limit(1).first()
    if head is None:
        raise ValueError("fixed-width input is empty")
    body = filled(text.filter(F.col("rec") > head["rec"]), nrows)
    body = body.select("rec", F.array(*(F.nullif(f, F.lit("")) for f in fields)).alias("values"))
    return column_leaves(table, body), [(name, None) for name in head["values"]]


def parsed(text: DataFrame, table: str, nrows: int | None, pattern: str, said: str, names: tuple[str, ...], values: Callable[[Callable[[int], Column]], list[Column]]) -> tuple[DataFrame, Columns]:
    """Lines that fit the pattern, whose groups values() gets by number; another line fails the run, with its number.

    One replacement takes all groups of a line at once; they are exploded, or Spark would repeat it for each use."""
    text = filled(text, nrows)
    count = re.compile(pattern).groups
    groups = F.split(F.regexp_replace("value", pattern, BETWEEN.join(f"${i}" for i in range(1, count + 1))), BETWEEN, -1)
    number = F.concat(F.lit("line "), (F.col("rec") + 1).cast("string"), F.lit(f" doesn't match {said}: "), F.col("value"))
    text = text.select("rec", F.explode(F.array(F.when(F.col("value").rlike(pattern), groups).otherwise(F.raise_error(number)))).alias("groups"))
    return column_leaves(table, text.select("rec", F.array(*values(lambda i: F.col("groups")[i - 1])).alias("values"))), [(name, None) for name in names]


def weblog(text: DataFrame, table: str, nrows: int | None, combined: bool) -> tuple[DataFrame, Columns]:
    def values(part: Callable[[int], Column]) -> list[Column]:
        # a request of other than three tokens has none of them
        words = F.when(part(5).rlike(r"^(\S+) (\S+) (\S+)$"), F.split(part(5), " "))
        out = [*(dash_to_null(part(i)) for i in (1, 2, 3)), part(4), *(words[i] for i in range(3)), dash_to_null(part(6)), dash_to_null(part(7))]
        return out + [dash_to_null(part(8)), dash_to_null(part(9))] if combined else out

    names = WEB + (WEB_MORE if combined else ())
    return parsed(text, table, nrows, COMBINED if combined else f"{COMMON}$", f"{'Combined' if combined else 'Common'} Log Format", names, values)


def named(number: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, names)), (number + 1).cast("int")), number.cast("string"))


def syslog(text: DataFrame, table: str, nrows: int | None, rfc5424: bool) -> tuple[DataFrame, Columns]:
    def values(part: Callable[[int], Column]) -> list[Column]:
        pri = part(1).try_cast("int")
        decoded = [named(F.floor(pri / 8).cast("int"), FACILITIES), named(pri % 8, SEVERITIES)]
        if rfc5424:
            return [*decoded, part(2), part(3), *(dash_to_null(part(i)) for i in (4, 5, 6, 7, 8)), part(9)]
        return [*decoded, part(2), part(3), part(4), F.nullif(part(5), F.lit("")), part(6)]

    names = SYSLOG_5424 if rfc5424 else SYSLOG_3164
    return parsed(text, table, nrows, RFC5424 if rfc5424 else RFC3164, f"syslog RFC {'5424' if rfc5424 else '3164'}", names, values)


def _reject(constant: str):
    raise ValueError(f"{constant} is not JSON")


def _number(text: str) -> int | float:
    n = int(text)
    return n if -(1 << 63) <= n < 1 << 64 else float(text)


def parse_json(text: str):
    return json.loads(text, parse_constant=_reject, parse_int=_number)


def json_object(text: str) -> dict:
    value = parse_json(text)
    if not isinstance(value, dict):
        raise ValueError(f"a record is not an object: {text[:80]}")
    return value


def text_records(table: str, rows: DataFrame) -> DataFrame:
    """rows (rec, value), a JSON object in each value, as leaves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from record_leaves(table, ((int(rec), json_object(value)) for b in batches for rec, value in zip(b["rec"], b["value"])))

    return rows.select("rec", "value").mapInPandas(run, SCHEMA)


def starts_with_array(spark: SparkSession, path: str) -> bool:
    """Whether the first line that isn't blank begins an array; parts of the file are read in order until there is one."""
    first = filled(lines(spark, path), None).select("value").limit(1).first()
    return first is not None and first["value"].lstrip().startswith("[")


def json_lines(spark: SparkSession, path: str, table: str, nrows: int | None) -> tuple[DataFrame, Columns]:
    text = lines(spark, path).filter(~F.col("value").rlike(r"(?U)^\s*$"))
    return text_records(table, text if nrows is None else text.limit(nrows)), []


def either(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
