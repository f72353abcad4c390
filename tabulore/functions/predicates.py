"""What a text value looks like, as Spark columns. All of them are null-safe only for non-null text."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

I64 = r"^[+-]?[0-9]+$"
F64 = r"^[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
BOOL_WORDS = ("true", "false", "yes", "no", "y", "n")
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_Y, _M, _D = r"\s*([0-9]{1,4})", r"\s*(0?[1-9]|1[0-2])", r"\s*(0?[1-9]|[12][0-9]|3[01])"
_B, _T = r"(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))", r"\s*(?:[01]?[0-9]|2[0-3]):\s*[0-5]?[0-9]:\s*(?:[0-5]?[0-9]|60)"
#: Fixed values, in the order in which they are tried: format, pattern, groups of year, month and day.
DATE_FORMATS = [
    ("%Y-%m-%d", f"^{_Y}-{_M}-{_D}$", (1, 2, 3)),
    ("%Y/%m/%d", f"^{_Y}/{_M}/{_D}$", (1, 2, 3)),
    ("%m/%d/%Y", f"^{_M}/{_D}/{_Y}$", (3, 1, 2)),
    ("%d/%m/%Y", f"^{_D}/{_M}/{_Y}$", (3, 2, 1)),
    ("%d-%m-%Y", f"^{_D}-{_M}-{_Y}$", (3, 2, 1)),
    ("%Y-%m-%dT%H:%M:%S", f"^{_Y}-{_M}-{_D}T{_T}$", (1, 2, 3)),
    ("%Y-%m-%d %H:%M:%S", rf"^{_Y}-{_M}-{_D}\s*{_T}$", (1, 2, 3)),
    ("%m-%d-%Y", f"^{_M}-{_D}-{_Y}$", (3, 1, 2)),
    ("%d %b %Y", rf"^{_D}\s*{_B}\s*{_Y}$", (3, 2, 1)),
    ("%b %d, %Y", rf"^{_B}\s*{_D},{_Y}$", (3, 1, 2)),
    ("%d/%b/%Y:%H:%M:%S %z", rf"^{_D}/{_B}/{_Y}:{_T}\s*[+-][0-9]{{2}}:?[0-9]{{2}}$", (3, 2, 1)),
    ("%Y%m%d", r"^\s*([0-9]{4})(0[1-9]|1[0-2])(0?[1-9]|[12][0-9]|3[01])$", (1, 2, 3)),
]
FLAGS = ["leading_zero", "bool_word", "naive_bool", "i64", "f64", "clean_i64", "clean_f64", "dateable"]
#: How every date begins.
DATE_START = r"^\s*(?:[0-9]{1,4}[-/]|[0-9]{1,2}\s*[A-Za-z]{3}|[A-Za-z]{3}\s*[0-9]|[0-9]{7,8}$)"


def leading_zero(v: Column) -> Column:
    return v.startswith("0") & F.substring(v, 2, 1).between("0", "9")


def bool_word(v: Column) -> Column:
    return (F.length(v) <= 5) & F.lower(v).isin(*BOOL_WORDS)


def naive_bool(v: Column) -> Column:
    return F.length(v).isin(4, 5) & F.lower(v).isin("true", "false")


def is_i64(v: Column) -> Column:
    return v.rlike(I64) & ((F.length(v) <= 18) | v.try_cast("bigint").isNotNull())


def is_f64(v: Column) -> Column:
    return v.rlike(F64)


def dateable(v: Column) -> Column:
    """Whether a date may begin so; most values are told by it at once."""
    return F.length(v).between(5, 60) & v.rlike(DATE_START)


def has_marks(v: Column) -> Column:
    """Whether stripped() changes it."""
    return v.contains(",") | v.contains("$")


def stripped(v: Column) -> Column:
    """Without thousands separators and currency signs."""
    return F.translate(v, ",$", "")


def matches_date(v: Column, pattern: str, groups: tuple[int, int, int]) -> Column:
    """Pattern first; the calendar only where it fits."""
    y, m, d = (F.regexp_extract(v, pattern, g) for g in groups)
    if _B in pattern:
        m = ((F.instr(F.lit(MONTHS), F.lower(m)) + 2) / 3).cast("int").cast("string")
    day = F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
    return F.when(v.rlike(pattern), day.isNotNull()).otherwise(F.lit(False))


def with_flags(df: DataFrame, text: str) -> DataFrame:
    """df with a boolean column for each of FLAGS. What several of them need is computed once, before them.

    The formats of dates have a pass of their own, over the columns whose values are all dateable: with them the method that
    Spark generates would be too long for the JVM to compile."""
    v = F.col(text)
    df = df.withColumns({"_marks": has_marks(v), "_i64": is_i64(v), "_f64": is_f64(v)})
    clean = [F.when(F.col("_marks"), test(stripped(v))).otherwise(F.col(plain)) for test, plain in ((is_i64, "_i64"), (is_f64, "_f64"))]
    plain = [leading_zero(v), bool_word(v), naive_bool(v), F.col("_i64"), F.col("_f64"), *clean, dateable(v)]
    return df.withColumns(dict(zip(FLAGS, plain))).drop("_marks", "_i64", "_f64")


def with_dates(df: DataFrame, text: str, formats: Iterable[int]) -> DataFrame:
    """df with a boolean column date_<i> for each of these formats."""
    v = F.col(text)
    return df.withColumns({f"date_{i}": dateable(v) & matches_date(v, *DATE_FORMATS[i][1:]) for i in formats})


def formats_like(text: str) -> list[int]:
    """The formats whose pattern a value has, whatever the calendar says."""
    return [i for i, (_, pattern, _) in enumerate(DATE_FORMATS) if re.search(pattern, text.rstrip("\r\n\x85\u2028\u2029"), re.ASCII)]


def blank_to_null(v: Column) -> Column:
    return F.when(~v.rlike(r"(?U)^\s*$"), v)


def dash_to_null(v: Column) -> Column:
    return F.nullif(v, F.lit("-"))
