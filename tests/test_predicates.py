import re
from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabulore.functions import predicates as P
from tabulore.functions.text import float_text, plain, round1, shortest
from tabulore.operators.profile import FLAGS, Values, cascade, kind_label, missing_pct, value_stats
from tabulore.operators.leaves import column_leaves, compact, pool, scalar


def flags_of(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "t string")
    return {r.t: r for r in P.with_dates(P.with_flags(rows, "t"), "t", range(len(P.DATE_FORMATS))).collect()}


def values_of(spark, texts):
    rows = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "rec long, values array<string>")
    return value_stats(column_leaves("t", rows), 3)[("t", "0", False)]


def test_numbers_are_strict(spark):
    got = flags_of(spark, ["5", "+5", "-0", " 5", "5 ", "1_0", "9223372036854775807", "9223372036854775808", "1.", ".5", "1e3", "1.0d", "0x1p3", "inf", "-Infinity", "NaN", "nan", "1,5", "$3", "", ".", "e3", "٣"])
    assert {t for t, r in got.items() if r.i64} == {"5", "+5", "-0", "9223372036854775807"}
    assert {t for t, r in got.items() if r.f64} == {"5", "+5", "-0", "9223372036854775807", "9223372036854775808", "1.", ".5", "1e3", "inf", "-Infinity", "NaN", "nan"}
    assert got["1,5"].clean_i64 and got["$3"].clean_i64


def test_words_and_zeros(spark):
    got = flags_of(spark, ["0", "01", "0.5", "00", "007a", "Yes", "y", "TRUE", "false", "on", "N"])
    assert {t for t, r in got.items() if r.leading_zero} == {"01", "00", "007a"}
    assert {t for t, r in got.items() if r.bool_word} == {"Yes", "y", "TRUE", "false", "N"}
    assert {t for t, r in got.items() if r.naive_bool} == {"TRUE", "false"}


DATES = {
    "2024-01-15": {"%Y-%m-%d"}, "2024-1-5": {"%Y-%m-%d"}, "24-1-5": {"%Y-%m-%d", "%d-%m-%Y"}, "2024-02-30": set(), "2023-02-29": set(), "2024-02-29": {"%Y-%m-%d"}, " 2024-01-15": {"%Y-%m-%d"}, "2024-01-15 ": set(),
    "2024/01/15": {"%Y/%m/%d"}, "1/2/2024": {"%m/%d/%Y", "%d/%m/%Y"}, "13/2/2024": {"%d/%m/%Y"}, "2/13/2024": {"%m/%d/%Y"}, "31-12-1999": {"%d-%m-%Y"}, "12-31-1999": {"%m-%d-%Y"},
    "2024-01-15T00:00:60": {"%Y-%m-%dT%H:%M:%S"}, "2024-01-15T25:00:00": set(), "2024-01-15T10:00:00.5": set(), "2024-01-15T10:00:00Z": set(), "2024-01-15 10:20:30": {"%Y-%m-%d %H:%M:%S"},
    "15 jan 2024": {"%d %b %Y"}, "15 January 2024": set(), "JAN 5,2024": {"%b %d, %Y"}, "Mar 5, 2024": {"%b %d, %Y"}, "10/Oct/2000:13:55:36 -0700": {"%d/%b/%Y:%H:%M:%S %z"}, "20240115": {"%Y%m%d"}, "1999123": {"%Y%m%d"}, "20241315": set(), "12024-01-01": set(), "": set(), "0000-01-01": {"%Y-%m-%d"},
}


def test_dates(spark):
    got = flags_of(spark, list(DATES))
    for text, want in DATES.items():
        assert {fmt for i, (fmt, _, _) in enumerate(P.DATE_FORMATS) if got[text][f"date_{i}"]} == want, text


@settings(max_examples=40, deadline=None)
@given(st.lists(st.dates(min_value=date(1, 1, 1)), min_size=1, max_size=8))
def test_iso_dates_match(spark, days):
    got = flags_of(spark, [d.isoformat() for d in days])
    assert all(r.date_0 for r in got.values())


def test_cascade_order(spark):
    ideal = lambda texts, current="String": cascade(values_of(spark, texts), current)
    assert ideal(["02134", "5"], "i64") == ("String", "leading zeros in raw values (likely an ID/code) - a naive numeric parse already lost them")
    assert ideal(["01/15/2024"])[0] == "String"
    assert ideal(["yes", "N"]) == ("bool", "values are yes/no/true/false")
    assert ideal(["20240101", "20240102"], "i64") == ("NaiveDate / DateTime", 'all values match date format "%Y%m%d"')
    assert ideal(["1/2/2024", "13/2/2024"]) == ("NaiveDate / DateTime", 'all values match date format "%d/%m/%Y"')
    assert ideal(["2024-01-15", "later"]) == ("String", "")
    assert ideal(["$1,200", "5"]) == ("i64", "numeric strings") and ideal(["1", "2"], "i64") == ("i64", "")
    assert ideal(["1.5", "2"]) == ("f64", "numeric strings") and ideal(["1.5"], "f64") == ("f64", "")
    assert ideal(["a", "b", "c"] * 67) == ("enum / category", "low cardinality (3 unique values)")
    assert ideal(["a", "b", "c"] * 20) == ("String", "")  # exactly 5 %
    assert ideal([f"v{i % 51}" for i in range(3000)]) == ("String", "") and ideal([f"v{i % 50}" for i in range(3000)])[0] == "enum / category"


def test_samples_are_the_first_distinct(spark):
    assert values_of(spark, ["b", "a", "b", "c", "d"]).samples == ["b", "a", "c"]
    many = ["x"] * 5000 + [f"y{i}" for i in range(1000)]
    assert values_of(spark, many).samples == ["x", "y0", "y1"]
    v = values_of(spark, [None, "a", None])
    assert (v.total, v.n, v.samples) == (3, 1, ["a"])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["", "0", "07", "1", "-2", "3.5", "yes", "no", "true", "x", "2024-01-02", "1/2/2024", "$5", "1e9", "nan"]), min_size=1, max_size=9))
def test_cascade_matches_plain_python(spark, texts):
    def number(t, pattern):
        return re.fullmatch(pattern, t) is not None

    every = lambda f: all(f(t) for t in texts)
    clean = [t.replace(",", "").replace("$", "") for t in texts]
    if any(re.match("0[0-9]", t) for t in texts):
        want = "String"
    elif every(lambda t: t.lower() in P.BOOL_WORDS):
        want = "bool"
    elif every(lambda t: t == "2024-01-02") or every(lambda t: t == "1/2/2024"):
        want = "NaiveDate / DateTime"
    elif all(number(t, "[+-]?[0-9]+") for t in clean):
        want = "i64"
    elif all(number(t, P.F64.replace("^", "").replace("$", "")) for t in clean):
        want = "f64"
    else:
        want = "String"
    assert cascade(values_of(spark, texts), "String")[0] == want


def test_spelling():
    assert [float_text(x) for x in (34.0, 8.5, 1e16, 1e15, 1e-5, 1e-6, 1.25e300, -0.0, 0.1)] == ["34.0", "8.5", "1e16", "1000000000000000.0", "0.00001", "1e-6", "1.25e300", "-0.0", "0.1"]
    assert shortest("1.2345678E7") == "12345678.0" and shortest("NaN") == "NaN" and shortest("-Infinity") == "-inf"
    assert [plain(x) for x in (34.0, 1e20, 1e-7, 0.5, float("nan"), float("-inf"), -3.25, 0.0)] == ["34", "100000000000000000000", "0.0000001", "0.5", "NaN", "-inf", "-3.25", "0"]
    assert [round1(x) for x in (66.66666, 0.04, 0.05, 33.35)] == [66.7, 0.0, 0.1, 33.4]


@given(st.floats(allow_nan=False, allow_infinity=False))
def test_floats_keep_their_value(x):
    assert float(float_text(x)) == x and float(plain(x)) == x


def test_kinds_and_pools():
    assert kind_label({"i64": 2, "String": 1, "bool": 0}) == "mixed(String: 1, i64: 2)" and kind_label({"f64": 3}) == "f64"
    assert list(pool([1, [None, [2, {"a": 1}]], []])) == [1, 2, {"a": 1}]
    assert [scalar(x) for x in (True, 5, 2**64 - 1, 2**64, 1.0, "x")] == [("bool", "true"), ("i64", "5"), ("i64", str(2**64 - 1)), ("f64", float_text(2.0**64)), ("f64", "1.0"), ("String", "x")]
    assert compact({"b": [1.0, None], "a": "é"}) == '{"a":"é","b":[1.0,null]}'
    assert missing_pct(3, 1) == 66.7 and missing_pct(0, 0) == 0.0 and missing_pct(3000, 2999) == 0.0
    assert Values(n=2, flags=dict.fromkeys(FLAGS, 2)).all("i64")


@pytest.mark.parametrize("texts", [[], [None]])
def test_nothing(spark, texts):
    rows = spark.createDataFrame([(i, [t]) for i, t in enumerate(texts)], "rec long, values array<string>")
    found = value_stats(column_leaves("t", rows), 3)
    assert all(v.n == 0 for v in found.values())
