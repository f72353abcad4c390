"""The engine's queries over the driver's tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulore.functions import predicates as P
from tabulore.operators.leaves import OBJECT, SLOT, spread
from tabulore.operators.profile import as_frame, profiles
from tabulore.plans import format_queries
from tabulore.plans.dictionary import profile
from tabulore.plans.render import SCHEMA_TYPES
from tabulore.sources import columnar, lines

Query = Callable[[SparkSession, str], DataFrame]
#: Columns of the tables without nesting: name and label.
TABLES = {
    "region": "r_regionkey i64, r_name String",
    "nation": "n_nationkey i64, n_name String, n_regionkey i64",
    "customer": "c_custkey i64, c_name String, c_nationkey i64, c_acctbal f64, c_mktsegment String",
    "supplier": "s_suppkey i64, s_name String, s_nationkey i64, s_acctbal f64",
    "part": "p_partkey i64, p_name String, p_brand String, p_type String, p_size i64, p_retailprice f64",
    "orders": "o_orderkey i64, o_custkey i64, o_orderstatus String, o_totalprice f64, o_orderdate Timestamp, o_orderpriority String",
    "lineitem": "l_orderkey i64, l_partkey i64, l_suppkey i64, l_linenumber i64, l_quantity f64, l_extendedprice f64, l_discount f64, l_tax f64, l_returnflag String, l_linestatus String, l_shipdate Timestamp",
    "events": "event_id i64, ts Timestamp, user_id i64, event_type String, value f64, props String",
    "documents": "doc_id i64, text String, lang String, source String, n_chars i64",
    "pages": "page_id i64, url String, html String",
    "benchmark": "item_id i64, text String",
    "labels": "doc_id i64, quality i64, toxic i64",
    "conversations": "conv_id i64, turn i64, role String, text String",
}


def columns_of(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in TABLES[table].split(", ")]


def shown(df: DataFrame) -> DataFrame:
    return df.withColumn("sample_values", F.array_join("sample_values", ", "))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("*", F.col("_metadata.row_index").alias("rec")))


# SQL

#: Spelled out, so that the SQL doesn't follow the engine's own names.
FACILITIES_SQL = "'kernel', 'user', 'mail', 'daemon', 'auth', 'syslog', 'lpr', 'news', 'uucp', 'cron', 'authpriv', 'ftp', 'ntp', 'security', 'console', 'solaris-cron', 'local0', 'local1', 'local2', 'local3', 'local4', 'local5', 'local6', 'local7'"
SEVERITIES_SQL = "'emergency', 'alert', 'critical', 'error', 'warning', 'notice', 'informational', 'debug'"
EMPTY_SQL, MISSING_SQL = "'column is empty/all null'", "'has missing values -> wrap in Option<T> / handle nulls'"
DATES_SQL = ["%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%m-%d-%Y", "%d %b %Y", "%b %d, %Y", "%d/%b/%Y:%H:%M:%S %z", "%Y%m%d"]


def text_sql(column: str, label: str) -> str:
    if label != "Timestamp":
        return f"CAST({column} AS VARCHAR)"
    us = f"(epoch_us({column}) % 1000000)"
    fraction = f"CASE WHEN {us} = 0 THEN '' WHEN {us} % 1000 = 0 THEN '.' || lpad(CAST({us} // 1000 AS VARCHAR), 3, '0') ELSE '.' || lpad(CAST({us} AS VARCHAR), 6, '0') END"
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S') || {fraction}"


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


I64_SQL = "CASE WHEN {0} IS NOT NULL THEN regexp_full_match({0}, '[+-]?[0-9]+') AND try_cast({0} AS BIGINT) IS NOT NULL END"
F64_SQL = r"regexp_full_match({0}, '[+-]?(([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))')"
BOOL_SQL = "lower({0}) IN ('true', 'false', 'yes', 'no', 'y', 'n')"
STRIPPED_SQL = "translate({0}, ',$', '')"


def date_sql(v: str, fmt: str) -> str:
    return f"CASE WHEN {v} IS NOT NULL THEN length({v}) >= 5 AND {v} = trim({v}) AND try_strptime({v}, {quoted(fmt)}) IS NOT NULL END"


def profile_sql(table: str, source: str, columns: list[tuple[str, str | None, str]]) -> str:
    """source: a query with rn. columns: name, declared type, and the SQL of its text."""
    long = "\nUNION ALL\n".join(f"SELECT rn, {i} AS i, {text} AS t FROM src" for i, (_, _, text) in enumerate(columns))
    names = ", ".join(f"({i}, {quoted(name)}, {quoted(declared)})" for i, (name, declared, _) in enumerate(columns))
    dates = " ".join(f"WHEN bool_and({date_sql('t', fmt)}) THEN {quoted(fmt)}" for fmt in DATES_SQL)
    clean = STRIPPED_SQL.format("t")
    return f"""
WITH src AS ({source}), names(i, name, declared) AS (VALUES {names}), long AS (
{long}), a AS (
  SELECT i, count(*) AS total, count(t) AS n, bool_or(regexp_matches(t, '^0[0-9]')) AS lead,
    bool_and({BOOL_SQL.format('t')}) AS bw, CASE {dates} END AS d,
    bool_and({I64_SQL.format(clean)}) AS ci, bool_and({F64_SQL.format(clean)}) AS cf,
    CASE WHEN count(t) = 0 THEN 'String' WHEN bool_and(lower(t) IN ('true', 'false')) THEN 'bool' WHEN bool_and({I64_SQL.format('t')}) THEN 'i64'
      WHEN bool_and({F64_SQL.format('t')}) THEN 'f64' ELSE 'String' END AS naive,
    count(DISTINCT t) AS u
  FROM long GROUP BY i), s AS (
  SELECT i, string_agg(t, ', ' ORDER BY k) AS s FROM (
    SELECT i, t, row_number() OVER (PARTITION BY i ORDER BY min(rn)) AS k FROM long WHERE t IS NOT NULL GROUP BY i, t) WHERE k <= 3 GROUP BY i), b AS (
  SELECT i, name, coalesce(declared, naive) AS current_type, a.* EXCLUDE (i), coalesce(s.s, '') AS sample_values,
    floor((total - n) / greatest(total, 1) * 100 * 10 + 0.5) / 10 AS missing_pct
  FROM names JOIN a USING (i) LEFT JOIN s USING (i)), c AS (
  SELECT *, CASE WHEN n = 0 THEN 'String' WHEN lead THEN 'String' WHEN bw THEN 'bool' WHEN d IS NOT NULL THEN 'NaiveDate / DateTime' WHEN ci THEN 'i64' WHEN cf THEN 'f64'
      WHEN u <= 50 AND u / n < 0.05 THEN 'enum / category' ELSE 'String' END AS ideal_type,
    CASE WHEN n = 0 THEN {EMPTY_SQL}
      WHEN lead THEN 'leading zeros in raw values (likely an ID/code)' || CASE WHEN current_type IN ('i64', 'f64') THEN ' - a naive numeric parse already lost them' ELSE '' END
      WHEN bw THEN 'values are yes/no/true/false' WHEN d IS NOT NULL THEN 'all values match date format "' || d || '"'
      WHEN ci THEN CASE WHEN current_type = 'i64' THEN '' ELSE 'numeric strings' END
      WHEN cf THEN CASE WHEN current_type = 'f64' THEN '' ELSE 'numeric strings' END
      WHEN u <= 50 AND u / n < 0.05 THEN 'low cardinality (' || u || ' unique values)' ELSE '' END AS note
  FROM b)
SELECT {quoted(table)} AS table_name, CAST(i AS INTEGER) AS col_ord, name, current_type, ideal_type, '' AS description, CAST(missing_pct AS DOUBLE) AS missing_pct, sample_values,
  CASE WHEN missing_pct > 0 THEN CASE WHEN note = '' THEN '' ELSE note || '; ' END || {MISSING_SQL} ELSE note END AS notes
FROM c"""


def table_sql(table: str) -> str:
    return profile_sql(table, f"SELECT *, row_number() OVER () AS rn FROM {table}", [(n, k, text_sql(n, k)) for n, k in columns_of(table)])


EVENTS_SQL = "SELECT *, row_number() OVER () AS rn FROM events"
EMBEDDINGS_SQL = (
    profile_sql("embeddings", "SELECT *, row_number() OVER () AS rn FROM embeddings", [("vec_id", "i64", "CAST(vec_id AS VARCHAR)"), ("label", "i64", "CAST(label AS VARCHAR)")]).replace("CAST(i AS INTEGER)", "CAST(i * 2 AS INTEGER)")
    + """
UNION ALL
SELECT 'embeddings', 1, 'embedding', 'Vec<f64>', 'Vec<f64>', '', 0.0, (
  SELECT string_agg(CAST(x AS VARCHAR), ', ' ORDER BY k) FROM (SELECT unnest(embedding[:3]) AS x, unnest([1, 2, 3]) AS k FROM (SELECT embedding FROM embeddings LIMIT 1))), ''
"""
)

# Columns with something missing


HOLES = [
    ("user", "i64", "nullif(user_id % 7, 0)", "nullif(user_id % 7, 0)"),
    ("kind", "String", "nullif(event_type, 'error')", "nullif(event_type, 'error')"),
    ("none", "String", "cast(null as string)", "CAST(NULL AS VARCHAR)"),
    ("rare", "i64", "nullif(event_id, 5)", "nullif(event_id, 5)"),
    ("amount", "f64", "case when value > 1 then value end", "CASE WHEN value > 1 THEN value END"),
]


def missing_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).selectExpr("rec", *(f"{spark_sql} AS {name}" for name, _, spark_sql, _ in HOLES))
    return shown(ordered(rows, "holes"))


def ordered(rows: DataFrame, table: str) -> DataFrame:
    """The dictionary of rows whose order is in rec."""
    names = [c for c in rows.columns if c != "rec"]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    values = F.array(*(columnar.text_of(F.col(c), kinds[c]) for c in names))
    leaves = columnar.column_leaves(table, rows.select("rec", values.alias("values")))
    return as_frame(rows.sparkSession, profiles(leaves, 3, {table: [(c, columnar.label(kinds[c])) for c in names]}, columnar.spelled))


# Text columns whose types are naively inferred, as a delimited file's are


STRINGS = [
    ("padded", "lpad(cast(user_id as string), 6, '0')", "lpad(CAST(user_id AS VARCHAR), 6, '0')"),
    ("plain", "cast(user_id as string)", "CAST(user_id AS VARCHAR)"),
    ("spaced", "concat(' ', cast(user_id as string))", "' ' || CAST(user_id AS VARCHAR)"),
    ("money", "concat('$', cast(event_id + 1 as string), ',000')", "'$' || CAST(event_id + 1 AS VARCHAR) || ',000'"),
    ("ratio", "concat(cast(user_id as string), '.5e1')", "CAST(user_id AS VARCHAR) || '.5e1'"),
    ("truth", "if(user_id % 2 = 0, 'TRUE', 'false')", "CASE WHEN user_id % 2 = 0 THEN 'TRUE' ELSE 'false' END"),
    ("word", "if(user_id % 2 = 0, 'Yes', 'n')", "CASE WHEN user_id % 2 = 0 THEN 'Yes' ELSE 'n' END"),
    ("day", "concat('2024-01-', cast(1 + event_id % 28 as string))", "'2024-01-' || CAST(1 + event_id % 28 AS VARCHAR)"),
    ("us_day", "concat('12/', cast(13 + event_id % 15 as string), '/1999')", "'12/' || CAST(13 + event_id % 15 AS VARCHAR) || '/1999'"),
    ("eu_day", "concat(cast(13 + event_id % 15 as string), '-11-1999')", "CAST(13 + event_id % 15 AS VARCHAR) || '-11-1999'"),
    ("named_day", "concat(cast(10 + event_id % 20 as string), ' Jan 2024')", "CAST(10 + event_id % 20 AS VARCHAR) || ' Jan 2024'"),
    ("long_day", "concat('Mar ', cast(10 + event_id % 20 as string), ', 2024')", "'Mar ' || CAST(10 + event_id % 20 AS VARCHAR) || ', 2024'"),
    ("moment", "concat('2024-02-', cast(10 + event_id % 19 as string), ' 10:20:30')", "'2024-02-' || CAST(10 + event_id % 19 AS VARCHAR) || ' 10:20:30'"),
    ("solid_day", "cast(20240101 + event_id % 28 as string)", "CAST(20240101 + event_id % 28 AS VARCHAR)"),
    ("no_day", "concat('2023-02-', cast(28 + event_id % 3 as string))", "'2023-02-' || CAST(28 + event_id % 3 AS VARCHAR)"),
    ("huge", "concat('99999999999999999999', cast(user_id as string))", "'99999999999999999999' || CAST(user_id AS VARCHAR)"),
    ("empty", "nullif(event_type, event_type)", "nullif(event_type, event_type)"),
]


def naive_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).selectExpr("rec", f"array({', '.join(s for _, s, _ in STRINGS)}) AS values")
    leaves = columnar.column_leaves("strings", rows)
    return shown(as_frame(spark, profiles(leaves, 3, {"strings": [(name, None) for name, _, _ in STRINGS]})))


def flag_query(names: list[str]) -> Query:
    """How many values of each text column above a predicate holds for."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = events(spark, sf_dir).selectExpr("stack(" + str(len(STRINGS)) + ", " + ", ".join(f"'{n}', {s}" for n, s, _ in STRINGS) + ") AS (name, t)").filter("t is not null")
        flagged = P.with_dates(rows, "t", [int(n[5:]) for n in names]) if names[0].startswith("date_") else P.with_flags(rows, "t")
        return flagged.groupBy("name").agg(*(F.count_if(n).alias(n) for n in names))

    return run


def flag_sql(names: dict[str, str]) -> str:
    union = " UNION ALL ".join(f"SELECT {quoted(n)} AS name, {d} AS t FROM events" for n, _, d in STRINGS)
    return f"SELECT name, {', '.join(f'CAST(count_if({sql}) AS BIGINT) AS {n}' for n, sql in names.items())} FROM ({union}) WHERE t IS NOT NULL GROUP BY name"


CLEAN = STRIPPED_SQL.format("t")
FLAG_QUERIES = {
    "leading_zero": {"leading_zero": "regexp_matches(t, '^0[0-9]')"},
    "bool_word": {"bool_word": BOOL_SQL.format("t"), "naive_bool": "lower(t) IN ('true', 'false')"},
    "numeric_strict": {"i64": I64_SQL.format("t"), "f64": F64_SQL.format("t")},
    "currency_strip": {"clean_i64": I64_SQL.format(CLEAN), "clean_f64": F64_SQL.format(CLEAN)},
    "date_match": {f"date_{i}": date_sql("t", fmt) for i, fmt in enumerate(DATES_SQL)},
}

# JSON


def prop_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.text_records("events", events(spark, sf_dir).select("rec", F.concat(F.lit('{"props":'), F.col("props"), F.lit("}")).alias("value")))


def flatten_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(as_frame(spark, profiles(prop_leaves(spark, sf_dir), 3)))


def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = prop_leaves(spark, sf_dir).filter(F.col("kind") != SLOT)
    return leaves.groupBy("key", "kind").agg(F.count("*").alias("n"))


FIRST_PROPS = "(SELECT string_agg(x, ', ' ORDER BY k) FROM (SELECT {0} AS x, row_number() OVER (ORDER BY min(rn)) AS k FROM (SELECT *, row_number() OVER () AS rn FROM events) GROUP BY 1) WHERE k <= 3)"
FLATTEN_SQL = f"""
SELECT 'events' AS table_name, CAST(0 AS INTEGER) AS col_ord, 'props' AS name, 'object' AS current_type, 'struct' AS ideal_type, '' AS description, 0.0::DOUBLE AS missing_pct,
  {FIRST_PROPS.format("replace(props, ' ', '')")} AS sample_values, 'flattened into props.* below' AS notes
UNION ALL
SELECT 'events', 1, 'props.k', 'i64', 'i64', '', 0.0, {FIRST_PROPS.format("json_extract_string(props, '$.k')")}, ''
"""
HISTOGRAM_SQL = f"""
SELECT '["props"]' AS key, '{OBJECT}' AS kind, count(*) AS n FROM events
UNION ALL
SELECT '["props", "k"]', CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'i64' WHEN 'BIGINT' THEN 'i64' WHEN 'DOUBLE' THEN 'f64' WHEN 'VARCHAR' THEN 'String' ELSE 'bool' END, count(*)
FROM events GROUP BY 2
"""


def mixed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("""concat('{"v":', case event_id % 3 when 0 then concat('"x', event_id, '"') when 1 then cast(event_id as string) else 'true' end, '}')""")
    leaves = lines.text_records("mixed", events(spark, sf_dir).select("rec", value.alias("value")))
    return shown(as_frame(spark, profiles(leaves, 3)))


MIXED_SQL = """
SELECT 'mixed' AS table_name, CAST(0 AS INTEGER) AS col_ord, 'v' AS name,
  'mixed(String: ' || count_if(event_id % 3 = 0) || ', bool: ' || count_if(event_id % 3 = 2) || ', i64: ' || count_if(event_id % 3 = 1) || ')' AS current_type,
  'String' AS ideal_type, '' AS description, 0.0::DOUBLE AS missing_pct, 'x0, 1, true' AS sample_values, '' AS notes
FROM events
"""

# Lines


COMBINED_LINE = "concat('10.0.0.', user_id % 9, ' - ', if(event_id % 3 = 0, '-', concat('u', user_id)), ' [10/Oct/2023:13:55:', cast(10 + event_id % 50 as string), ' +0000] \"', if(event_id % 10 = 9, 'BROKEN', concat('GET /', event_type, ' HTTP/1.1')), '\" ', if(event_type = 'error', '500', '200'), ' ', if(event_id % 4 = 0, '-', cast(event_id + 100 as string))"
LINES = {
    "log_common": COMBINED_LINE + ")",
    "log_combined": COMBINED_LINE + ", ' \"', if(event_id % 5 = 0, '-', 'http://x/y'), '\" \"agent ', event_id % 3, '\"')",
    "syslog3164": "concat('<', event_id % 200, '>Oct 11 22:14:', cast(10 + event_id % 50 as string), ' host', user_id % 5, ' app', if(event_id % 3 = 0, '', concat('[', user_id, ']')), ': said ', event_type)",
    "syslog5424": "concat('<', event_id % 200, '>1 2024-01-01T00:00:', cast(10 + event_id % 50 as string), 'Z ', if(event_id % 4 = 0, '-', concat('host', user_id % 5)), ' app ', if(event_id % 3 = 0, '-', cast(user_id as string)), ' ID', event_id % 7, ' ', if(event_id % 2 = 0, '-', concat('[a b=\"', event_id % 6, '\"]')), ' said ', event_type)",
}
WEB_SQL = [
    ("host", "'10.0.0.' || user_id % 9"),
    ("ident", "CAST(NULL AS VARCHAR)"),
    ("authuser", "CASE WHEN event_id % 3 <> 0 THEN 'u' || user_id END"),
    ("timestamp", "'10/Oct/2023:13:55:' || 10 + event_id % 50 || ' +0000'"),
    ("method", "CASE WHEN event_id % 10 <> 9 THEN 'GET' END"),
    ("path", "CASE WHEN event_id % 10 <> 9 THEN '/' || event_type END"),
    ("protocol", "CASE WHEN event_id % 10 <> 9 THEN 'HTTP/1.1' END"),
    ("status", "CASE WHEN event_type = 'error' THEN '500' ELSE '200' END"),
    ("bytes", "CASE WHEN event_id % 4 <> 0 THEN CAST(event_id + 100 AS VARCHAR) END"),
]
WEB_SQL = [(n, s.replace("10 + event_id % 50", "CAST(10 + event_id % 50 AS VARCHAR)")) for n, s in WEB_SQL]
PRI_SQL = [
    ("facility", f"CASE WHEN (event_id % 200) // 8 < 24 THEN [{FACILITIES_SQL}][(event_id % 200) // 8 + 1] ELSE CAST((event_id % 200) // 8 AS VARCHAR) END"),
    ("severity", f"[{SEVERITIES_SQL}][(event_id % 200) % 8 + 1]"),
]
LINE_SQL = {
    "log_common": WEB_SQL,
    "log_combined": [*WEB_SQL, ("referer", "CASE WHEN event_id % 5 <> 0 THEN 'http://x/y' END"), ("user_agent", "'agent ' || event_id % 3")],
    "syslog3164": [*PRI_SQL, ("timestamp", "'Oct 11 22:14:' || CAST(10 + event_id % 50 AS VARCHAR)"), ("hostname", "'host' || user_id % 5"), ("tag", "'app'"), ("pid", "CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END"), ("message", "'said ' || event_type")],
    "syslog5424": [*PRI_SQL, ("version", "'1'"), ("timestamp", "'2024-01-01T00:00:' || CAST(10 + event_id % 50 AS VARCHAR) || 'Z'"), ("hostname", "CASE WHEN event_id % 4 <> 0 THEN 'host' || user_id % 5 END"), ("app_name", "'app'"), ("procid", "CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS VARCHAR) END"), ("msgid", "'ID' || event_id % 7"), ("structured_data", "CASE WHEN event_id % 2 <> 0 THEN '[a b=\"' || event_id % 6 || '\"]' END"), ("message", "'said ' || event_type")],
}


def line_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # exploded, so that the long expression is computed once and not once for each use
        text = events(spark, sf_dir).selectExpr("rec", f"explode(array({LINES[name]})) AS value")
        if name.startswith("log"):
            leaves, columns = lines.weblog(text, name, None, name == "log_combined")
        else:
            leaves, columns = lines.syslog(text, name, None, name == "syslog5424")
        return shown(as_frame(spark, profiles(leaves, 3, {name: columns})))

    return run


def line_sql(name: str) -> str:
    fixed = [(n, s.replace("|| user_id % 9", "|| CAST(user_id % 9 AS VARCHAR)").replace("|| user_id % 5", "|| CAST(user_id % 5 AS VARCHAR)").replace("|| user_id END", "|| CAST(user_id AS VARCHAR) END").replace("|| event_id % 3", "|| CAST(event_id % 3 AS VARCHAR)").replace("|| event_id % 7", "|| CAST(event_id % 7 AS VARCHAR)").replace("|| event_id % 6", "|| CAST(event_id % 6 AS VARCHAR)")) for n, s in LINE_SQL[name]]
    return profile_sql(name, EVENTS_SQL, [(n, None, s) for n, s in fixed])


def facility_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pri = F.col("event_id") % 200
    rows = events(spark, sf_dir).select(lines.named(F.floor(pri / 8).cast("int"), lines.FACILITIES).alias("facility"), lines.named((pri % 8).cast("int"), lines.SEVERITIES).alias("severity"))
    return rows.groupBy("facility", "severity").agg(F.count("*").alias("n"))


FACILITY_SQL = f"SELECT {PRI_SQL[0][1]} AS facility, {PRI_SQL[1][1]} AS severity, count(*) AS n FROM events GROUP BY ALL"
WIDE = [("user", 8, "cast(user_id as string)", "CAST(user_id AS VARCHAR)"), ("kind", 10, "if(event_id % 6 = 0, '', event_type)", "CASE WHEN event_id % 6 <> 0 THEN event_type END"), ("code", 6, "lpad(cast(user_id % 100 as string), 5, '0')", "lpad(CAST(user_id % 100 AS VARCHAR), 5, '0')")]


def fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = "concat(" + ", ".join(f"rpad({s}, {w}, ' ')" for _, w, s, _ in WIDE) + ")"
    head = spark.range(1).select(F.lit(-1).cast("long").alias("rec"), F.lit("".join(n.ljust(w) for n, w, _, _ in WIDE)).alias("value"))
    text = head.unionByName(events(spark, sf_dir).selectExpr("rec", f"{padded} AS value"))
    leaves, columns = lines.fixed_width(text, "fixed", None, [w for _, w, _, _ in WIDE])
    return shown(as_frame(spark, profiles(leaves, 3, {"fixed": columns})))


# Renderings


def schema_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for k, v in SCHEMA_TYPES.items() for x in (k, v[0])))
    return profile(spark, f"{sf_dir}/orders.parquet").select("name", F.element_at(kinds, F.col("ideal_type")).alias("type"), F.when(F.col("ideal_type") == "NaiveDate / DateTime", F.lit("date-time")).alias("format"))


def required_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_pct(spark, sf_dir).filter("missing_pct = 0").select("name")


SCHEMA_CASE = format_queries.KINDS


def holes_sql() -> str:
    return profile_sql("holes", EVENTS_SQL, [(n, k, f"CAST({d} AS VARCHAR)") for n, k, _, d in HOLES])


def queries() -> dict[str, Query]:
    def table_query(table: str, spark: SparkSession, sf_dir: str) -> DataFrame:
        return shown(profile(spark, f"{sf_dir}/{table}.parquet"))

    out = {f"profile_{t}": partial(table_query, t) for t in [*TABLES, "embeddings"]}
    out |= {"missing_pct": missing_pct, "naive_type": naive_types, "flatten_props": flatten_props, "kind_histogram_props": kind_histogram, "mixed_kinds": mixed_kinds}
    out |= {name: flag_query(list(flags)) for name, flags in FLAG_QUERIES.items()}
    out |= {name: line_query(name) for name in LINES}
    out |= {"sample_values": sample_values, "cardinality_enum": cardinality_enum}
    out |= format_queries.queries()
    return out | {"facility_severity": facility_severity, "fixed_width": fixed_width, "json_schema_properties": schema_properties, "required_columns": required_columns}


def sample_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(profile(spark, f"{sf_dir}/events.parquet", samples=10)).select("name", "sample_values")


def cardinality_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(spark, f"{sf_dir}/part.parquet").filter("ideal_type = 'enum / category'").select("name", "notes")


def oracle_sql() -> dict[str, str]:
    out = {f"profile_{t}": table_sql(t) for t in TABLES}
    out |= {"profile_embeddings": EMBEDDINGS_SQL, "missing_pct": holes_sql(), "flatten_props": FLATTEN_SQL, "kind_histogram_props": HISTOGRAM_SQL, "mixed_kinds": MIXED_SQL}
    out["naive_type"] = profile_sql("strings", EVENTS_SQL, [(n, None, d) for n, _, d in STRINGS])
    out |= {name: flag_sql(flags) for name, flags in FLAG_QUERIES.items()}
    out |= {name: line_sql(name) for name in LINES}
    out |= format_queries.oracle_sql(profile_sql)
    out["facility_severity"] = FACILITY_SQL
    out["fixed_width"] = profile_sql("fixed", EVENTS_SQL, [(n, None, d) for n, _, _, d in WIDE])
    out["json_schema_properties"] = f"SELECT name, {SCHEMA_CASE} AS type, CASE WHEN ideal_type = 'NaiveDate / DateTime' THEN 'date-time' END AS format FROM ({table_sql('orders')})"
    out["required_columns"] = f"SELECT name FROM ({holes_sql()}) WHERE missing_pct = 0"
    out["sample_values"] = f"SELECT name, sample_values FROM ({table_sql('events').replace('k <= 3', 'k <= 10')})"
    out["cardinality_enum"] = f"SELECT name, notes FROM ({table_sql('part')}) WHERE ideal_type = 'enum / category'"
    return out
