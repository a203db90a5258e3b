"""Row check, frame validation, generated checks and consistency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepact import faults
from tablepact.catalogue.cleaning import (
    CLEAN_ORDERS_SQL,
    CLEAN_TRANSACTIONS_SQL,
    CLEAN_USERS_SQL,
    LINEITEM,
)
from tablepact.catalogue.registry import ENTRIES, query, scratch, union_counts
from tablepact.contracts import ORDERS, ROW_CHECK_USERS, TRANSACTIONS, USERS
from tablepact.operators import checks as K
from tablepact.operators import consistency as H
from tablepact.operators import framecheck, profile, rowcheck
from tablepact.operators.clean import clean
from tablepact.plans import flows
from tablepact.plans.shapes import DIGEST_BUCKETS, multiset_difference
from tablepact.sources import sinks

USERS_SRC = faults.sql("dirty_users")
ORDERS_SRC = faults.sql("dirty_orders")
STATUS_LIST = "'active', 'inactive', 'pending', 'suspended'"
STRICT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def dirty(spark, sf_dir, name):
    return faults.table(spark, sf_dir, name)


def cleaned(spark, sf_dir, name):
    contract = {"dirty_orders": ORDERS, "dirty_users": USERS, "dirty_transactions": TRANSACTIONS}[name]
    return clean(faults.table(spark, sf_dir, name), contract)


# --- row check --------------------------------------------------------------

def errors_sql(source: str, key: str, rows: list[tuple[str, str, str, str]]) -> str:
    parts = [
        f"SELECT CAST({key} AS VARCHAR) AS row, '{column}' AS \"column\", '{message}' AS error, "
        f"{column} AS value, '{severity}' AS severity FROM t WHERE {condition}"
        for column, message, severity, condition in rows]
    return f"WITH t AS (SELECT * FROM {source}) " + " UNION ALL ".join(parts)


NULL_MESSAGE = "NULL value not allowed"


def type_message(kind: str) -> str:
    return f"Type mismatch: expected {kind}, got str"


def not_parsed(c: str, sql_type: str) -> str:
    return f"{c} <> '' AND try_cast({c} AS {sql_type}) IS NULL"


def below(c: str, bound) -> str:
    return f"{c} <> '' AND try_cast({c} AS DOUBLE) < {bound}"


def above(c: str, bound) -> str:
    return f"{c} <> '' AND try_cast({c} AS DOUBLE) > {bound}"


INT_PARSE = r"^\s*[+-]?[0-9]+\s*$"

USER_ERROR_ROWS = [
    (c, NULL_MESSAGE, "high", f"{c} IS NULL OR {c} = ''")
    for c in ("id", "name", "email", "age", "join_date", "status", "score")
] + [
    ("id", type_message("integer"), "high", f"NOT regexp_matches(id, '{INT_PARSE}')"),
    ("age", type_message("integer"), "high", f"age <> '' AND NOT regexp_matches(age, '{INT_PARSE}')"),
    ("join_date", type_message("date"), "high", not_parsed("join_date", "DATE")),
    ("score", type_message("float"), "high", not_parsed("score", "DOUBLE")),
    ("email", "Invalid email format", "medium",
     "email <> '' AND NOT (contains(email, '@') AND contains(split_part(email, '@', -1), '.'))"),
    ("status", "Value not in allowed enum: [''active'', ''inactive'', ''pending'', ''suspended'']", "medium",
     f"status <> '' AND status NOT IN ({STATUS_LIST})"),
    ("age", "Value below minimum: 0", "medium", below("age", 0)),
    ("age", "Value above maximum: 150", "medium", above("age", 150)),
    ("score", "Value below minimum: 0", "medium", below("score", 0)),
    ("score", "Value above maximum: 100", "medium", above("score", 100)),
]
ORDER_ERROR_ROWS = [
    (c, NULL_MESSAGE, "high", f"{c} IS NULL OR {c} = ''")
    for c in ("order_id", "customer_id", "order_date", "total_amount", "shipping_address", "item_count")
] + [
    ("order_date", type_message("date"), "high", not_parsed("order_date", "DATE")),
    ("total_amount", type_message("float"), "high", not_parsed("total_amount", "DOUBLE")),
    ("item_count", type_message("integer"), "high", f"item_count <> '' AND NOT regexp_matches(item_count, '{INT_PARSE}')"),
    ("total_amount", "Value below minimum: 0.0", "medium", below("total_amount", 0)),
    ("total_amount", "Value above maximum: 100000.0", "medium", above("total_amount", 100000)),
    ("item_count", "Value below minimum: 1", "medium", below("item_count", 1)),
    ("item_count", "Value above maximum: 100", "medium", above("item_count", 100)),
]
USER_ERRORS_SQL = errors_sql(USERS_SRC, "id", USER_ERROR_ROWS)
ORDER_ERRORS_SQL = errors_sql(ORDERS_SRC, "order_id", ORDER_ERROR_ROWS)


@query("row_errors_users", "R1 R2 R3 R4 R5 R6", USER_ERRORS_SQL)
def row_errors_users(spark, sf_dir):
    return rowcheck.check_rows(dirty(spark, sf_dir, "dirty_users"), ROW_CHECK_USERS, "id")


@query("row_errors_orders", "R1 R2 R5 R6", ORDER_ERRORS_SQL)
def row_errors_orders(spark, sf_dir):
    return rowcheck.check_rows(dirty(spark, sf_dir, "dirty_orders"), ORDERS, "order_id")


@query("row_error_summary", "R7", f"""
SELECT (SELECT count(*) FROM {USERS_SRC}) AS total_rows, (SELECT count(*) FROM ({USER_ERRORS_SQL})) AS total_errors,
  (SELECT count(*) FROM ({USER_ERRORS_SQL})) / (SELECT count(*) FROM {USERS_SRC}) AS error_rate""")
def row_error_summary(spark, sf_dir):
    return rowcheck.check_summary(dirty(spark, sf_dir, "dirty_users"), ROW_CHECK_USERS)


@query("first_row_errors", "R7", f"""
SELECT * FROM ({USER_ERRORS_SQL}) ORDER BY row, "column", error LIMIT 50""")
def first_row_errors(spark, sf_dir):
    return rowcheck.first_errors(row_errors_users(spark, sf_dir), 50)


@query("root_causes_users", "H15", f"""
WITH e AS ({USER_ERRORS_SQL}), d AS (
  SELECT *, row_number() OVER (PARTITION BY "column", error ORDER BY value) AS rn FROM (
    SELECT DISTINCT "column", error, value FROM e WHERE value IS NOT NULL))
SELECT e."column", e.error, severity, count(*) AS rows_affected,
  (SELECT string_agg(value, '|' ORDER BY value) FROM d
   WHERE d."column" = e."column" AND d.error = e.error AND rn <= 5) AS sample_values
FROM e GROUP BY e."column", e.error, severity""")
def root_causes_users(spark, sf_dir):
    found = rowcheck.root_causes(row_errors_users(spark, sf_dir))
    return found.withColumn("sample_values", F.concat_ws("|", "sample_values"))


@query("rows_split_by_errors", "R6 S11", f"""
SELECT CASE WHEN o.order_id IN (SELECT row FROM ({ORDER_ERRORS_SQL})) THEN 'rejected' ELSE 'good' END AS side,
  count(*) AS rows FROM {ORDERS_SRC} o GROUP BY 1""")
def rows_split_by_errors(spark, sf_dir):
    good, rejected = rowcheck.split_by_errors(dirty(spark, sf_dir, "dirty_orders"), ORDERS)
    return good.select(F.lit("good").alias("side")).unionAll(
        rejected.select(F.lit("rejected"))).groupBy("side").agg(F.count(F.lit(1)).alias("rows"))


# --- frame validation -------------------------------------------------------

ISSUE_TEXT = {
    "missing_column": "'Column ''{column}'' missing from cleaned data'",
    "extra_column": "'Extra column ''{column}'' not in ideal schema'",
    "null_values": "concat('Column has ', {count}, ' null values but is defined as NOT NULL')",
    "type_mismatch": "concat('Expected type ''', {expected}, ''', got ''', {actual}, '''')",
    "below_min": "concat({count}, ' values below minimum ', {expected})",
    "above_max": "concat({count}, ' values above maximum ', {expected})",
    "invalid_enum": "concat({count}, ' values not in allowed enum: ', {expected})",
    "too_short": "concat({count}, ' values shorter than minimum length ', {expected})",
    "too_long": "concat({count}, ' values longer than maximum length ', {expected})",
    "invalid_email": "concat({count}, ' values have invalid email format')",
}


def issue(column, name, count, *, expected=None, actual=None, severity="high", hits=None, source="t",
          examples="''"):
    def lit(v):
        return "CAST(NULL AS VARCHAR)" if v is None else v

    text = ISSUE_TEXT[name].format(column=column, count=count, expected=expected, actual=actual)
    return (f"SELECT '{column}' AS \"column\", '{name}' AS issue, {count} AS count, "
            f"{lit(expected)} AS expected, {lit(actual)} AS actual, '{severity}' AS severity, "
            f"{text} AS message, {examples} AS examples, {hits or count} AS hits FROM {source}")


def count_where(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


NO_COUNT = "CAST(NULL AS BIGINT)"


def issues_sql(source: str, parts: list[str]) -> str:
    return (f"WITH t AS (SELECT * FROM {source}) SELECT * EXCLUDE (hits) FROM ("
            + " UNION ALL ".join(parts) + ") WHERE hits > 0")


def double_text(expr: str) -> str:
    return f"CAST(CAST({expr} AS DOUBLE) AS VARCHAR)"


BASIC_USERS = f"""(SELECT CAST(id AS INTEGER) AS id, nullif(name, '') AS name, nullif(email, '') AS email,
  try_cast(trunc(try_cast(age AS DOUBLE)) AS INTEGER) AS age, try_cast(join_date AS DATE) AS join_date, status,
  try_cast(score AS DOUBLE) AS score, nullif(metadata, '') AS metadata, 1 AS batch FROM {USERS_SRC})"""

BAD_STATUS = ("(SELECT string_agg(status, '|' ORDER BY status) FROM (SELECT DISTINCT status FROM t "
              f"WHERE status NOT IN ({STATUS_LIST}) ORDER BY status LIMIT 5))")

FRAME_PARTS = [
    issue("name", "null_values", count_where("name IS NULL")),
    issue("email", "null_values", count_where("email IS NULL")),
    issue("age", "null_values", count_where("age IS NULL")),
    issue("join_date", "null_values", count_where("join_date IS NULL")),
    issue("age", "below_min", count_where("age < 0"), expected="'0'", actual=double_text("min(age)")),
    issue("age", "above_max", count_where("age > 150"), expected="'150'", actual=double_text("max(age)")),
    issue("score", "below_min", count_where("score < 0"), expected="'0.0'", actual=double_text("min(score)")),
    issue("score", "above_max", count_where("score > 100"), expected="'100.0'", actual=double_text("max(score)")),
    issue("status", "invalid_enum", count_where(f"status NOT IN ({STATUS_LIST})"),
          expected="'[''active'', ''inactive'', ''pending'', ''suspended'']'", examples=BAD_STATUS),
    issue("email", "invalid_email", count_where(f"NOT regexp_matches(email, '{STRICT}')")),
    issue("metadata", "type_mismatch", NO_COUNT, expected="'json'", actual="'string'",
          hits=count_where("NOT json_valid(metadata)")),
    issue("batch", "extra_column", NO_COUNT, hits="count(*)"),
]


def typed_users(spark, sf_dir):
    """Coerced but not repaired, so every rule still has something to find."""
    bare = type(USERS)("users", tuple(type(c)(name=c.name, type="string" if c.type == "json" else c.type)
                                      for c in USERS.columns))
    return clean(dirty(spark, sf_dir, "dirty_users"), bare, rules="basic").withColumn("batch", F.lit(1))


@query("frame_issues_users", "V2 V4 V5 V6 V8 V9 V10", issues_sql(BASIC_USERS, FRAME_PARTS))
def frame_issues_users(spark, sf_dir):
    found = framecheck.frame_issues(typed_users(spark, sf_dir), USERS)
    return found.withColumn("examples", F.concat_ws("|", "examples"))


@query("frame_issues_staged_orders", "V1 V3 V7 V9 V10", issues_sql(
    f"(SELECT * EXCLUDE (customer_id), 1 AS batch FROM {ORDERS_SRC})", [
        issue("customer_id", "missing_column", NO_COUNT, hits="count(*)"),
        issue("batch", "extra_column", NO_COUNT, hits="count(*)"),
        issue("shipping_address", "too_short", count_where("length(shipping_address) < 5"), expected="'5'",
              severity="medium"),
        issue("shipping_address", "too_long", count_where("length(shipping_address) > 255"), expected="'255'",
              severity="medium"),
    ] + [issue(c, "type_mismatch", NO_COUNT, expected=f"'{t}'", actual="'string'", hits="count(*)")
         for c, t in (("order_id", "integer"), ("order_date", "date"), ("total_amount", "float"),
                      ("item_count", "integer"))]))
def frame_issues_staged_orders(spark, sf_dir):
    staged = dirty(spark, sf_dir, "dirty_orders").drop("customer_id").withColumn("batch", F.lit(1))
    return framecheck.frame_issues(staged, ORDERS).withColumn("examples", F.concat_ws("|", "examples"))


@query("frame_summary_cleaned", "V10", " UNION ALL ".join(
    f"SELECT '{name}' AS name, count(*) AS row_count, CAST(0 AS BIGINT) AS issue_count, true AS is_valid FROM {base}"
    for name, base in (("orders", "orders"), ("users", "customer"), ("transactions", "events"))))
def frame_summary_cleaned(spark, sf_dir):
    """No issue is left after cleaning."""
    found = [framecheck.frame_summary(cleaned(spark, sf_dir, f"dirty_{c.name}"), c).select(
        F.lit(c.name).alias("name"), "row_count", "issue_count", "is_valid") for c in (ORDERS, USERS, TRANSACTIONS)]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("frame_summary_users", "V10", f"""
SELECT (SELECT count(*) FROM customer) AS row_count, count(*) AS issue_count, count(*) = 0 AS is_valid
FROM ({issues_sql(BASIC_USERS, FRAME_PARTS)})""")
def frame_summary_users(spark, sf_dir):
    return framecheck.frame_summary(typed_users(spark, sf_dir), USERS)


@query("frame_column_statistics", "V2 V3 V10", f"WITH t AS (SELECT * FROM {BASIC_USERS}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{i}' AS ideal_type, '{a}' AS actual_type, count(*) - count({c}) AS null_count FROM t"
    for c, i, a in (("id", "integer", "integer"), ("name", "string", "string"), ("email", "string", "string"),
                    ("age", "integer", "integer"), ("join_date", "date", "date"), ("status", "string", "string"),
                    ("score", "float", "float"), ("metadata", "json", "string"))))
def frame_column_statistics(spark, sf_dir):
    return framecheck.column_statistics(typed_users(spark, sf_dir), USERS)


@query("columns_with_nulls", "V11", f"WITH t AS (SELECT * FROM {BASIC_USERS}) SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_count FROM t"
    for c in ("id", "name", "email", "age", "join_date", "status", "score", "metadata", "batch"))
    + ") WHERE null_count > 0")
def columns_with_nulls(spark, sf_dir):
    return framecheck.columns_with_nulls(typed_users(spark, sf_dir))


# --- generated checks -------------------------------------------------------

def null_rows(table, columns):
    return [(f"{table}_{c}_not_null", f"{c} IS NULL") for c in columns]


def type_rows(table, types):
    return [(f"{table}_{c}_type_check", f"typeof({c}) <> '{t}'") for c, t in types.items()]


ORDER_CHECKS = [("orders_clean_row_count", "true")] + null_rows(
    "orders_clean", ORDERS.names) + type_rows("orders_clean", {
        "order_id": "INTEGER", "customer_id": "INTEGER", "order_date": "DATE", "total_amount": "DOUBLE",
        "shipping_address": "VARCHAR", "item_count": "INTEGER"}) + [
    ("orders_clean_order_date_date_valid", "order_date IS NOT NULL AND typeof(order_date) NOT IN ('DATE', 'TIMESTAMP')"),
    ("orders_clean_total_amount_min", "total_amount < 0"), ("orders_clean_total_amount_max", "total_amount > 100000"),
    ("orders_clean_shipping_address_min_length", "length(shipping_address) < 5"),
    ("orders_clean_shipping_address_max_length", "length(shipping_address) > 255"),
    ("orders_clean_item_count_min", "item_count < 1"), ("orders_clean_item_count_max", "item_count > 100")]
TRANSACTION_CHECKS = [("transactions_clean_row_count", "true")] + null_rows(
    "transactions_clean", TRANSACTIONS.names) + type_rows("transactions_clean", {
        "transaction_id": "INTEGER", "customer_id": "INTEGER", "amount": "DOUBLE", "date": "DATE",
        "category": "VARCHAR", "status": "VARCHAR"}) + [
    ("transactions_clean_amount_min", "amount < 0"), ("transactions_clean_amount_max", "amount > 10000"),
    ("transactions_clean_date_date_valid", "date IS NOT NULL AND typeof(date) NOT IN ('DATE', 'TIMESTAMP')"),
    ("transactions_clean_category_min_length", "length(category) < 1"),
    ("transactions_clean_category_max_length", "length(category) > 50"),
    ("transactions_clean_status_enum", "status NOT IN ('completed', 'pending', 'cancelled', 'refunded')")]


def user_checks(t: str) -> list[tuple[str, str]]:
    return [(f"{t}_row_count", "true")] + null_rows(t, USERS.names[:-1]) + type_rows(t, {
        "id": "INTEGER", "name": "VARCHAR", "email": "VARCHAR", "age": "INTEGER", "join_date": "DATE",
        "status": "VARCHAR", "score": "DOUBLE", "metadata": "VARCHAR"}) + [
        (f"{t}_name_min_length", "length(name) < 1"), (f"{t}_name_max_length", "length(name) > 255"),
        (f"{t}_email_email_format", "email IS NOT NULL AND email NOT LIKE '%_@_%._%'"),
        (f"{t}_email_max_length", "length(email) > 255"),
        (f"{t}_age_min", "age < 0"), (f"{t}_age_max", "age > 150"),
        (f"{t}_join_date_date_valid", "join_date IS NOT NULL AND typeof(join_date) NOT IN ('DATE', 'TIMESTAMP')"),
        (f"{t}_status_enum", f"status NOT IN ({STATUS_LIST})"),
        (f"{t}_score_min", "score < 0"), (f"{t}_score_max", "score > 100")]


def results_sql(source: str, rows) -> str:
    return (f"SELECT check_id, actual, CASE WHEN check_id LIKE '%_row_count' THEN (CASE WHEN actual > 0 THEN 'PASS' "
            f"ELSE 'FAIL' END) WHEN actual = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({union_counts(source, rows)})")


def check_results(df, contract, table):
    return K.run_checks(df, K.generate_checks(contract, table))


@query("checks_orders", "G1 G2 G3 G4 G5 G8 G9 G10 G12 G13", results_sql(f"({CLEAN_ORDERS_SQL})", ORDER_CHECKS))
def checks_orders(spark, sf_dir):
    return check_results(cleaned(spark, sf_dir, "dirty_orders"), ORDERS, "orders_clean").select(
        "check_id", "actual", "status")


@query("checks_transactions", "G1 G2 G3 G4 G5 G6 G8 G9 G10 G13",
       results_sql(f"({CLEAN_TRANSACTIONS_SQL})", TRANSACTION_CHECKS))
def checks_transactions(spark, sf_dir):
    return check_results(cleaned(spark, sf_dir, "dirty_transactions"), TRANSACTIONS, "transactions_clean").select(
        "check_id", "actual", "status")


@query("checks_users", "G1 G2 G3 G4 G5 G6 G7 G8 G9 G10 G13",
       results_sql(f"({CLEAN_USERS_SQL})", user_checks("users_clean")))
def checks_users(spark, sf_dir):
    return check_results(cleaned(spark, sf_dir, "dirty_users"), USERS, "users_clean").select(
        "check_id", "actual", "status")


UNREPAIRED_SQL = results_sql(BASIC_USERS, user_checks("users_typed"))


def unrepaired_results(spark, sf_dir):
    return check_results(typed_users(spark, sf_dir), USERS, "users_typed")


@query("checks_unrepaired_users", "G2 G4 G5 G6 G7 G12 G13", UNREPAIRED_SQL)
def checks_unrepaired_users(spark, sf_dir):
    """Checks that do fail: values are typed but not repaired."""
    return unrepaired_results(spark, sf_dir).select("check_id", "actual", "status")


@query("checks_basic_orders", "G11", union_counts(f"({CLEAN_ORDERS_SQL})", [
    r for r in ORDER_CHECKS if not r[0].endswith(("_length", "_date_valid"))]))
def checks_basic_orders(spark, sf_dir):
    found = K.run_checks(cleaned(spark, sf_dir, "dirty_orders"), K.basic_checks(ORDERS, "orders_clean"))
    return found.select("check_id", "actual")


@query("checks_with_errors", "G12 G13 G14", f"""
WITH t AS (SELECT * FROM {ORDERS_SRC})
SELECT 'orders_amount_min' AS check_id, CAST(NULL AS BIGINT) AS actual, 'ERROR' AS status
  WHERE (SELECT count(*) FROM t WHERE total_amount <> '' AND try_cast(total_amount AS DOUBLE) IS NULL) > 0
UNION ALL SELECT 'orders_no_such_column', NULL, 'ERROR'
UNION ALL SELECT 'orders_future_kind', NULL, 'PASS'
UNION ALL SELECT 'orders_any', count(*), 'PASS' FROM t
UNION ALL SELECT 'orders_few', count(*), CASE WHEN count(*) < 10 THEN 'PASS' ELSE 'FAIL' END FROM t
UNION ALL SELECT 'orders_blank_address', count(*), CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END
  FROM t WHERE shipping_address = ''""")
def checks_with_errors(spark, sf_dir):
    """Checks that cannot be decided do not stop the others."""
    return K.run_checks(dirty(spark, sf_dir, "dirty_orders"), [
        K.Check("orders_amount_min", "", kind="min", condition="`total_amount` < 0", column="total_amount"),
        K.Check("orders_no_such_column", "", condition="`nope` IS NULL", column="nope"),
        K.Check("orders_future_kind", "", check_type="statistical", condition="1 = 1"),
        K.Check("orders_any", "", expected=None),
        K.Check("orders_few", "", expected="< 10"),
        K.Check("orders_blank_address", "", condition="shipping_address = ''", expected="= 0"),
    ]).select("check_id", "actual", "status")


@query("verdicts_by_nation", "G12", """
SELECT nation, expected, actual, CASE WHEN expected IS NULL THEN 'PASS'
  WHEN expected LIKE '> %' THEN (CASE WHEN actual > CAST(substring(expected, 3) AS BIGINT) THEN 'PASS' ELSE 'FAIL' END)
  WHEN expected LIKE '< %' THEN (CASE WHEN actual < CAST(substring(expected, 3) AS BIGINT) THEN 'PASS' ELSE 'FAIL' END)
  WHEN expected LIKE '= %' THEN (CASE WHEN actual = CAST(substring(expected, 3) AS BIGINT) THEN 'PASS' ELSE 'FAIL' END)
  WHEN actual = CAST(expected AS BIGINT) THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT c_nationkey AS nation, count(*) AS actual, CASE c_nationkey % 5 WHEN 0 THEN '> 60' WHEN 1 THEN '< 60'
  WHEN 2 THEN '= 60' WHEN 3 THEN '0' END AS expected FROM customer GROUP BY c_nationkey)""")
def verdicts_by_nation(spark, sf_dir):
    counts = dirty(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count(F.lit(1)).alias("actual"))
    kind = F.col("nation") % 5
    expected = F.when(kind == 0, "> 60").when(kind == 1, "< 60").when(kind == 2, "= 60").when(kind == 3, "0")
    return counts.withColumn("expected", expected).withColumn(
        "status", K.verdict(F.col("expected"), F.col("actual")))


SUMMARY_SELECT = """count(*) AS total_checks, count(*) FILTER (WHERE status = 'PASS') AS checks_passed,
  count(*) FILTER (WHERE status = 'FAIL') AS checks_failed, count(*) FILTER (WHERE status = 'ERROR') AS checks_errored,
  CASE WHEN count(*) FILTER (WHERE status = 'FAIL') > 0 THEN 'FAIL'
    WHEN count(*) FILTER (WHERE status = 'ERROR') > 0 THEN 'WARN' ELSE 'PASS' END AS overall_status"""


@query("check_summary_unrepaired", "G14", f"SELECT {SUMMARY_SELECT} FROM ({UNREPAIRED_SQL})")
def check_summary_unrepaired(spark, sf_dir):
    return K.summary(unrepaired_results(spark, sf_dir))


@query("check_report_users", "G14 G15", f"""
SELECT 'users' AS name, 'users_clean' AS output_table, {SUMMARY_SELECT},
  (SELECT count(*) FROM customer) AS source_row_count, (SELECT count(*) FROM customer) AS output_row_count
FROM ({results_sql(f"({CLEAN_USERS_SQL})", user_checks("users_clean"))})""")
def check_report_users(spark, sf_dir):
    raw, out = dirty(spark, sf_dir, "dirty_users"), cleaned(spark, sf_dir, "dirty_users")
    results = check_results(out, USERS, "users_clean")
    return K.report(results, out, raw, "users", "users_clean").drop("check_results", "executed_at")


@query("failed_checks_unrepaired", "G16", f"SELECT check_id, actual FROM ({UNREPAIRED_SQL}) WHERE status = 'FAIL'")
def failed_checks_unrepaired(spark, sf_dir):
    return K.failed(unrepaired_results(spark, sf_dir)).select("check_id", "actual")


@query("critical_failures_unrepaired", "G16", f"""
SELECT check_id, actual FROM ({UNREPAIRED_SQL}) WHERE status = 'FAIL'
  AND (check_id LIKE '%_not_null' OR check_id LIKE '%_type_check')""")
def critical_failures_unrepaired(spark, sf_dir):
    return K.critical_failures(unrepaired_results(spark, sf_dir)).select("check_id", "actual")


@query("validate_output_transactions", "G17 S14", f"""
SELECT 'transactions' AS name, 'transactions_clean' AS output_table, {SUMMARY_SELECT},
  (SELECT count(*) FROM events) AS source_row_count, (SELECT count(*) FROM events) AS output_row_count
FROM ({results_sql(f"({CLEAN_TRANSACTIONS_SQL})", TRANSACTION_CHECKS)})""")
def validate_output_transactions(spark, sf_dir):
    """Checks are generated and stored, then read back from the store."""
    folder = scratch(spark, "checks")
    sinks.cached_checks(spark, TRANSACTIONS, folder)
    raw = dirty(spark, sf_dir, "dirty_transactions")
    return flows.validate_output(spark, TRANSACTIONS, clean(raw, TRANSACTIONS), folder, raw).drop(
        "check_results", "executed_at")


@query("clean_check_and_write_orders", "K18 G13 S12", results_sql(f"({CLEAN_ORDERS_SQL})", ORDER_CHECKS))
def clean_check_and_write_orders(spark, sf_dir):
    """Cleaning, checks and the write in one pass over the raw table."""
    raw = dirty(spark, sf_dir, "dirty_orders")
    results, _ = flows.clean_check_and_write(raw, ORDERS, scratch(spark, "orders-clean"))
    return results.select("check_id", "actual", "status")


def _lineitem_violations():
    """What each generated check counts, in SQL over the cleaned table; its types are those of the contract."""
    for rule in LINEITEM.columns:
        n, bounds = rule.name, rule.constraints
        yield f"{n}_not_null", f"{n} IS NULL"
        yield f"{n}_type_check", "false"
        if "min" in bounds:
            yield f"{n}_min", f"{n} < {bounds['min']}"
        if "max" in bounds:
            yield f"{n}_max", f"{n} > {bounds['max']}"
        if rule.enum:
            yield f"{n}_enum", f"{n} NOT IN ({', '.join(repr(v) for v in rule.enum)})"
        if rule.type == "date":
            yield f"{n}_date_valid", f"{n} IS NOT NULL AND try_cast({n} AS DATE) IS NULL"


@query("clean_and_check_lineitem", "K18 G2 G4 G5 G6 G13", f"""
WITH t AS ({ENTRIES["clean_lineitem"].sql}), c AS (
SELECT 'lineitem_row_count' AS check_id, count(*) AS actual, count(*) > 0 AS fine FROM t
""" + "".join(f" UNION ALL SELECT 'lineitem_{name}', count(*), count(*) = 0 FROM t WHERE {condition}"
              for name, condition in _lineitem_violations()) + """)
SELECT check_id, actual, CASE WHEN fine THEN 'PASS' ELSE 'FAIL' END AS status FROM c""")
def clean_and_check_lineitem(spark, sf_dir):
    return flows.clean_and_check(dirty(spark, sf_dir, "lineitem").select(*LINEITEM.names), LINEITEM, "lineitem").select(
        "check_id", "actual", "status")


# --- consistency ------------------------------------------------------------

@query("reconcile_orders", "H1", f"""
SELECT r AS source_count, c AS clean_count, CASE WHEN c = r THEN 'PASS' WHEN c = 0 THEN 'FAIL' WHEN c < r THEN 'WARN'
  ELSE 'ERROR' END AS status, concat('Only ', c, '/', r, ' rows processed - some may have been filtered') AS note
FROM (SELECT (SELECT count(*) FROM orders) AS r,
  (SELECT count(*) FROM {ORDERS_SRC} WHERE order_id NOT IN (SELECT row FROM ({ORDER_ERRORS_SQL}))) AS c)""")
def reconcile_orders(spark, sf_dir):
    raw = dirty(spark, sf_dir, "dirty_orders")
    return H.reconcile(raw, rowcheck.split_by_errors(raw, ORDERS)[0])


@query("reconcile_cleaned_users", "H1", """
SELECT count(*) AS source_count, count(*) AS clean_count, 'PASS' AS status,
  concat('All ', count(*), ' rows processed') AS note FROM customer""")
def reconcile_cleaned_users(spark, sf_dir):
    return H.reconcile(dirty(spark, sf_dir, "dirty_users"), cleaned(spark, sf_dir, "dirty_users"))


@query("null_matrix_users", "H2", f"WITH t AS (SELECT * FROM {BASIC_USERS}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS null_count, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status "
    f"FROM t WHERE {c} IS NULL" for c in USERS.names))
def null_matrix_users(spark, sf_dir):
    return H.null_matrix(typed_users(spark, sf_dir), USERS.names)


@query("type_matrix_users", "H3 X2", f"WITH t AS ({CLEAN_USERS_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{spark}' AS actual_type, '{want}' AS expected_type, "
    f"CASE WHEN max(typeof({c})) IN ({duck}) THEN 'PASS' ELSE 'FAIL' END AS status FROM t"
    for c, spark, want, duck in (
        ("id", "int", "int", "'INTEGER'"), ("age", "int", "bigint", "'BIGINT'"),
        ("score", "double", "float", "'FLOAT', 'DOUBLE'"), ("join_date", "date", "date", "'DATE'"),
        ("name", "string", "string", "'VARCHAR'"))))
def type_matrix_users(spark, sf_dir):
    return H.type_matrix(cleaned(spark, sf_dir, "dirty_users"), {
        "id": ("int",), "age": ("bigint",), "score": ("float", "double"), "join_date": ("date",),
        "name": ("string",)})


VIOLATIONS = [
    ("age_range", "age < 0 OR age > 150"), ("score_range", "score < 0 OR score > 100"),
    ("status_enum", "status NOT IN ('active', 'inactive', 'pending')"),
    ("date_range", "join_date < DATE '1900-01-01' OR join_date > DATE '2024-01-10'"),
    ("future_date", "join_date > DATE '2024-01-20'"),
    ("email_like", "email NOT LIKE '%_@_%._%'"),
    ("email_strict", f"NOT coalesce(regexp_matches(email, '{STRICT}'), false)"),
    ("score_number", "score IS NULL OR isnan(score) OR score = 'Infinity'::DOUBLE"),
    ("active_email", "status = 'active' AND (email IS NULL OR email = '' OR email NOT LIKE '%_@_%._%')"),
    ("unlikely_age", "(age < 18 AND status = 'active') OR age > 150"),
]


@query("violation_status_users", "H4 H5 H6 H7 H8 H10 H11", "SELECT check_name, violations, "
       "CASE WHEN violations > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM ("
       + union_counts(BASIC_USERS, VIOLATIONS, "check_name", "violations") + ")")
def violation_status_users(spark, sf_dir):
    age, score, status = F.col("age"), F.col("score"), F.col("status")
    date, email = F.col("join_date"), F.col("email")
    from tablepact.functions.predicates import is_not_a_number
    return H.violation_status(typed_users(spark, sf_dir), {
        "age_range": H.out_of_range(age, 0, 150), "score_range": H.out_of_range(score, 0, 100),
        "status_enum": H.outside_values(status, ["active", "inactive", "pending"]),
        "date_range": H.out_of_date_range(date, as_of="2024-01-10"),
        "future_date": H.in_future(date, as_of="2024-01-20"),
        "email_like": H.bad_email(email), "email_strict": H.bad_email(email, "strict"),
        "score_number": is_not_a_number(score),
        "active_email": H.active_needs_email(status, email),
        "unlikely_age": H.unlikely_age(age, status)})


@query("not_a_number_lineitem", "H8", """
SELECT count(*) FILTER (WHERE ratio IS NULL OR isnan(ratio) OR ratio = 'Infinity'::DOUBLE) AS bad_ratios, count(*) AS total_rows
FROM (SELECT CASE WHEN l_discount <> 0 THEN l_tax / l_discount WHEN l_tax = 0 THEN 'NaN'::DOUBLE ELSE 'Infinity'::DOUBLE END AS ratio
  FROM lineitem)""")
def not_a_number_lineitem(spark, sf_dir):
    from tablepact.functions.predicates import is_not_a_number
    tax, discount = F.col("l_tax"), F.col("l_discount")
    ratio = (F.when(discount != 0, tax / discount).when(tax == 0, float("nan")).otherwise(float("inf")))
    lines = dirty(spark, sf_dir, "lineitem").select(ratio.alias("ratio"))
    return profile.count_matching(lines, {"bad_ratios": is_not_a_number(F.col("ratio"))}, with_total=True)


@query("duplicate_keys_lineitem", "H9", """
SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def duplicate_keys_lineitem(spark, sf_dir):
    return H.duplicate_keys(dirty(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_texts", "H9", """
SELECT text, count(*) AS row_count FROM documents GROUP BY text HAVING count(*) > 1""")
def duplicate_texts(spark, sf_dir):
    return H.duplicate_keys(dirty(spark, sf_dir, "documents"), ["text"], wide=True)


@query("throughput_by_order", "H12", """
SELECT l_orderkey, rows, seconds, rows / seconds AS rows_per_second,
  CASE WHEN rows < 100000 AND seconds >= 60 THEN 'FAIL' WHEN rows / seconds <= 1000 THEN 'WARN' ELSE 'PASS' END
    AS performance_status
FROM (SELECT l_orderkey, CAST(sum(CAST(floor(l_extendedprice / 10) AS BIGINT)) AS BIGINT) AS rows, count(*) AS seconds
  FROM lineitem GROUP BY l_orderkey)""")
def throughput_by_order(spark, sf_dir):
    """Verdicts on run metrics; each order stands for a run with its rows and seconds."""
    runs = dirty(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.floor(F.col("l_extendedprice") / 10)).alias("rows"), F.count(F.lit(1)).alias("seconds"))
    return H.throughput_status(runs)


@query("idempotent_cleaning", "H13", f"""
WITH a AS ({CLEAN_ORDERS_SQL}), b AS ({CLEAN_ORDERS_SQL})
SELECT count(*) AS differing_rows, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status
FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a))""")
def idempotent_cleaning(spark, sf_dir):
    """Two runs give the same rows."""
    return H.idempotency(cleaned(spark, sf_dir, "dirty_orders"), cleaned(spark, sf_dir, "dirty_orders"))


@query("differing_runs", "H13", f"""
WITH a AS ({CLEAN_ORDERS_SQL}), b AS (SELECT * REPLACE (greatest(item_count, 20) AS item_count) FROM a),
 d AS (SELECT * FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 FROM b))
SELECT count(*) AS differing_rows, CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (
  SELECT sum(s) FROM d GROUP BY ALL EXCLUDE (s) HAVING sum(s) <> 0)""".replace(
    "SELECT sum(s) FROM d GROUP BY ALL EXCLUDE (s) HAVING sum(s) <> 0",
    "SELECT order_id, customer_id, order_date, total_amount, shipping_address, item_count FROM d "
    "GROUP BY order_id, customer_id, order_date, total_amount, shipping_address, item_count HAVING sum(s) <> 0"))
def differing_runs(spark, sf_dir):
    first = cleaned(spark, sf_dir, "dirty_orders")
    return H.idempotency(first, first.withColumn("item_count", F.greatest("item_count", F.lit(20))))


@query("differing_lines", "H13", """
WITH a AS (SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem),
b AS (SELECT l_orderkey, l_partkey, CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_returnflag FROM a
      UNION ALL SELECT * FROM a WHERE l_orderkey % 89 = 0)
SELECT l_orderkey, l_partkey, l_quantity, l_returnflag, sum(s) FILTER (WHERE s > 0) AS left_count, sum(-s) FILTER (WHERE s < 0) AS right_count
FROM (SELECT *, 1 AS s FROM a UNION ALL SELECT *, -1 FROM b) GROUP BY l_orderkey, l_partkey, l_quantity, l_returnflag HAVING sum(s) <> 0""".replace(
    "sum(s) FILTER (WHERE s > 0)", "CAST(count(*) FILTER (WHERE s > 0) AS BIGINT)").replace(
    "sum(-s) FILTER (WHERE s < 0)", "CAST(count(*) FILTER (WHERE s < 0) AS BIGINT)"))
def differing_lines(spark, sf_dir):
    """The rows themselves in which two tables differ, found through digests of buckets."""
    a = dirty(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag")
    nulled = F.when(F.col("l_orderkey") % 97 != 0, F.col("l_quantity"))
    b = a.withColumn("l_quantity", nulled).unionByName(a.where(F.col("l_orderkey") % 89 == 0))
    return multiset_difference(a, b, DIGEST_BUCKETS)


@query("severity_rollup_unrepaired", "H14", f"""
SELECT count(*) FILTER (WHERE critical) AS critical_failures, count(*) FILTER (WHERE high) AS high_failures,
  CASE WHEN count(*) FILTER (WHERE critical) > 0 THEN 'FAIL' WHEN count(*) FILTER (WHERE high) > 0 THEN 'WARN' ELSE 'PASS' END
    AS overall_status
FROM (SELECT status = 'FAIL' AND (check_id LIKE '%_not_null' OR check_id LIKE '%_type_check') AS critical,
  status = 'FAIL' AND regexp_matches(check_id, '_(min|max|enum|date_valid)$') AS high FROM ({UNREPAIRED_SQL}))""")
def severity_rollup_unrepaired(spark, sf_dir):
    return H.severity_status(unrepaired_results(spark, sf_dir))
