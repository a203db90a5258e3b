"""Profiling and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepact import faults
from tablepact.catalogue.registry import query
from tablepact.contract import TableContract
from tablepact.contracts import ORDERS, TRANSACTIONS, USERS
from tablepact.functions import predicates as P
from tablepact.functions.text import human_size
from tablepact.operators import compare, profile

ORDER_COLUMNS = ("order_id", "customer_id", "order_date", "total_amount", "shipping_address", "item_count")
USER_COLUMNS = ("id", "name", "email", "age", "join_date", "status", "score", "metadata")
TRANSACTION_COLUMNS = ("transaction_id", "customer_id", "amount", "date", "category", "status")

INT_RE = r"^-*[0-9]+$"
FLOAT_RE = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def type_sql(c: str) -> str:
    """Type inference over all rows; dates are ISO or plainly invalid here."""
    return (f"CASE WHEN count({c}) = 0 THEN 'unknown' "
            f"WHEN coalesce(bool_and(regexp_matches({c}, '{INT_RE}')) FILTER (WHERE {c} <> ''), true) THEN 'integer' "
            f"WHEN coalesce(bool_and(regexp_matches({c}, '{FLOAT_RE}')) FILTER (WHERE {c} <> ''), true) THEN 'float' "
            f"WHEN coalesce(bool_and(try_cast({c} AS TIMESTAMP) IS NOT NULL) FILTER (WHERE {c} <> ''), true) THEN 'date' "
            f"WHEN coalesce(bool_and((({c} LIKE '{{%' AND {c} LIKE '%}}') OR ({c} LIKE '[%' AND {c} LIKE '%]')) "
            f"AND json_valid({c})) FILTER (WHERE {c} <> ''), true) THEN 'json' ELSE 'string' END")


def profile_sql(source: str, columns, types_from: str | None = None) -> str:
    """Profile rows in SQL; types may come from another (sampled) source."""
    head = types_from or source
    parts = [
        f"SELECT {i} AS position, '{c}' AS \"column\", (SELECT {type_sql(c)} FROM h) AS type, "
        f"count(*) AS row_count, count(*) FILTER (WHERE {c} IS NULL OR {c} = '') AS null_count FROM t"
        for i, c in enumerate(columns)]
    return (f"WITH t AS (SELECT * FROM {source}), h AS (SELECT * FROM {head}), p AS ("
            + " UNION ALL ".join(parts)
            + ") SELECT position, \"column\", type, row_count, null_count, "
              "null_count / row_count AS null_percentage, null_count > 0 AS nullable FROM p")


PROFILE_COLUMNS = ("position", "column", "type", "row_count", "null_count", "null_percentage", "nullable")


@query("infer_schema_orders", "P1 P2 P3 P4 P6", profile_sql(faults.sql("dirty_orders"), ORDER_COLUMNS))
def infer_schema_orders(spark, sf_dir):
    raw = faults.table(spark, sf_dir, "dirty_orders")
    return profile.infer_schema(raw, sample_size=None).select(*PROFILE_COLUMNS)


@query("infer_schema_users", "P1 P5 P6", profile_sql(faults.sql("dirty_users"), USER_COLUMNS))
def infer_schema_users(spark, sf_dir):
    raw = faults.table(spark, sf_dir, "dirty_users")
    return profile.infer_schema(raw, sample_size=None).select(*PROFILE_COLUMNS)


EVENT_TEXT = ("(SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, "
              "event_type, CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR) AS value, props FROM events)")
EVENT_COLUMNS = ("event_id", "day", "event_type", "value", "props")


def _event_text(spark, sf_dir):
    return faults.table(spark, sf_dir, "events").selectExpr(
        "cast(event_id as string) event_id", "cast(cast(ts as date) as string) day", "event_type",
        "cast(cast(value as decimal(12,2)) as string) value", "props")


@query("infer_schema_events", "P1 P2 P3 P4 P5 P6", profile_sql(EVENT_TEXT, EVENT_COLUMNS))
def infer_schema_events(spark, sf_dir):
    return profile.infer_schema(_event_text(spark, sf_dir), sample_size=None).select(*PROFILE_COLUMNS)


@query("infer_types_events", "P1", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", {type_sql(c)} AS type FROM {EVENT_TEXT}"
    for i, c in enumerate(EVENT_COLUMNS)))
def infer_types_events(spark, sf_dir):
    return profile.infer_types(_event_text(spark, sf_dir))


_FIRST_USERS = f"(SELECT * FROM {faults.sql('dirty_users')} ORDER BY CAST(id AS BIGINT) LIMIT 100)"


@query("infer_schema_sampled", "P1 P6", profile_sql(
    faults.sql("dirty_users"), USER_COLUMNS, _FIRST_USERS).replace(
    "AS nullable FROM p", "AS nullable, sample_values FROM p JOIN (" + " UNION ALL ".join(
        f"SELECT '{c}' AS c, (SELECT string_agg({c}, '|' ORDER BY CAST(id AS BIGINT)) FROM "
        f"(SELECT id, {c} FROM h ORDER BY CAST(id AS BIGINT) LIMIT 5)) AS sample_values"
        for c in USER_COLUMNS) + ") s ON s.c = p.\"column\""))
def infer_schema_sampled(spark, sf_dir):
    """Types and samples from the first 100 rows, null counts from all of them."""
    raw = faults.table(spark, sf_dir, "dirty_users")
    found = profile.infer_schema(raw, sample_size=100, order_by=[F.col("id").cast("bigint")])
    return found.withColumn("sample_values", F.concat_ws("|", "sample_values"))


@query("text_predicates", "P2 P3 P4 P5", f"""
SELECT order_id, regexp_matches(total_amount, '{INT_RE}') AS amount_is_integer,
  regexp_matches(total_amount, '{FLOAT_RE}') AS amount_is_float,
  try_cast(order_date AS DATE) IS NOT NULL AS date_is_date,
  regexp_matches(item_count, '{INT_RE}') AS count_is_integer,
  coalesce(shipping_address = '', true) AS address_is_blank
FROM {faults.sql('dirty_orders')}""")
def text_predicates(spark, sf_dir):
    orders = faults.table(spark, sf_dir, "dirty_orders")
    return orders.select(
        "order_id", P.is_integer_text(F.col("total_amount")).alias("amount_is_integer"),
        P.is_float_text(F.col("total_amount")).alias("amount_is_float"),
        P.is_date_text(F.col("order_date")).alias("date_is_date"),
        P.is_integer_text(F.col("item_count")).alias("count_is_integer"),
        P.is_blank(F.col("shipping_address")).alias("address_is_blank"))


@query("json_predicates", "P5", f"""
SELECT event_id, metadata <> '' AND json_valid(metadata) AND metadata LIKE '{{%}}' AS is_json
FROM {faults.sql('dirty_props')}""")
def json_predicates(spark, sf_dir):
    props = faults.table(spark, sf_dir, "dirty_props")
    return props.select("event_id", P.is_json_text(F.col("metadata")).alias("is_json"))


def quality_sql(table: str, columns: dict[str, str]) -> str:
    parts = [
        f"SELECT {i} AS position, '{c}' AS \"column\", '{t}' AS type, count(*) AS total, "
        f"count(DISTINCT {c}) AS distinct_count, count(*) - count({c}) AS null_count, "
        f"CAST(min({c}) AS VARCHAR) AS min_value, CAST(max({c}) AS VARCHAR) AS max_value, "
        f"CASE WHEN count(*) > 0 THEN round((count(*) - count({c})) / count(*) * 100, 2) ELSE 0 END "
        f"AS null_percentage FROM {table}"
        for i, (c, t) in enumerate(columns.items())]
    return " UNION ALL ".join(parts)


LINEITEM_TYPES = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}


@query("quality_report_lineitem", "P7", quality_sql("lineitem", LINEITEM_TYPES))
def quality_report_lineitem(spark, sf_dir):
    return profile.quality_report(faults.table(spark, sf_dir, "lineitem"))


DOCUMENT_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


@query("quality_report_documents", "P7", quality_sql("documents", DOCUMENT_TYPES))
def quality_report_documents(spark, sf_dir):
    return profile.quality_report(faults.table(spark, sf_dir, "documents"))


@query("quality_report_by_digest", "P7", quality_sql("documents", DOCUMENT_TYPES))
def quality_report_by_digest(spark, sf_dir):
    """The same report without shuffling the texts."""
    return profile.quality_report(faults.table(spark, sf_dir, "documents"), distinct="digest")


_STAGED = "(SELECT " + ", ".join(f"nullif({c}, '') AS {c}" for c in ORDER_COLUMNS) + \
    f" FROM {faults.sql('dirty_orders')})"


def _staged(spark, sf_dir):
    raw = faults.table(spark, sf_dir, "dirty_orders")
    return raw.select(*[F.nullif(c, F.lit("")).alias(c) for c in raw.columns])


@query("quality_report_staged", "P7", quality_sql(_STAGED, dict.fromkeys(ORDER_COLUMNS, "string")))
def quality_report_staged(spark, sf_dir):
    return profile.quality_report(_staged(spark, sf_dir))


@query("quality_report_approximate", "P7", "SELECT * EXCLUDE (distinct_count), true AS distinct_is_close FROM ("
       + quality_sql("lineitem", LINEITEM_TYPES) + ")")
def quality_report_approximate(spark, sf_dir):
    """One pass; approximate distinct counts lie within 15 percent of the exact ones."""
    lines = faults.table(spark, sf_dir, "lineitem")
    exact = profile.quality_report(lines).select("column", F.col("distinct_count").alias("exact"))
    found = profile.quality_report(lines, distinct="approx").join(exact, "column")
    return found.withColumn(
        "distinct_is_close", F.abs(F.col("distinct_count") / F.col("exact") - 1) <= 0.15).drop("distinct_count", "exact")


@query("quality_issues_staged", "P8", "WITH r AS (" + quality_sql(
    _STAGED, dict.fromkeys(ORDER_COLUMNS, "string")) + """)
SELECT 'null_values' AS type, "column", null_count AS count,
  CASE WHEN null_count / total > 0.5 THEN 'high' ELSE 'medium' END AS severity
FROM r WHERE null_count > 0""")
def quality_issues_staged(spark, sf_dir):
    return profile.quality_issues(profile.quality_report(_staged(spark, sf_dir)))


@query("staging_counters_orders", "P9 P11 P13", f"""
SELECT count(*) FILTER (WHERE shipping_address IS NULL OR shipping_address = '') AS blank_shipping_address,
  count(*) FILTER (WHERE item_count IS NULL OR item_count = '') AS blank_item_count,
  count(*) FILTER (WHERE total_amount LIKE '-%' OR coalesce(try_cast(total_amount AS DOUBLE) < 0, false))
    AS negative_total_amount,
  count(*) FILTER (WHERE order_date NOT LIKE '%-%-%') AS undashed_order_date
FROM {faults.sql('dirty_orders')}""")
def staging_counters_orders(spark, sf_dir):
    return profile.order_counters(faults.table(spark, sf_dir, "dirty_orders"),
                                  ["shipping_address", "item_count"], "total_amount", "order_date")


@query("staging_counters_transactions", "P9 P11 P12 P13 P14", f"""
SELECT count(*) FILTER (WHERE category IS NULL OR category = '') AS blank_category,
  count(*) FILTER (WHERE amount = 'INVALID') AS invalid_amount,
  count(*) FILTER (WHERE amount LIKE '-%' OR coalesce(try_cast(amount AS DOUBLE) < 0, false)) AS negative_amount,
  count(*) FILTER (WHERE date NOT LIKE '%-%-%') AS undashed_date,
  count(*) FILTER (WHERE status NOT IN ('completed', 'pending', 'cancelled', 'refunded')) AS bad_status
FROM {faults.sql('dirty_transactions')}""")
def staging_counters_transactions(spark, sf_dir):
    raw = faults.table(spark, sf_dir, "dirty_transactions")
    amount, status = F.col("amount"), F.col("status")
    return profile.count_matching(raw, {
        "blank_category": P.is_blank(F.col("category")),
        "invalid_amount": amount == P.INVALID_LITERAL,
        "negative_amount": P.is_negative_text(amount),
        "undashed_date": P.is_not_dashed_date(F.col("date")),
        "bad_status": ~P.in_values(status, TRANSACTIONS.column("status").enum)})


@query("staging_counters_users", "P9 P10", f"""
SELECT count(*) FILTER (WHERE email IS NULL OR email = '') AS blank_email,
  count(*) FILTER (WHERE age NOT LIKE '%[0-9]%') AS non_numeric_age_like,
  count(*) FILTER (WHERE NOT regexp_matches(age, '[0-9]')) AS non_numeric_age
FROM {faults.sql('dirty_users')}""")
def staging_counters_users(spark, sf_dir):
    raw = faults.table(spark, sf_dir, "dirty_users")
    age = F.col("age")
    return profile.count_matching(raw, {
        "blank_email": P.is_blank(F.col("email")),
        "non_numeric_age_like": P.lacks_digit(age, literal_brackets=True),
        "non_numeric_age": P.lacks_digit(age)})


@query("conditional_sums_users", "P15", "SELECT count(*) AS total_rows, " + ", ".join(
    f"CAST(sum(CASE WHEN {c} IS NULL OR {c} = '' THEN 1 ELSE 0 END) AS BIGINT) AS null_{c}"
    for c in USER_COLUMNS) + f" FROM {faults.sql('dirty_users')}")
def conditional_sums_users(spark, sf_dir):
    return profile.blank_counts(faults.table(spark, sf_dir, "dirty_users"), USER_COLUMNS)


@query("bad_value_histogram", "P16", f"""
SELECT age AS value, 'string' AS value_type, count(*) AS value_count
FROM {faults.sql('dirty_users')} WHERE age NOT LIKE '%[0-9]%' GROUP BY age ORDER BY value_count DESC, value""")
def bad_value_histogram(spark, sf_dir):
    raw = faults.table(spark, sf_dir, "dirty_users")
    return profile.value_histogram(raw, "age", P.lacks_digit(F.col("age"), literal_brackets=True))


@query("order_priority_histogram", "P16", """
SELECT o_orderpriority AS value, 'string' AS value_type, count(*) AS value_count
FROM orders GROUP BY o_orderpriority ORDER BY value_count DESC, value""")
def order_priority_histogram(spark, sf_dir):
    return profile.value_histogram(faults.table(spark, sf_dir, "orders"), "o_orderpriority")


@query("numeric_profile_lineitem", "P17", """
SELECT l_returnflag, min(l_extendedprice) AS min_l_extendedprice, max(l_extendedprice) AS max_l_extendedprice,
  round(avg(l_extendedprice), 4) AS avg_l_extendedprice FROM lineitem GROUP BY l_returnflag""")
def numeric_profile_lineitem(spark, sf_dir):
    found = profile.numeric_profile(faults.table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return found.withColumn("avg_l_extendedprice", F.round("avg_l_extendedprice", 4))


@query("human_sizes", "X1", """
SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024)
  WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size_human
FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) * n_chars AS n FROM documents)""")
def human_sizes(spark, sf_dir):
    documents = faults.table(spark, sf_dir, "documents")
    return documents.select("doc_id", human_size(F.col("n_chars") * F.col("n_chars")).alias("size_human"))


# --- comparison -------------------------------------------------------------

def _contract_rows(contract: TableContract) -> str:
    return ", ".join(
        f"({i}, '{c.name}', '{c.type}', {str(c.nullable_in_comparison).lower()})"
        for i, c in enumerate(contract.columns))


def compare_sql(source: str, columns, contract: TableContract) -> str:
    """Comparison as a full outer join of profile and contract."""
    return (f"WITH prof AS ({profile_sql(source, columns)}), "
            f"con(cpos, cname, ctype, cnull) AS (VALUES {_contract_rows(contract)}), "
            "j AS (SELECT *, coalesce(cname, \"column\") AS name FROM prof FULL JOIN con ON \"column\" = cname)")


COMPARE_TAIL = """ SELECT name AS "column", CASE WHEN "column" IS NULL THEN 'missing' WHEN cname IS NULL THEN 'extra'
  WHEN type <> ctype OR (null_count > 0 AND NOT cnull) THEN 'mismatch' ELSE 'match' END AS status,
  type AS source_type, ctype AS expected_type FROM j"""

ISSUES_TAIL = """ SELECT name AS "column", 'type_mismatch' AS type, ctype AS expected, type AS actual, 'high' AS severity,
    CAST(NULL AS BIGINT) AS count, CAST(NULL AS DOUBLE) AS percentage FROM j WHERE type <> ctype
  UNION ALL SELECT name, 'nullability_mismatch', 'NOT NULL', 'NULL allowed', 'high', null_count, NULL
    FROM j WHERE nullable AND NOT cnull
  UNION ALL SELECT name, 'null_values_found', NULL, NULL, 'high', null_count, null_percentage
    FROM j WHERE null_count > 0 AND NOT cnull"""


def _compared(spark, sf_dir, name, contract, merged=False):
    raw = faults.table(spark, sf_dir, name)
    return compare.compare_schema(raw, contract, sample_size=None, merged=merged)


# A contract that names a column the source lacks and omits one it has.
SHIFTED = TableContract("users", USERS.columns[:-1] + (USERS.columns[0].__class__(
    name="signup_channel", type="string", default="web"),))


@query("compare_orders", "C1 C2 C3 C4 C6", compare_sql(faults.sql("dirty_orders"), ORDER_COLUMNS, ORDERS) + COMPARE_TAIL)
def compare_orders(spark, sf_dir):
    return _compared(spark, sf_dir, "dirty_orders", ORDERS).select("column", "status", "source_type", "expected_type")


@query("compare_users_shifted", "C4 C5 C6", compare_sql(faults.sql("dirty_users"), USER_COLUMNS, SHIFTED) + COMPARE_TAIL)
def compare_users_shifted(spark, sf_dir):
    return _compared(spark, sf_dir, "dirty_users", SHIFTED).select("column", "status", "source_type", "expected_type")


@query("compare_issues_users", "C1 C2 C3", compare_sql(faults.sql("dirty_users"), USER_COLUMNS, USERS) + ISSUES_TAIL)
def compare_issues_users(spark, sf_dir):
    return compare.explode_issues(_compared(spark, sf_dir, "dirty_users", USERS))


@query("compare_issues_transactions", "C1 C2 C3",
       compare_sql(faults.sql("dirty_transactions"), TRANSACTION_COLUMNS, TRANSACTIONS) + ISSUES_TAIL)
def compare_issues_transactions(spark, sf_dir):
    return compare.explode_issues(_compared(spark, sf_dir, "dirty_transactions", TRANSACTIONS))


def _recommend_tail(fill_kind: str) -> str:
    return f""", d(name, dflt) AS (VALUES ('order_date', '"1970-01-01"'), ('total_amount', '0.0'),
    ('shipping_address', '"unknown"'), ('item_count', '1'))
  SELECT j.name AS "column", 'cast' AS action, type AS "from", ctype AS "to", dflt AS "default",
    CAST(NULL AS BIGINT) AS count, concat('COALESCE(CAST(', j.name, ' AS ', upper(ctype), '), ', coalesce(dflt, 'NULL'), ')') AS code
    FROM j LEFT JOIN d ON d.name = j.name WHERE type <> ctype
  UNION ALL SELECT j.name, 'coalesce', NULL, NULL, dflt, null_count, concat('COALESCE(', j.name, ', ', dflt, ')')
    FROM j JOIN d ON d.name = j.name WHERE nullable AND NOT cnull
  UNION ALL SELECT j.name, '{fill_kind}', NULL, NULL, dflt, null_count, concat('COALESCE(', j.name, ', ', dflt, ')')
    FROM j JOIN d ON d.name = j.name WHERE null_count > 0 AND NOT cnull"""


@query("recommendations_orders", "C7",
       compare_sql(faults.sql("dirty_orders"), ORDER_COLUMNS, ORDERS) + _recommend_tail("fill_nulls"))
def recommendations_orders(spark, sf_dir):
    return compare.explode_recommendations(_compared(spark, sf_dir, "dirty_orders", ORDERS))


@query("recommendations_merged", "C7",
       compare_sql(faults.sql("dirty_orders"), ORDER_COLUMNS, ORDERS) + _recommend_tail("coalesce"))
def recommendations_merged(spark, sf_dir):
    return compare.explode_recommendations(_compared(spark, sf_dir, "dirty_orders", ORDERS, merged=True))


@query("missing_and_extra_columns", "C5",
       compare_sql(faults.sql("dirty_users"), USER_COLUMNS, SHIFTED)
       + " SELECT name AS \"column\", 'missing' AS side FROM j WHERE \"column\" IS NULL"
         " UNION ALL SELECT name, 'extra' FROM j WHERE cname IS NULL")
def missing_and_extra_columns(spark, sf_dir):
    found = profile.infer_types(faults.table(spark, sf_dir, "dirty_users"))
    return compare.missing_columns(found, SHIFTED).withColumn("side", F.lit("missing")).unionByName(
        compare.extra_columns(found, SHIFTED).withColumn("side", F.lit("extra")))
