"""Cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepact import faults
from tablepact.catalogue.registry import query
from tablepact.contract import TableContract
from tablepact.contracts import ORDERS, TRANSACTIONS, USERS
from tablepact.functions import coerce as C
from tablepact.operators import compare, profile
from tablepact.operators.clean import (
    basic_column,
    clean,
    clean_by_sql,
    deduplicate,
    widen,
)

STRICT = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def to_int(c: str) -> str:
    return f"try_cast(trunc(try_cast({c} AS DOUBLE)) AS INTEGER)"


def bounded_int(c: str, default, low, high) -> str:
    return f"CAST(trunc(least(greatest(coalesce(try_cast({c} AS DOUBLE), {default}), {low}), {high})) AS INTEGER)"


def bounded_double(c: str, default, low, high) -> str:
    return (f"least(greatest(coalesce(try_cast({c} AS DOUBLE), CAST({default} AS DOUBLE)), "
            f"CAST({low} AS DOUBLE)), CAST({high} AS DOUBLE))")


def to_date(c: str) -> str:
    return f"coalesce(try_cast({c} AS DATE), DATE '1970-01-01')"


def filled(c: str, default: str) -> str:
    return f"coalesce(nullif({c}, ''), '{default}')"


def padded(c: str, n: int) -> str:
    return f"CASE WHEN length({c}) < {n} THEN rpad({c}, {n}, ' ') ELSE {c} END"


def json_or(c: str, default: str) -> str:
    return (f"CASE WHEN {c} IS NULL OR {c} = '' OR NOT json_valid({c}) THEN '{default}' "
            f"ELSE CAST(json({c}) AS VARCHAR) END")


CLEAN_ORDERS_SQL = f"""
SELECT {to_int('order_id')} AS order_id, {to_int('customer_id')} AS customer_id,
  {to_date('order_date')} AS order_date,
  {bounded_double('total_amount', 0, 0, 100000)} AS total_amount,
  substring({padded(filled('shipping_address', 'unknown'), 5)}, 1, 255) AS shipping_address,
  {bounded_int('item_count', 1, 1, 100)} AS item_count
FROM {faults.sql('dirty_orders')}"""

CLEAN_USERS_SQL = f"""
SELECT {to_int('id')} AS id, substring({filled('name', 'Unknown')}, 1, 255) AS name,
  CASE WHEN regexp_matches(email, '{STRICT}') THEN email ELSE 'unknown@example.com' END AS email,
  {bounded_int('age', 0, 0, 150)} AS age, {to_date('join_date')} AS join_date,
  CASE WHEN status IN ('active', 'inactive', 'pending', 'suspended') THEN status ELSE 'inactive' END AS status,
  {bounded_double('score', 0, 0, 100)} AS score,
  {json_or('metadata', '{}')} AS metadata
FROM {faults.sql('dirty_users')}"""

CLEAN_TRANSACTIONS_SQL = f"""
SELECT {to_int('transaction_id')} AS transaction_id, {to_int('customer_id')} AS customer_id,
  {bounded_double('amount', 0, 0, 10000)} AS amount, {to_date('date')} AS date,
  substring({filled('category', 'unknown')}, 1, 50) AS category,
  CASE WHEN status IN ('completed', 'pending', 'cancelled', 'refunded') THEN status ELSE 'pending' END AS status
FROM {faults.sql('dirty_transactions')}"""


@query("clean_orders", "K2 K3 K5 K6 K9 K10 K11 K14 K18 X2", CLEAN_ORDERS_SQL)
def clean_orders(spark, sf_dir):
    return clean(faults.table(spark, sf_dir, "dirty_orders"), ORDERS)


@query("clean_users", "K1 K2 K3 K5 K7 K8 K11 K13 K18", CLEAN_USERS_SQL)
def clean_users(spark, sf_dir):
    return clean(faults.table(spark, sf_dir, "dirty_users"), USERS)


@query("clean_transactions", "K2 K5 K8 K9 K11 K18", CLEAN_TRANSACTIONS_SQL)
def clean_transactions(spark, sf_dir):
    return clean(faults.table(spark, sf_dir, "dirty_transactions"), TRANSACTIONS)


@query("clean_json_props", "K7 X3", f"""
SELECT event_id, {json_or('metadata', '{"source": "none"}')} AS metadata
FROM {faults.sql('dirty_props')}""")
def clean_json_props(spark, sf_dir):
    contract = TableContract.from_dict("props", {"columns": [
        {"name": "event_id", "type": "bigint"},
        {"name": "metadata", "type": "json", "default": {"source": "none"}}]})
    return clean(faults.table(spark, sf_dir, "dirty_props"), contract)


@query("clean_users_basic", "K19 K2 K15", f"""
SELECT {to_int('id')} AS id, {filled('name', 'Unknown')} AS name,
  {filled('email', 'unknown@example.com')} AS email,
  coalesce({to_int('age')}, 0) AS age, {to_date('join_date')} AS join_date, status,
  coalesce(try_cast(score AS DOUBLE), CAST(0 AS DOUBLE)) AS score, nullif(metadata, '') AS metadata
FROM {faults.sql('dirty_users')}""")
def clean_users_basic(spark, sf_dir):
    return clean(faults.table(spark, sf_dir, "dirty_users"), USERS, rules="basic")


@query("clean_orders_compared", "K14 K15 C6 P6", f"""
SELECT {to_int('order_id')} AS order_id, {to_int('customer_id')} AS customer_id,
  {to_date('order_date')} AS order_date,
  coalesce(try_cast(total_amount AS DOUBLE), CAST(0 AS DOUBLE)) AS total_amount,
  {filled('shipping_address', 'unknown')} AS shipping_address,
  coalesce({to_int('item_count')}, 1) AS item_count
FROM {faults.sql('dirty_orders')}""")
def clean_orders_compared(spark, sf_dir):
    """Fills decided by a comparison of the whole table with an unconstrained contract."""
    raw = faults.table(spark, sf_dir, "dirty_orders")
    contract = TableContract.from_dict("orders", {"columns": [
        {"name": "order_id", "type": "integer"}, {"name": "customer_id", "type": "integer"},
        {"name": "order_date", "type": "date", "default": "1970-01-01"},
        {"name": "total_amount", "type": "float", "default": 0.0},
        {"name": "shipping_address", "type": "string", "default": "unknown"},
        {"name": "item_count", "type": "integer", "default": 1}]})
    found = compare.issues_by_column(
        compare.compare_profile(profile.infer_schema(raw, sample_size=None), contract))
    return clean(raw, contract, issues=found)


@query("clean_orders_sql", "K20 K16 K17", f"""
SELECT order_id, customer_id, coalesce(try_cast(order_date AS DATE), DATE '1970-01-01') AS order_date,
  coalesce(try_cast(total_amount AS DOUBLE), CAST(0 AS DOUBLE)) AS total_amount, shipping_address,
  coalesce({to_int('item_count')}, 1) AS item_count, 'none' AS note
FROM {faults.sql('dirty_orders')}""")
def clean_orders_sql(spark, sf_dir):
    """The SQL form with a missing column (literal) and an extra one (dropped)."""
    raw = faults.table(spark, sf_dir, "dirty_orders").withColumn("extra", F.col("order_id"))
    contract = TableContract.from_dict("orders", {"columns": [
        {"name": "order_id", "type": "string"}, {"name": "customer_id", "type": "string"},
        {"name": "order_date", "type": "date", "default": "1970-01-01"},
        {"name": "total_amount", "type": "float", "default": 0.0},
        {"name": "shipping_address", "type": "string", "default": "unknown"},
        {"name": "item_count", "type": "integer", "default": 1},
        {"name": "note", "type": "string", "default": "none"}]})
    issues = {c: ["type_mismatch"] for c in ("order_date", "total_amount", "item_count")}
    return clean_by_sql(raw, contract, issues)


@query("clean_missing_and_extra", "K16 K17", f"""
SELECT {to_int('id')} AS id, DATE '2000-01-01' AS since, 7 AS level, name, status
FROM (SELECT id, nullif(name, '') AS name, status FROM {faults.sql('dirty_users')})""")
def clean_missing_and_extra(spark, sf_dir):
    raw = faults.table(spark, sf_dir, "dirty_users").select(
        "id", F.nullif("name", F.lit("")).alias("name"), "status")
    contract = TableContract.from_dict("t", {"columns": [
        {"name": "id", "type": "integer"}, {"name": "since", "type": "date", "default": "2000-01-01"},
        {"name": "level", "type": "integer", "default": 7}]})
    return clean(raw, contract, extra="keep")


@query("clean_nullable_numbers", "K4 K5 K15", f"""
SELECT {to_int('id')} AS id, {to_int('age')} AS age, try_cast(score AS DOUBLE) AS score
FROM {faults.sql('dirty_users')}""")
def clean_nullable_numbers(spark, sf_dir):
    """Bounds without a default: nulls stay and nothing is clipped."""
    contract = TableContract.from_dict("t", {"columns": [
        {"name": "id", "type": "integer", "nullable": False},
        {"name": "age", "type": "integer", "nullable": True, "constraints": {"min": 0, "max": 40}},
        {"name": "score", "type": "float", "nullable": True, "constraints": {"min": 0, "max": 1}}]})
    return clean(faults.table(spark, sf_dir, "dirty_users"), contract, extra="drop")


@query("clean_by_pattern", "K12 K17", f"""
SELECT {to_int('order_id')} AS order_id,
  CASE WHEN regexp_matches(shipping_address, '^(?:[0-9]-[A-Z]+)') THEN shipping_address ELSE 'n/a' END
    AS shipping_address
FROM {faults.sql('dirty_orders')}""")
def clean_by_pattern(spark, sf_dir):
    contract = TableContract.from_dict("t", {"columns": [
        {"name": "order_id", "type": "integer"},
        {"name": "shipping_address", "type": "string", "pattern": "[0-9]-[A-Z]+", "default": "n/a"}]})
    return clean(faults.table(spark, sf_dir, "dirty_orders"), contract, extra="drop")


@query("clean_document_lengths", "K9 K10 K11", """
SELECT doc_id, substring(CASE WHEN length(text) < 400 THEN rpad(text, 400, ' ') ELSE text END, 1, 2000) AS text,
  CASE WHEN source IS NULL THEN 'unknown' WHEN length(source) < 8 THEN rpad(source, 8, ' ') ELSE source END AS source
FROM documents""")
def clean_document_lengths(spark, sf_dir):
    """Length rules on whole long texts."""
    contract = TableContract.from_dict("documents", {"columns": [
        {"name": "doc_id", "type": "bigint"},
        {"name": "text", "type": "string", "constraints": {"min_length": 400, "max_length": 2000}},
        {"name": "source", "type": "string", "default": "unknown", "constraints": {"min_length": 8}}]})
    documents = faults.table(spark, sf_dir, "documents")
    return clean(documents, contract, extra="drop", na_tokens=False)


@query("clean_lineitem", "K3 K5 K6 K8 K18", """
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey,
  CAST(trunc(least(greatest(coalesce(l_quantity, 1), 5), 45)) AS INTEGER) AS l_quantity,
  least(greatest(l_extendedprice, CAST(1000 AS DOUBLE)), CAST(90000 AS DOUBLE)) AS l_extendedprice,
  least(l_discount, CAST(0.05 AS DOUBLE)) AS l_discount,
  CASE WHEN l_returnflag IN ('A', 'R') THEN l_returnflag ELSE 'A' END AS l_returnflag,
  CASE WHEN l_linestatus IN ('O') THEN l_linestatus ELSE 'O' END AS l_linestatus,
  CAST(l_shipdate AS DATE) AS l_shipdate
FROM lineitem""")
def clean_lineitem(spark, sf_dir):
    """A typed table: no value goes through text."""
    return clean(faults.table(spark, sf_dir, "lineitem"), LINEITEM, extra="drop")


LINEITEM = TableContract.from_dict("lineitem", {"columns": [
    {"name": "l_orderkey", "type": "bigint", "nullable": False},
    {"name": "l_quantity", "type": "integer", "nullable": False, "default": 1,
     "constraints": {"min": 5, "max": 45}},
    {"name": "l_extendedprice", "type": "float", "nullable": False, "default": 0.0,
     "constraints": {"min": 1000.0, "max": 90000.0}},
    {"name": "l_discount", "type": "float", "nullable": False, "default": 0.0,
     "constraints": {"max": 0.05}},
    {"name": "l_returnflag", "type": "string", "nullable": False, "enum": ["A", "R"]},
    {"name": "l_linestatus", "type": "string", "nullable": False, "enum": ["O"], "default": "O"},
    {"name": "l_shipdate", "type": "date", "nullable": False, "default": "1970-01-01"}]})


@query("na_tokens", "K1", f"""
SELECT id, CASE WHEN age NOT IN ('', 'N/A', 'NA', 'null', 'None', 'n/a', '#N/A', 'NaN') THEN age END AS age,
  nullif(metadata, '') AS metadata
FROM {faults.sql('dirty_users')}""")
def na_tokens(spark, sf_dir):
    users = faults.table(spark, sf_dir, "dirty_users")
    return users.select("id", C.na_to_null(F.col("age")).alias("age"),
                        C.na_to_null(F.col("metadata")).alias("metadata"))


@query("clamp_values", "K6", """
SELECT l_orderkey, l_linenumber, least(greatest(l_extendedprice, 2000.0::DOUBLE), 50000.0::DOUBLE) AS price,
  least(greatest(CAST(l_quantity AS INTEGER), 10), 40) AS quantity FROM lineitem""")
def clamp_values(spark, sf_dir):
    lines = faults.table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber",
                        C.clamp(F.col("l_extendedprice"), 2000.0, 50000.0).alias("price"),
                        C.clamp(F.col("l_quantity").cast("int"), 10, 40).alias("quantity"))


@query("enum_enforce", "K8", f"""
SELECT id, CASE WHEN status IN ('pending', 'active') THEN status ELSE 'pending' END AS first_value,
  CASE WHEN status IN ('pending', 'active') THEN status ELSE 'none' END AS default_value,
  CASE WHEN email_or_null IN ('user1@example.com') THEN email_or_null ELSE 'none' END AS nulls_too
FROM (SELECT *, nullif(email, '') AS email_or_null FROM {faults.sql('dirty_users')})""")
def enum_enforce(spark, sf_dir):
    users = faults.table(spark, sf_dir, "dirty_users")
    email = F.nullif(F.col("email"), F.lit(""))
    return users.select(
        "id", C.enforce_enum(F.col("status"), ["pending", "active"]).alias("first_value"),
        C.enforce_enum(F.col("status"), ["pending", "active"], "none").alias("default_value"),
        C.enforce_enum(email, ["user1@example.com"], "none").alias("nulls_too"))


@query("email_strict_enforce", "K13", f"""
SELECT id, CASE WHEN regexp_matches(email, '{STRICT}') THEN email ELSE 'fallback@example.org' END AS email
FROM {faults.sql('dirty_users')}""")
def email_strict_enforce(spark, sf_dir):
    users = faults.table(spark, sf_dir, "dirty_users")
    return users.select("id", C.enforce_email(F.col("email"), "fallback@example.org").alias("email"))


@query("email_like_repair", "K21", f"""
SELECT id, CASE WHEN email IS NULL OR email = '' THEN 'unknown@example.com'
  WHEN email NOT LIKE '%@%.%' THEN 'unknown@example.com' ELSE email END AS email
FROM {faults.sql('dirty_users')}""")
def email_like_repair(spark, sf_dir):
    users = faults.table(spark, sf_dir, "dirty_users")
    return users.select("id", C.repair_email_like(F.col("email"), "unknown@example.com").alias("email"))


@query("email_domain_repair", "K22", f"""
SELECT id, CASE WHEN email = '' OR NOT contains(trim(email), '@') THEN 'unknown@example.com'
  WHEN regexp_matches(email, '{STRICT}') THEN email
  WHEN regexp_matches(completed, '{STRICT}') THEN completed ELSE 'unknown@example.com' END AS email
FROM (SELECT *, CASE WHEN contains(split_part(trim(email), '@', -1), '.') THEN trim(email)
        ELSE concat(trim(email), '.com') END AS completed FROM {faults.sql('dirty_users')})""")
def email_domain_repair(spark, sf_dir):
    users = faults.table(spark, sf_dir, "dirty_users")
    return users.select("id", C.repair_email_domain(F.col("email"), "unknown@example.com").alias("email"))


@query("boolean_cast", "K23", """
SELECT c_custkey, coalesce(CAST(c_nationkey % 3 AS VARCHAR) IN ('true', '1', 'yes'), false) AS flag,
  coalesce(CASE WHEN c_acctbal < 0 THEN 'yes' WHEN c_acctbal < 5000 THEN 'no' END IN ('true', '1', 'yes'), false) AS in_debt
FROM customer""")
def boolean_cast(spark, sf_dir):
    customers = faults.table(spark, sf_dir, "customer")
    word = F.when(F.col("c_acctbal") < 0, "yes").when(F.col("c_acctbal") < 5000, "no")
    return customers.select("c_custkey", C.to_boolean(F.col("c_nationkey") % 3).alias("flag"),
                            C.to_boolean(word).alias("in_debt"))


@query("widening_casts", "K24", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_name FROM part""")
def widening_casts(spark, sf_dir):
    parts = faults.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    return widen(parts, to_text=["p_partkey"], to_float=["p_size"])


@query("deduplicate_lineitem", "K25", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1""")
def deduplicate_lineitem(spark, sf_dir):
    lines = faults.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return deduplicate(lines, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


@query("coerce_columns", "K2 K3 K4 K5 K15", f"""
SELECT order_id, {to_int('total_amount')} AS amount_int, try_cast(total_amount AS DOUBLE) AS amount_double,
  try_cast(order_date AS DATE) AS order_date, {to_int('item_count')} AS item_count
FROM {faults.sql('dirty_orders')}""")
def coerce_columns(spark, sf_dir):
    orders = faults.table(spark, sf_dir, "dirty_orders")
    rules = {"amount_int": ("total_amount", "integer"), "amount_double": ("total_amount", "float"),
             "order_date": ("order_date", "date"), "item_count": ("item_count", "integer")}
    contract = TableContract.from_dict("t", {"columns": [
        {"name": name, "type": kind} for name, (_, kind) in rules.items()]})
    return orders.select("order_id", *[
        basic_column(F.col(source), contract.column(name)).alias(name)
        for name, (source, _) in rules.items()])
