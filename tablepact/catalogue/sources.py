"""Source, sink, catalog and load queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepact import faults
from tablepact.catalogue.cleaning import CLEAN_ORDERS_SQL, to_int
from tablepact.catalogue.checking import ORDER_CHECKS, results_sql
from tablepact.catalogue.registry import query, scratch
from tablepact.contract import TableContract
from tablepact.contracts import ORDERS, USERS
from tablepact.operators import checks as K
from tablepact.operators.clean import clean
from tablepact.sources import catalog, files, sinks, strict

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")
ORDERS_SRC = faults.sql("dirty_orders")
USERS_SRC = faults.sql("dirty_users")


def as_csv(spark, sf_dir, name):
    """A derived raw table written as delimited files, header in each."""
    path = scratch(spark, f"csv-{name}")
    (faults.table(spark, sf_dir, name).write.option("header", True).option("escape", '"')
     .option("emptyValue", "").csv(path))
    return path


@query("stage_csv_orders", "S1", "SELECT " + ", ".join(
    f"nullif({c}, '') AS {c}" for c in ORDERS.names) + f" FROM {ORDERS_SRC}")
def stage_csv_orders(spark, sf_dir):
    return files.stage_csv(spark, as_csv(spark, sf_dir, "dirty_orders"), ORDERS.names)


@query("staged_row_count", "S1", "SELECT count(*) AS rows_loaded FROM customer")
def staged_row_count(spark, sf_dir):
    staged = files.stage_csv(spark, as_csv(spark, sf_dir, "dirty_users"), USERS.names)
    return staged.agg(F.count(F.lit(1)).alias("rows_loaded"))


@query("read_typed_csv_users", "S2 K1", f"""
SELECT {to_int('id')} AS id, nullif(name, '') AS name, nullif(email, '') AS email, {to_int('age')} AS age,
  try_cast(join_date AS DATE) AS join_date, status, try_cast(score AS DOUBLE) AS score,
  nullif(metadata, '') AS metadata FROM {USERS_SRC}""")
def read_typed_csv_users(spark, sf_dir):
    return files.read_typed_csv(spark, as_csv(spark, sf_dir, "dirty_users"), USERS)


@query("read_rows_users", "S3", f"SELECT * FROM {USERS_SRC}")
def read_rows_users(spark, sf_dir):
    return files.read_rows(spark, as_csv(spark, sf_dir, "dirty_users"), USERS.names)


@query("numbered_rows", "R6 S3", f"""
SELECT count(*) AS total_rows, count(*) AS distinct_numbers, CAST(1 AS BIGINT) AS first_number, count(*) AS last_number
FROM {USERS_SRC}""")
def numbered_rows(spark, sf_dir):
    """Line numbers over many files: unique, gapless, from 1."""
    rows = files.read_rows(spark, as_csv(spark, sf_dir, "dirty_users"), USERS.names)
    return files.with_line_numbers(rows).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_distinct("row_number").alias("distinct_numbers"),
        F.min("row_number").alias("first_number"), F.max("row_number").alias("last_number"))


def table_paths(sf_dir):
    """Where each table lies: a file, or a folder of files where it is larger."""
    return {t: f"{sf_dir}/{t}.parquet" for t in TABLES}


def with_row_counts(spark, sf_dir, listed):
    """What the listing says of each table beside the rows read from it."""
    counted = catalog.count_tables({t: faults.table(spark, sf_dir, t) for t in TABLES})
    return listed.join(F.broadcast(counted), listed.name == counted.table)


@query("valid_source_files", "S4", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) > 0 AS is_valid FROM {t}" for t in TABLES))
def valid_source_files(spark, sf_dir):
    paths = table_paths(sf_dir)
    for path in paths.values():
        files.validate_sources(spark, path)
    return with_row_counts(spark, sf_dir, files.source_metadata(spark, paths)).select(
        "name", ((F.col("size_bytes") > 0) & (F.col("row_count") > 0)).alias("is_valid"))


@query("file_metadata", "S5 X1")
def file_metadata(spark, sf_dir):
    return files.file_metadata(spark, f"{sf_dir}/*.parquet")


@query("file_flags", "S5", " UNION ALL ".join(
    f"SELECT '{t}' AS name, true AS exists, true AS is_file, false AS is_directory, true AS has_readable_size" for t in TABLES))
def file_flags(spark, sf_dir):
    return files.source_metadata(spark, table_paths(sf_dir)).select(
        "name", "exists", "is_file", "is_directory",
        F.col("size_human").rlike(r"^[0-9]+\.[0-9] [KMGTP]?B$").alias("has_readable_size"))


@query("inspect_file", "S6", f"""
SELECT least(count(*), 10) AS rows, '{"|".join(USERS.names)}' AS columns FROM customer""")
def inspect_file(spark, sf_dir):
    """What an inspection says of a folder of files with the same columns."""
    described, _ = files.inspect_file(spark, as_csv(spark, sf_dir, "dirty_users"))
    return described.select(F.col("rows"), F.concat_ws("|", "columns").alias("columns")).distinct()


@query("log_tail", "S7", f"SELECT line FROM {faults.sql('log_lines')} ORDER BY event_id DESC LIMIT 100")
def log_tail(spark, sf_dir):
    return files.tail(faults.table(spark, sf_dir, "log_lines"), ["event_id"], 100).select("line")


@query("log_file_tail", "S7", f"SELECT line FROM {faults.sql('log_lines')} ORDER BY event_id DESC LIMIT 100")
def log_file_tail(spark, sf_dir):
    """The same through text files, whose names follow the order of the lines."""
    path = scratch(spark, "log")
    lines = faults.table(spark, sf_dir, "log_lines")
    lines.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("line").write.text(path)
    return files.read_log(spark, path, 100)


@query("table_status", "S8", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS row_count, 'ok' AS status FROM {t}" for t in TABLES))
def table_status(spark, sf_dir):
    return catalog.count_tables({t: faults.table(spark, sf_dir, t) for t in TABLES})


ADHOC = """
SELECT o_orderpriority, count(*) AS lines, min(l_shipdate) < max(l_shipdate) AS spread, max(l_quantity) AS max_quantity
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag <> 'N' GROUP BY o_orderpriority"""


@query("adhoc_sql", "S9", ADHOC.format(lineitem="lineitem", orders="orders"))
def adhoc_sql(spark, sf_dir):
    for name in ("lineitem", "orders"):
        faults.table(spark, sf_dir, name).createOrReplaceTempView(f"adhoc_{name}")
    return catalog.run_query(spark, ADHOC.format(lineitem="adhoc_lineitem", orders="adhoc_orders")).frame


@query("adhoc_sql_first_rows", "S9", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 100")
def adhoc_sql_first_rows(spark, sf_dir):
    faults.table(spark, sf_dir, "customer").createOrReplaceTempView("adhoc_customer")
    return catalog.run_query(
        spark, "SELECT c_custkey, c_acctbal FROM adhoc_customer ORDER BY c_acctbal, c_custkey;").rows


@query("adhoc_sql_refused", "S9", "SELECT count(*) AS rows, true AS write_refused FROM region")
def adhoc_sql_refused(spark, sf_dir):
    faults.table(spark, sf_dir, "region").createOrReplaceTempView("adhoc_region")
    refused = catalog.run_query(spark, "INSERT INTO adhoc_region VALUES (9, 'x')").error is not None
    return spark.table("adhoc_region").agg(F.count(F.lit(1)).alias("rows"), F.lit(refused).alias("write_refused"))


STRICT_ORDERS = TableContract.from_dict("orders", {"columns": [
    {"name": "order_id", "type": "integer", "nullable": False, "primary_key": True},
    {"name": "customer_id", "type": "integer", "nullable": False},
    {"name": "order_date", "type": "date", "nullable": False},
    {"name": "total_amount", "type": "float", "nullable": False},
    {"name": "priority", "type": "string", "nullable": False}]})
TEXT_ORDERS = ("cast(o_orderkey as string) AS order_id", "cast(o_custkey as string) AS customer_id",
               "cast(cast(o_orderdate as date) as string) AS order_date",
               "cast(cast(o_totalprice as decimal(12,2)) as string) AS total_amount", "o_orderpriority AS priority")


@query("strict_load_orders", "S10 H9", """
SELECT CAST(o_orderkey AS INTEGER) AS order_id, CAST(o_custkey AS INTEGER) AS customer_id,
  CAST(o_orderdate AS DATE) AS order_date, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DOUBLE) AS total_amount,
  o_orderpriority AS priority, DATE '2024-01-01' AS created_at FROM orders""")
def strict_load_orders(spark, sf_dir):
    raw = faults.table(spark, sf_dir, "orders").selectExpr(*TEXT_ORDERS)
    return strict.strict_load(raw, STRICT_ORDERS, F.lit("2024-01-01").cast("date"))


@query("strict_load_to_folder", "S10", """
SELECT count(*) AS rows_inserted, count(DISTINCT o_orderkey) AS keys FROM orders""")
def strict_load_to_folder(spark, sf_dir):
    raw = faults.table(spark, sf_dir, "orders").selectExpr(*TEXT_ORDERS)
    target = scratch(spark, "strict")
    rows = strict.strict_load_to(raw, STRICT_ORDERS, target)
    return spark.read.parquet(target).agg(
        F.lit(rows).cast("bigint").alias("rows_inserted"), F.count_distinct("order_id").alias("keys"))


BREAKS = """order_date = 'bad-date' OR total_amount = 'INVALID' OR shipping_address = '' OR item_count = ''"""


@query("reject_rows", "S11", f"SELECT * FROM {ORDERS_SRC} WHERE {BREAKS}")
def reject_rows(spark, sf_dir):
    return strict.split_rejects(faults.table(spark, sf_dir, "dirty_orders"), ORDERS)[1]


@query("loadable_rows", "S11", f"SELECT * FROM {ORDERS_SRC} WHERE NOT ({BREAKS})")
def loadable_rows(spark, sf_dir):
    return strict.split_rejects(faults.table(spark, sf_dir, "dirty_orders"), ORDERS)[0]


@query("reject_sample", "S11", f"""
SELECT * FROM {USERS_SRC} WHERE email IS NULL OR email = '' OR age NOT LIKE '%[0-9]%' ORDER BY id LIMIT 5""")
def reject_sample(spark, sf_dir):
    from tablepact.functions import predicates as P
    raw = faults.table(spark, sf_dir, "dirty_users")
    bad = P.is_blank(F.col("email")) | P.lacks_digit(F.col("age"), literal_brackets=True)
    return strict.reject_sample(raw, bad, 5, ["id"])


@query("save_clean_orders", "S12", CLEAN_ORDERS_SQL)
def save_clean_orders(spark, sf_dir):
    path = scratch(spark, "clean")
    sinks.counted_write(clean(faults.table(spark, sf_dir, "dirty_orders"), ORDERS), path)
    return spark.read.parquet(path)


@query("saved_row_count", "S12", "SELECT count(*) AS rows_saved FROM orders")
def saved_row_count(spark, sf_dir):
    """The count comes from the write itself."""
    cleaned = clean(faults.table(spark, sf_dir, "dirty_orders"), ORDERS)
    rows = sinks.counted_write(cleaned, scratch(spark, "counted"))
    return spark.range(0, 1, 1, 1).select(F.lit(rows).cast("bigint").alias("rows_saved"))


def _order_results(spark, sf_dir):
    cleaned = clean(faults.table(spark, sf_dir, "dirty_orders"), ORDERS)
    return K.run_checks(cleaned, K.generate_checks(ORDERS, "orders_clean"))


@query("report_round_trip", "S13", results_sql(f"({CLEAN_ORDERS_SQL})", ORDER_CHECKS))
def report_round_trip(spark, sf_dir):
    results = _order_results(spark, sf_dir)
    path = scratch(spark, "report")
    sinks.save_report(results, path)
    return sinks.load_report(spark, path, results.schema).select("check_id", "actual", "status")


@query("checks_round_trip", "S14", results_sql(f"({CLEAN_ORDERS_SQL})", ORDER_CHECKS))
def checks_round_trip(spark, sf_dir):
    """Stored checks, read back and run."""
    path = scratch(spark, "stored-checks")
    sinks.save_checks(spark, K.generate_checks(ORDERS, "orders_clean"), path)
    cleaned = clean(faults.table(spark, sf_dir, "dirty_orders"), ORDERS)
    return K.run_checks(cleaned, sinks.load_checks(spark, path)).select("check_id", "actual", "status")


@query("attempt_log_append", "S15", """
SELECT CAST(event_id AS VARCHAR) AS timestamp, concat('p', user_id % 3) AS pipeline, 'execution' AS type,
  event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN substring(repeat(props, 200), 1, 1000) END AS error,
  event_id AS total_attempts FROM events""")
def attempt_log_append(spark, sf_dir):
    log = faults.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("timestamp"),
        F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("pipeline"),
        F.lit("execution").alias("type"), (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", F.repeat("props", 200)).alias("error"),
        F.col("event_id").alias("total_attempts"))
    path = scratch(spark, "attempts")
    sinks.append_attempts(log.filter("success"), path, 1000)
    sinks.append_attempts(log.filter("not success"), path, 1000)
    return sinks.read_attempts(spark, path)


@query("preview_orders", "S16", "SELECT * REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_orders(spark, sf_dir):
    orders = faults.table(spark, sf_dir, "orders")
    return files.preview(orders, 10, ["o_orderkey"]).withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
