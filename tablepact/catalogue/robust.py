"""Queries over inputs that are easy to get wrong: dates in many shapes, late
values, text a cast takes but a strict load must not, files with other headers."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from tablepact import faults
from tablepact.catalogue.cleaning import CLEAN_ORDERS_SQL
from tablepact.catalogue.checking import ORDER_CHECKS, results_sql
from tablepact.catalogue.registry import query, scratch
from tablepact.catalogue.sources import STRICT_ORDERS, TABLES, TEXT_ORDERS, table_paths, with_row_counts
from tablepact.contract import TableContract
from tablepact.contracts import ORDERS
from tablepact.operators import checks as K
from tablepact.operators import consistency, profile
from tablepact.operators.clean import clean, deduplicate
from tablepact.plans import flows
from tablepact.sources import catalog, files, published, sinks, strict

DAY = "cast(cast(o_orderdate as date) as string)"
Y, M, D = f"substring({DAY}, 1, 4)", f"substring({DAY}, 6, 2)", f"substring({DAY}, 9, 2)"
NAME = f"substring('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * cast({M} as int) - 2, 3)"
SHAPES = (f"concat({Y}, '/', {M}, '/', {D})", f"concat({Y}, '.', {M}, '.', {D})", f"concat({Y}, {M}, {D})",
          f"concat({M}, '/', {D}, '/', {Y})", f"concat({DAY}, 'T11:30:00')", f"concat({DAY}, ' 23:59:59')",
          f"concat({NAME}, ' ', {D}, ', ', {Y})", f"concat({D}, ' ', {NAME}, ' ', {Y})",
          f"case when cast({D} as int) > 12 then concat({D}, '.', {M}, '.', {Y}) else concat({M}, '-', {D}, '-', {Y}) end")
MIXED_DATE = "case o_orderkey % 11 " + " ".join(
    f"when {i} then {s}" for i, s in enumerate(SHAPES)) + f" when 9 then 'some day' else {DAY} end AS order_date"
DATES = TableContract.from_dict("dates", {"columns": [
    {"name": "order_id", "type": "integer", "nullable": False},
    {"name": "order_date", "type": "date", "nullable": False, "default": "1970-01-01"}]})


@query("clean_mixed_dates", "K2 K18 P4", """
SELECT CAST(o_orderkey AS INTEGER) AS order_id,
  CASE WHEN o_orderkey % 11 = 9 THEN DATE '1970-01-01' ELSE CAST(o_orderdate AS DATE) END AS order_date FROM orders""")
def clean_mixed_dates(spark, sf_dir):
    """Dates in every documented shape, date-times included."""
    raw = faults.table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as string) AS order_id", MIXED_DATE)
    return clean(raw, DATES)


DAY_FIRST = f"concat({D}, '/', {M}, '/', {Y}) AS day_first"
MONTH_FIRST = f"concat(cast(cast({M} as int) as string), '-', {D}, '-', {Y}, ' 10:30 PM') AS month_first"
NAMED = f"concat('Mon, ', {D}, '-', {NAME}, '-', {Y}) AS named"
SHORT = f"concat({M}, '/', {D}, '/', substring({Y}, 3, 2)) AS short_year"
ORDERED_DATES = TableContract.from_dict("dates", {"columns": [
    {"name": n, "type": "date", "nullable": True} for n in ("day_first", "month_first", "named", "short_year")]})


def _ordered_dates(spark, sf_dir):
    return faults.table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as string) AS order_id", DAY_FIRST, MONTH_FIRST, NAMED, SHORT)


@query("clean_ordered_dates", "K2 K18 P4", """
SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderdate AS DATE) AS day_first, CAST(o_orderdate AS DATE) AS month_first,
  CAST(o_orderdate AS DATE) AS named, CAST(o_orderdate AS DATE) AS short_year FROM orders""")
def clean_ordered_dates(spark, sf_dir):
    """Columns of different orders of day and month, each read in its own throughout; weekdays, times, short years."""
    raw = _ordered_dates(spark, sf_dir)
    cleaned = clean(raw, profile.with_date_orders(raw, ORDERED_DATES))
    return cleaned.select("order_id", "day_first", "month_first", "named", "short_year")


@query("date_orders", "P4", """
WITH t AS (SELECT month(CAST(o_orderdate AS DATE)) AS m, day(CAST(o_orderdate AS DATE)) AS d FROM orders)
SELECT 'day_first' AS "column", 'day_first' AS "order", count(*) FILTER (WHERE d > 12) AS day_first_values,
  CAST(0 AS BIGINT) AS month_first_values, count(*) FILTER (WHERE d <= 12 AND d <> m) AS undecidable_values FROM t
UNION ALL SELECT c, 'month_first', 0, count(*) FILTER (WHERE d > 12), count(*) FILTER (WHERE d <= 12 AND d <> m)
  FROM t, (VALUES ('month_first'), ('short_year')) AS n(c) GROUP BY c
UNION ALL SELECT 'named', 'unknown', 0, 0, 0""")
def date_orders(spark, sf_dir):
    """What the values of each column say about the order of day and month."""
    return profile.date_orders(_ordered_dates(spark, sf_dir), ["day_first", "month_first", "named", "short_year"]).drop("position")


@query("late_sample_values", "P1 P6", """
SELECT 'note' AS "column", 'integer' AS type, count(*) AS row_count, count(*) FILTER (WHERE o_orderkey % 7 <> 3) AS null_count,
  (SELECT string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY o_orderkey) FROM
    (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 3 ORDER BY o_orderkey LIMIT 5)) AS samples FROM orders""")
def late_sample_values(spark, sf_dir):
    """A column whose values are found by looking at all rows."""
    df = faults.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 7 = 3 then cast(o_orderkey as string) end AS note")
    found = profile.infer_schema(df, order_by=["o_orderkey"]).where("column = 'note'")
    return found.select("column", "type", "row_count", "null_count",
                        F.concat_ws("|", "sample_values").alias("samples"))


LOOSE_ORDERS = """cast(o_orderkey as string) AS order_id,
case when o_orderkey % 37 = 0 then '1.5' else cast(o_custkey as string) end AS customer_id,
case when o_orderkey % 53 = 0 then '2024' else cast(cast(o_orderdate as date) as string) end AS order_date,
case when o_orderkey % 41 = 0 then '5d' else cast(cast(o_totalprice as decimal(12,2)) as string) end AS total_amount,
o_orderpriority AS priority"""


def loose_orders(spark, sf_dir):
    faults.table(spark, sf_dir, "orders").createOrReplaceTempView("_loose_orders")
    return spark.sql(f"SELECT {LOOSE_ORDERS} FROM _loose_orders")


@query("reject_loose_casts", "S11", f"""
SELECT * FROM (SELECT {LOOSE_ORDERS} FROM orders)
WHERE customer_id = '1.5' OR order_date = '2024' OR total_amount = '5d'""")
def reject_loose_casts(spark, sf_dir):
    """Text that a cast takes and a strict load does not."""
    return strict.split_rejects(loose_orders(spark, sf_dir), STRICT_ORDERS)[1]


@query("padded_keys_refused", "S10 H9", "SELECT count(*) AS rows, true AS refused, 0 AS loaded FROM orders")
def padded_keys_refused(spark, sf_dir):
    """The same keys again, written with a leading zero, break the key of the table."""
    orders = faults.table(spark, sf_dir, "orders")
    once = orders.selectExpr(*TEXT_ORDERS)
    twice = once.unionByName(once.withColumn("order_id", F.concat(F.lit("0"), "order_id")))
    target = scratch(spark, "padded")
    try:
        loaded = strict.strict_load_to(twice, STRICT_ORDERS, target)
    except Exception as error:
        refused, loaded = "PRIMARY KEY" in str(error), 0
    else:
        refused = False
    return orders.agg(F.count("*").alias("rows"), F.lit(refused).alias("refused"), F.lit(loaded).alias("loaded"))


@query("stage_swapped_headers", "S1 S3", "SELECT " + ", ".join(
    f"nullif({c}, '') AS {c}" for c in ORDERS.names) + f" FROM {faults.sql('dirty_orders')}")
def stage_swapped_headers(spark, sf_dir):
    """Two sets of files whose headers name the same columns in another order."""
    path = scratch(spark, "swapped")
    rows = faults.table(spark, sf_dir, "dirty_orders")
    odd = F.col("order_id").cast("long") % 2 == 1
    for part, names in ((rows.where(odd), ORDERS.names), (rows.where(~odd), ORDERS.names[::-1])):
        part.select(*names).write.mode("append").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    return files.stage_csv(spark, path, ORDERS.names)


@contextmanager
def blocks_of(spark, size):
    """Files read meanwhile are split into blocks of that many bytes."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@query("stage_quoted_breaks", "S1 S3", "SELECT CAST(page_id AS VARCHAR) AS page_id, url, html FROM pages")
def stage_quoted_breaks(spark, sf_dir):
    """Whole pages as fields: quoted line breaks across the blocks of files, in two orders of columns."""
    path, staged = scratch(spark, "pages"), scratch(spark, "staged-pages")
    rows = faults.table(spark, sf_dir, "pages").selectExpr("cast(page_id as string) AS page_id", "url", "html")
    odd = F.xxhash64("page_id") % 2 == 0
    for part, names in ((rows.where(odd), ["page_id", "url", "html"]), (rows.where(~odd), ["html", "page_id", "url"])):
        part.select(*names).write.mode("append").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
    with blocks_of(spark, "256k"):
        files.stage_csv(spark, path, ["page_id", "url", "html"]).write.parquet(staged)
    return spark.read.parquet(staged)


BOUNDED = TableContract.from_dict("orders", {"columns": [
    {"name": "order_id", "type": "bigint", "nullable": False, "min": 10},
    {"name": "order_date", "type": "date", "min": "1995-01-01", "max": "1997-12-31"}]})


@query("checks_with_date_bounds", "G4 G5 G12 G13", """
WITH t AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT 'o_row_count' AS check_id, 'PASS' AS status, count(*) AS actual FROM t
UNION ALL SELECT 'o_order_id_not_null', 'PASS', 0
UNION ALL SELECT 'o_order_id_type_check', 'PASS', 0
UNION ALL SELECT 'o_order_id_min', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM t WHERE k < 10
UNION ALL SELECT 'o_order_date_type_check', 'PASS', 0
UNION ALL SELECT 'o_order_date_min', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM t WHERE d < DATE '1995-01-01'
UNION ALL SELECT 'o_order_date_max', CASE WHEN count(*) > 0 THEN 'FAIL' ELSE 'PASS' END, count(*) FROM t WHERE d > DATE '1997-12-31'
UNION ALL SELECT 'o_order_date_date_valid', 'PASS', 0
UNION ALL SELECT 'failing', 'ERROR', NULL""")
def checks_with_date_bounds(spark, sf_dir):
    """Bounds on dates, and a check that fails while it runs beside them."""
    df = faults.table(spark, sf_dir, "orders").selectExpr(
        "cast(o_orderkey as bigint) AS order_id", "cast(o_orderdate as date) AS order_date", "o_orderpriority AS priority")
    failing = K.Check("failing", "", condition="cast(priority as int) > 0")
    return K.run_checks(df, [*K.generate_checks(BOUNDED, "o"), failing]).select("check_id", "status", "actual")


TEXT_CHECKS = TableContract.from_dict("orders", {"columns": [
    {"name": "day", "type": "date", "min": "1995-01-01", "max": "1997-12-31"},
    {"name": "late_day", "type": "date", "min": "1995-01-01"},
    {"name": "code", "type": "string", "enum": [0, 1, 2, 3, 4]},
    {"name": "odd_code", "type": "string", "enum": [0, 1, 2, 3, 4]}]})
TEXT_ORDER_COLUMNS = """cast(o_orderkey as string) AS order_id, cast(cast(o_orderdate as date) as string) AS day,
case when o_orderkey % 53 = 0 then 'bad-date' else cast(cast(o_orderdate as date) as string) end AS late_day,
cast(o_orderkey % 7 as string) AS code, case when o_orderkey % 31 = 0 then 'n/a' else cast(o_orderkey % 7 as string) end AS odd_code"""


def _text_orders(spark, sf_dir):
    faults.table(spark, sf_dir, "orders").createOrReplaceTempView("_text_orders")
    return spark.sql(f"SELECT {TEXT_ORDER_COLUMNS} FROM _text_orders")


@query("checks_over_text", "G4 G5 G6 G12 G13", f"""
WITH t AS (SELECT {TEXT_ORDER_COLUMNS}, o_orderkey AS k FROM orders),
counted AS (
  SELECT 'o_row_count' AS check_id, count(*) AS n, 0 AS undecided, true AS wanted FROM t
  UNION ALL SELECT 'o_day_type_check', count(*), 0, false FROM t
  UNION ALL SELECT 'o_day_min', count(*) FILTER (WHERE CAST(day AS DATE) < DATE '1995-01-01'), 0, false FROM t
  UNION ALL SELECT 'o_day_max', count(*) FILTER (WHERE CAST(day AS DATE) > DATE '1997-12-31'), 0, false FROM t
  UNION ALL SELECT 'o_day_date_valid', count(*), 0, false FROM t
  UNION ALL SELECT 'o_late_day_type_check', count(*), 0, false FROM t
  UNION ALL SELECT 'o_late_day_min', 0, count(*) FILTER (WHERE try_cast(late_day AS DATE) IS NULL), false FROM t
  UNION ALL SELECT 'o_late_day_date_valid', count(*), 0, false FROM t
  UNION ALL SELECT 'o_code_type_check', 0, 0, false
  UNION ALL SELECT 'o_code_enum', count(*) FILTER (WHERE CAST(code AS INT) > 4), 0, false FROM t
  UNION ALL SELECT 'o_odd_code_type_check', 0, 0, false
  UNION ALL SELECT 'o_odd_code_enum', 0, count(*) FILTER (WHERE odd_code = 'n/a'), false FROM t
  UNION ALL SELECT 'guarded', count(*) FILTER (WHERE try_cast(late_day AS DATE) < DATE '1995-01-01'), 0, false FROM t
  UNION ALL SELECT 'overflow', 0, count(*) FILTER (WHERE 1000000 * CAST(k AS BIGINT) > 2147483647), false FROM t
  UNION ALL SELECT 'division', 0, count(*) FILTER (WHERE code = '0'), false FROM t
)
SELECT check_id, CASE WHEN undecided = 0 THEN n END AS actual,
  CASE WHEN undecided > 0 THEN 'ERROR' WHEN (n > 0) = wanted THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN undecided > 0 THEN concat(undecided, ' rows cannot be decided') END AS error
FROM counted""")
def checks_over_text(spark, sf_dir):
    """Date bounds, number lists and hand-written conditions over text: each undecidable one is its own error."""
    df = _text_orders(spark, sf_dir)
    custom = {"guarded": "late_day <> 'bad-date' AND late_day < DATE '1995-01-01'",
              "overflow": "1000000 * cast(order_id AS int) < 0", "division": "10 / cast(code AS int) > 99"}
    checks = K.generate_checks(TEXT_CHECKS, "o") + [K.Check(i, "", condition=c) for i, c in custom.items()]
    return K.run_checks(df, checks).select("check_id", "actual", "status", "error")


@query("adhoc_runtime_error", "S9", """
SELECT count(*) AS rows, true AS failed, true AS truncated, true AS reflection_refused FROM customer""")
def adhoc_runtime_error(spark, sf_dir):
    """An error met while running is returned; a cut result says so; JVM calls are refused."""
    customers = faults.table(spark, sf_dir, "customer")
    customers.createOrReplaceTempView("adhoc_customer")
    broken = catalog.run_query(spark, "SELECT cast(c_name AS int) + 1 AS n FROM adhoc_customer")
    cut = catalog.run_query(spark, "SELECT c_custkey FROM adhoc_customer", 10)
    unsafe = catalog.run_query(spark, "SELECT java_method('java.lang.Math', 'abs', -1) AS x FROM adhoc_customer")
    return customers.agg(F.count("*").alias("rows"), F.lit(broken.execute()[1] is not None).alias("failed"),
                         F.lit(cut.truncated).alias("truncated"), F.lit(unsafe.error is not None).alias("reflection_refused"))


REFUSED_QUERIES = {
    "late_column": "SELECT " + ", ".join(f"n_nationkey + {i} AS c{i}" for i in range(60))
                   + ", java_method('java.lang.Math', 'abs', -7) AS c60 FROM guarded_nation",
    "in_view": "SELECT * FROM guarded_view",
    "sub_query": "SELECT n_name FROM guarded_nation WHERE n_nationkey < (SELECT max(reflect('java.lang.Math', 'abs', -7)) FROM guarded_nation)",
    "in_cte": "WITH t AS (SELECT try_reflect('java.lang.Math', 'abs', -1) AS x) SELECT * FROM t",
    "user_function": "SELECT guarded_function(n_name) FROM guarded_nation",
    "file": "SELECT * FROM parquet.`{sf_dir}/nation.parquet`",
    "command": "DROP VIEW guarded_nation",
    "insert": "INSERT INTO guarded_nation SELECT * FROM guarded_nation",
}


@query("adhoc_guarded", "S9", "SELECT n_name, n_regionkey, 'see reflect(x)' AS note, " + ", ".join(
    f"{q} AS refused_{n}" for n, q in ((n, "true") for n in REFUSED_QUERIES)) + """
FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name <> 'java_method(1)')""")
def adhoc_guarded(spark, sf_dir):
    """A harmless query with suspicious text runs; what reaches beyond tables and built-in functions is refused."""
    for name in ("nation", "region"):
        faults.table(spark, sf_dir, name).createOrReplaceTempView(f"guarded_{name}")
    spark.sql("SELECT java_method('java.lang.Math', 'abs', -7) AS x").createOrReplaceTempView("guarded_view")
    spark.udf.register("guarded_function", lambda x: x, "string")
    refused = {n: catalog.run_query(spark, q.format(sf_dir=sf_dir) if n == "file" else q).error is not None
               for n, q in REFUSED_QUERIES.items()}
    found = catalog.run_query(spark, """SELECT n_name, n_regionkey, 'see reflect(x)' AS note FROM guarded_nation
        WHERE n_regionkey IN (SELECT r_regionkey FROM guarded_region WHERE r_name <> 'java_method(1)')""")
    return found.frame.select("*", *[F.lit(v).alias(f"refused_{n}") for n, v in refused.items()])


LINE_COLUMNS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


@query("latest_line_per_part", "K25", """
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC,
  l_linenumber DESC) AS n FROM lineitem) WHERE n = 1""")
def latest_line_per_part(spark, sf_dir):
    """Whole rows: the latest line of every part."""
    return deduplicate(faults.table(spark, sf_dir, "lineitem"), ["l_partkey"],
                       ["l_shipdate", "l_orderkey", "l_linenumber"], latest=True)


@query("stored_report", "S13 G15", f"""
SELECT {len(ORDER_CHECKS)} AS total_checks, {len(ORDER_CHECKS)} AS entries, count(*) AS source_row_count,
  count(*) AS output_row_count, 'orders_clean' AS output_table FROM ({CLEAN_ORDERS_SQL})""")
def stored_report(spark, sf_dir):
    """The report with its array of results, stored and read back."""
    raw = faults.table(spark, sf_dir, "dirty_orders")
    cleaned = clean(raw, ORDERS)
    made = K.report(K.run_checks(cleaned, K.generate_checks(ORDERS, "orders_clean")), cleaned, raw, "orders", "orders_clean")
    path = scratch(spark, "whole-report")
    sinks.save_report(made, path)
    return sinks.load_report(spark, path, made.schema).select(
        F.col("total_checks").cast("int").alias("total_checks"), F.size("check_results").alias("entries"),
        "source_row_count", "output_row_count", "output_table")


@query("stored_report_entries", "S13 G15", results_sql(f"({CLEAN_ORDERS_SQL})", ORDER_CHECKS))
def stored_report_entries(spark, sf_dir):
    """Every entry of a stored report, read back from its array."""
    raw = faults.table(spark, sf_dir, "dirty_orders")
    cleaned = clean(raw, ORDERS)
    made = K.report(K.run_checks(cleaned, K.generate_checks(ORDERS, "orders_clean")), cleaned, raw, "orders", "orders_clean")
    path = scratch(spark, "whole-report")
    sinks.save_report(made, path)
    return sinks.load_report(spark, path, made.schema).select(F.explode("check_results").alias("r")).select(
        "r.check_id", "r.actual", "r.status")


@query("numbered_in_order", "R6 S3", """
SELECT row_number() OVER (ORDER BY c_custkey) AS row_number, CAST(c_custkey AS VARCHAR) AS id FROM customer""")
def numbered_in_order(spark, sf_dir):
    """Every row with its number, over the blocks of files whose names follow the order of the rows."""
    path, numbered = scratch(spark, "ordered-csv"), scratch(spark, "numbered")
    rows = faults.table(spark, sf_dir, "dirty_users").withColumn("_key", F.col("id").cast("long"))
    (rows.repartitionByRange(5, "_key").sortWithinPartitions("_key").drop("_key").write.option("header", True)
     .option("escape", '"').option("emptyValue", "").csv(path))
    with blocks_of(spark, "64k"):
        files.with_line_numbers(files.read_rows(spark, path)).select("row_number", "id").write.parquet(numbered)
    return spark.read.parquet(numbered)


@query("source_files_read", "S4 S5 X1", " UNION ALL ".join(
    f"SELECT '{t}' AS name, count(*) AS rows, true AS has_size FROM {t}" for t in TABLES))
def source_files_read(spark, sf_dir):
    """Listed files beside the rows read from them."""
    listed = files.source_metadata(spark, table_paths(sf_dir))
    has_size = (F.col("size_bytes") > 0) & F.col("size_human").isNotNull()
    return with_row_counts(spark, sf_dir, listed).select(
        "name", F.col("row_count").alias("rows"), has_size.alias("has_size"))


@query("ingest_orders", "S10 S4", "SELECT count(*) AS rows, true AS loaded FROM orders")
def ingest_orders(spark, sf_dir):
    """Delimited files, validated, staged and loaded all or not at all."""
    path, target = scratch(spark, "ingest"), scratch(spark, "ingested")
    rows = faults.table(spark, sf_dir, "orders").selectExpr(*TEXT_ORDERS)
    rows.write.option("header", True).csv(path)
    outcome = flows.ingest_strict(spark, path, STRICT_ORDERS, target)
    return spark.read.parquet(target).agg(F.count("*").alias("rows"), F.lit(outcome.loaded).alias("loaded"))


@query("published_versions", "S10 S12", """
SELECT CAST(o_orderkey AS INTEGER) AS order_id, o_orderpriority AS priority, CAST(2 AS BIGINT) AS version,
  true AS failed_load_refused, true AS late_load_refused FROM orders WHERE o_orderkey % 3 = 0""")
def published_versions(spark, sf_dir):
    """Two good loads, one that breaks the key and one made from an old version: the second good one is read."""
    target = scratch(spark, "published")
    rows = faults.table(spark, sf_dir, "orders").selectExpr(*TEXT_ORDERS)
    strict.strict_publish(rows, STRICT_ORDERS, target)
    part = rows.where(F.col("order_id").cast("long") % 3 == 0)
    strict.strict_publish(part, STRICT_ORDERS, target)
    refused = []
    for load in (lambda: strict.strict_publish(part.unionByName(part), STRICT_ORDERS, target),
                 lambda: published.publish(part, target, expected=1)):
        try:
            load()
            refused.append(False)
        except Exception:
            refused.append(True)
    newest = published.versions(spark, target)[-1].number
    return published.read_published(spark, target).select(
        "order_id", "priority", F.lit(newest).cast("bigint").alias("version"),
        F.lit(refused[0]).alias("failed_load_refused"), F.lit(refused[1]).alias("late_load_refused"))


@query("measured_clean_write", "H12 S12", "SELECT count(*) AS rows, true AS has_rate FROM orders")
def measured_clean_write(spark, sf_dir):
    """Rows and rate of a write, taken from the write itself."""
    cleaned = clean(faults.table(spark, sf_dir, "dirty_orders"), ORDERS)
    metrics = flows.measured_write(cleaned, scratch(spark, "measured"))
    return consistency.throughput_status(metrics).select("rows", (F.col("rows_per_second") > 0).alias("has_rate"))
