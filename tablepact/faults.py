"""Faulty variants of clean tables, derived row by row from the data.

The sample tables hold almost no faults, so cleaning and checking would have
nothing to do.  Each projection keeps every row and rewrites some values
depending on the row key.  The expressions are plain SQL that other engines
read as well, which is what makes results comparable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIRTY_ORDERS = """
cast(o_orderkey as string) AS order_id,
cast(o_custkey as string) AS customer_id,
case when o_orderkey % 53 = 0 then 'bad-date' else cast(cast(o_orderdate as date) as string) end AS order_date,
case when o_orderkey % 41 = 0 then 'INVALID' when o_orderkey % 37 = 0 then '-50.00'
     else cast(cast(o_totalprice as decimal(12,2)) as string) end AS total_amount,
case when o_orderkey % 29 = 0 then '' when o_orderkey % 31 = 0 then 'x' else o_orderpriority end AS shipping_address,
case when o_orderkey % 23 = 0 then '' else cast(o_orderkey % 120 as string) end AS item_count
"""

DIRTY_USERS = """
cast(c_custkey as string) AS id,
case when c_custkey % 43 = 0 then '' else c_name end AS name,
case when c_custkey % 17 = 0 then '' when c_custkey % 19 = 0 then concat('user', cast(c_custkey as string), '@example')
     when c_custkey % 47 = 0 then 'no-at-sign' else concat('user', cast(c_custkey as string), '@example.com') end AS email,
case when c_custkey % 13 = 0 then 'N/A' when c_custkey % 29 = 0 then '200' when c_custkey % 31 = 0 then '-3'
     when c_custkey % 37 = 0 then '41.9' else cast(c_custkey % 90 as string) end AS age,
case when c_custkey % 59 = 0 then 'not-a-date' else '2024-01-15' end AS join_date,
case c_mktsegment when 'BUILDING' then 'active' when 'MACHINERY' then 'inactive' when 'AUTOMOBILE' then 'pending'
     when 'HOUSEHOLD' then 'suspended' else 'closed' end AS status,
cast(cast(c_acctbal as decimal(12,2)) as string) AS score,
case when c_custkey % 23 = 0 then '' when c_custkey % 61 = 0 then '{"segment": "x"'
     else concat('{"segment": "', c_mktsegment, '", "nation": ', cast(c_nationkey as string), '}') end AS metadata
"""

DIRTY_TRANSACTIONS = """
cast(event_id as string) AS transaction_id,
cast(user_id as string) AS customer_id,
case when event_id % 41 = 0 then 'INVALID' when event_id % 37 = 0 then '-50.00'
     else cast(cast(value as decimal(12,2)) as string) end AS amount,
case when event_id % 53 = 0 then 'not-a-date' when event_id % 67 = 0 then 'bad-date'
     else cast(cast(ts as date) as string) end AS date,
case when event_id % 29 = 0 then '' else event_type end AS category,
case when event_id % 31 = 0 then 'invalid_status' when event_type = 'purchase' then 'completed'
     when event_type = 'error' then 'cancelled' else 'pending' end AS status
"""

DIRTY_PROPS = """
event_id,
case when event_id % 23 = 0 then '' when event_id % 19 = 0 then substring(props, 1, length(props) - 1)
     else props end AS metadata
"""

LOG_LINES = """
event_id,
concat(cast(date_trunc('second', ts) as string),
       case when event_type = 'error' then ' - ERROR - ' when event_type = 'signup' then ' - WARNING - '
            else ' - INFO - ' end,
       case when event_type <> 'error' then 'event ' when event_id % 5 = 0 then 'ConversionException in row '
            when event_id % 5 = 1 then 'NOT NULL constraint broken in row ' when event_id % 5 = 2 then 'UNIQUE constraint broken in row '
            when event_id % 5 = 3 then 'File not found for row ' else 'Connection refused at row ' end,
       cast(event_id as string)) AS line
"""

ATTEMPTS = """
event_id AS seq,
concat('p', cast(user_id % 3 as string)) AS pipeline,
case when event_id % 2 = 0 then 'regeneration' else 'execution' end AS type,
case when event_type = 'error' then case when event_id % 3 = 0 then 'Cast  FAILED' else 'cast failed' end end AS error
"""

PROJECTIONS = {
    "dirty_orders": ("orders", DIRTY_ORDERS),
    "dirty_users": ("customer", DIRTY_USERS),
    "dirty_transactions": ("events", DIRTY_TRANSACTIONS),
    "dirty_props": ("events", DIRTY_PROPS),
    "log_lines": ("events", LOG_LINES),
    "attempt_log": ("events", ATTEMPTS),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data set, or one of its derived faulty variants."""
    if name in PROJECTIONS:
        base, projection = PROJECTIONS[name]
        source = spark.read.parquet(f"{sf_dir}/{base}.parquet")
        view = f"_faults_{base}"
        source.createOrReplaceTempView(view)
        return spark.sql(f"SELECT {projection} FROM {view}")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(name: str) -> str:
    """The same derived table as a sub-select over the base table."""
    base, projection = PROJECTIONS[name]
    return f"(SELECT {projection} FROM {base})"
