"""Contract types and their Spark counterparts."""

from __future__ import annotations

from pyspark.sql import types as T

# Contract type -> Spark type used for a cleaned column.
SPARK_TYPE = {
    "integer": T.IntegerType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "float": T.DoubleType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "text": T.StringType(),
    "date": T.DateType(),
    "datetime": T.TimestampType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "json": T.StringType(),
}

# Contract type -> Spark type names that satisfy it.
ACCEPTED_TYPE_NAMES = {
    "integer": ("int", "bigint"),
    "int": ("int", "bigint"),
    "bigint": ("int", "bigint"),
    "float": ("float", "double"),
    "double": ("float", "double"),
    "string": ("string",),
    "text": ("string",),
    "date": ("date", "timestamp", "timestamp_ntz"),
    "datetime": ("timestamp", "timestamp_ntz"),
    "boolean": ("boolean",),
    "bool": ("boolean",),
}
DATE_LIKE_TYPE_NAMES = ("date", "timestamp", "timestamp_ntz")

# Spark type name -> contract type of a frame column.
CONTRACT_TYPE_OF = {
    "tinyint": "integer",
    "smallint": "integer",
    "int": "integer",
    "bigint": "integer",
    "float": "float",
    "double": "float",
    "string": "string",
    "date": "date",
    "timestamp": "date",
    "timestamp_ntz": "date",
    "boolean": "boolean",
}

# Contract type -> the family its columns are compared by.
FAMILY = {
    "integer": "integer", "int": "integer", "bigint": "integer", "float": "float", "double": "float",
    "string": "string", "text": "string", "date": "date", "datetime": "date", "boolean": "boolean",
    "bool": "boolean", "json": "json",
}


def family(contract_type: str) -> str:
    return FAMILY.get(contract_type.lower(), contract_type.lower())


def spark_type(contract_type: str) -> T.DataType:
    """Unknown contract types are text."""
    return SPARK_TYPE.get(contract_type.lower(), T.StringType())


def accepted_type_names(contract_type: str) -> tuple[str, ...]:
    return ACCEPTED_TYPE_NAMES.get(contract_type.lower(), ("string",))


def contract_type_of(data_type: T.DataType) -> str:
    return CONTRACT_TYPE_OF.get(data_type.simpleString(), "unknown")


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_date_like(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType))
