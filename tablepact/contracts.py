"""Contracts shipped with the package.

The entries below are fixed values: names, types, defaults, bounds and value
lists of the three sample tables.
"""

from tablepact.contract import TableContract

USERS_DOCUMENT = {
    "version": 1,
    "tables": {
        "users": {
            "description": "Clean user data table with proper constraints",
            "output_table": "users_clean",
            "columns": [
                {"name": "id", "type": "integer", "nullable": False, "primary_key": True, "default": None},
                {"name": "name", "type": "string", "nullable": False, "default": "Unknown",
                 "constraints": {"min_length": 1, "max_length": 255}},
                {"name": "email", "type": "string", "nullable": False,
                 "default": "unknown@example.com", "format": "email",
                 "constraints": {"max_length": 255,
                                 "pattern": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"}},
                {"name": "age", "type": "integer", "nullable": False, "default": 0,
                 "constraints": {"min": 0, "max": 150}},
                {"name": "join_date", "type": "date", "nullable": False, "default": "1970-01-01"},
                {"name": "status", "type": "string", "nullable": False, "default": "inactive",
                 "enum": ["active", "inactive", "pending", "suspended"]},
                {"name": "score", "type": "float", "nullable": False, "default": 0.0,
                 "constraints": {"min": 0.0, "max": 100.0}},
                {"name": "metadata", "type": "json", "nullable": True, "default": "{}"},
            ],
        },
    },
}

ORDERS_DOCUMENT = {
    "version": 1,
    "tables": {
        "orders": {
            "description": "Clean orders data table",
            "output_table": "orders_clean",
            "columns": [
                {"name": "order_id", "type": "integer", "nullable": False, "primary_key": True},
                {"name": "customer_id", "type": "integer", "nullable": False},
                {"name": "order_date", "type": "date", "nullable": False, "default": "1970-01-01"},
                {"name": "total_amount", "type": "float", "nullable": False, "default": 0.0,
                 "constraints": {"min": 0.0, "max": 100000.0}},
                {"name": "shipping_address", "type": "string", "nullable": False, "default": "unknown",
                 "constraints": {"min_length": 5, "max_length": 255}},
                {"name": "item_count", "type": "integer", "nullable": False, "default": 1,
                 "constraints": {"min": 1, "max": 100}},
            ],
        },
    },
}

TRANSACTIONS_DOCUMENT = {
    "version": 1,
    "tables": {
        "transactions": {
            "description": "Clean transactions data table",
            "output_table": "transactions_clean",
            "columns": [
                {"name": "transaction_id", "type": "integer", "nullable": False, "primary_key": True},
                {"name": "customer_id", "type": "integer", "nullable": False},
                {"name": "amount", "type": "float", "nullable": False, "default": 0.0,
                 "constraints": {"min": 0.0, "max": 10000.0}},
                {"name": "date", "type": "date", "nullable": False, "default": "1970-01-01"},
                {"name": "category", "type": "string", "nullable": False, "default": "unknown",
                 "constraints": {"min_length": 1, "max_length": 50}},
                {"name": "status", "type": "string", "nullable": False, "default": "pending",
                 "enum": ["completed", "pending", "cancelled", "refunded"]},
            ],
        },
    },
}

# Rules of the row-level check when no contract is given (bounds included).
ROW_CHECK_DOCUMENT = {
    "tables": {
        "users": {
            "columns": [
                {"name": "id", "type": "integer", "nullable": False},
                {"name": "name", "type": "string", "nullable": False},
                {"name": "email", "type": "string", "nullable": False, "format": "email"},
                {"name": "age", "type": "integer", "nullable": False, "constraints": {"min": 0, "max": 150}},
                {"name": "join_date", "type": "date", "nullable": False},
                {"name": "status", "type": "string", "nullable": False,
                 "enum": ["active", "inactive", "pending", "suspended"]},
                {"name": "score", "type": "float", "nullable": False, "constraints": {"min": 0, "max": 100}},
            ],
        },
    },
}

USERS = TableContract.from_document(USERS_DOCUMENT)
ORDERS = TableContract.from_document(ORDERS_DOCUMENT)
TRANSACTIONS = TableContract.from_document(TRANSACTIONS_DOCUMENT)
ROW_CHECK_USERS = TableContract.from_document(ROW_CHECK_DOCUMENT)
