"""tablepact: table contracts compiled to Spark DataFrame expressions."""

from tablepact.contract import ColumnRule, TableContract

__all__ = ["ColumnRule", "TableContract"]
