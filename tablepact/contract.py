"""The table contract: what every column of a table must look like.

A contract document is a mapping ``{"tables": {name: {"columns": [...]}}}``, in
Python or YAML.  Contracts are driver-side metadata of a few rows; all work on
the data itself is expressed as DataFrame columns built from them.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.functions.types import spark_type

# Names of the bounds.
BOUNDS = ("min", "max", "min_length", "max_length")


@dataclass(frozen=True)
class ColumnRule:
    """One column of a contract.

    ``nullable`` may be absent.  Schema comparison then reads it as *not
    nullable*, generated checks and frame validation read it as *nullable*.
    """

    name: str
    type: str = "string"
    nullable: bool | None = None
    default: object = None
    has_default: bool = False
    enum: tuple | None = None
    format: str | None = None
    pattern: str | None = None
    primary_key: bool = False
    constraints: Mapping = field(default_factory=dict)
    description: str = ""
    day_first: bool = False

    @classmethod
    def from_dict(cls, spec: Mapping) -> ColumnRule:
        """Bounds may stand beside the type or under ``constraints``, which win."""
        enum = spec.get("enum")
        beside = {k: spec[k] for k in BOUNDS if spec.get(k) is not None}
        return cls(
            name=spec["name"],
            type=str(spec.get("type", "string")).lower(),
            nullable=spec.get("nullable"),
            default=spec.get("default"),
            has_default="default" in spec,
            enum=None if enum is None else tuple(enum),
            format=spec.get("format"),
            pattern=spec.get("pattern"),
            primary_key=bool(spec.get("primary_key", False)),
            constraints=beside | dict(spec.get("constraints") or {}),
            description=spec.get("description", ""),
            day_first=bool(spec.get("day_first", False)),
        )

    @property
    def nullable_in_comparison(self) -> bool:
        return bool(self.nullable)

    @property
    def nullable_in_checks(self) -> bool:
        return True if self.nullable is None else bool(self.nullable)

    def bound(self, name: str):
        return self.constraints.get(name)


@dataclass(frozen=True)
class TableContract:
    name: str
    columns: tuple[ColumnRule, ...]
    output_table: str = ""
    description: str = ""

    @classmethod
    def from_dict(cls, name: str, spec: Mapping) -> TableContract:
        columns = spec.get("columns", [])
        if isinstance(columns, Mapping):
            columns = [{"name": k, **v} for k, v in columns.items()]
        return cls(
            name=name,
            columns=tuple(ColumnRule.from_dict(c) for c in columns if c.get("name")),
            output_table=spec.get("output_table", f"{name}_clean"),
            description=spec.get("description", f"{name} table"),
        )

    @classmethod
    def from_document(cls, document: Mapping, table: str | None = None,
                      match: str = "similar") -> TableContract:
        """Pick one table of a document.

        ``match="similar"``: the exact name, else the first name containing or
        contained in it, else an error.  ``match="first"``: the exact name, else
        the first table.
        """
        tables = document.get("tables") or {}
        if not tables:
            raise ValueError("No tables found in contract document")
        if table is None or table in tables:
            chosen = table or next(iter(tables))
        elif match == "first":
            chosen = next(iter(tables))
        else:
            close = [t for t in tables if table in t or t in table]
            if not close:
                raise ValueError(f"Table {table} not found in contract document")
            chosen = close[0]
        return cls.from_dict(chosen, tables[chosen])

    @classmethod
    def from_yaml(cls, path: str, table: str | None = None) -> TableContract:
        """Read a YAML file; without a table name the file stem selects it."""
        try:
            import yaml
        except ImportError as exc:  # optional dependency
            raise RuntimeError("PyYAML is needed to read YAML contracts") from exc
        with open(path, encoding="utf-8") as handle:
            document = yaml.safe_load(handle)
        if table is not None:
            return cls.from_document(document, table)
        stem = os.path.splitext(os.path.basename(path))[0].removesuffix("_schema")
        return cls.from_document(document, stem, match="first")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def key(self) -> list[str]:
        return [c.name for c in self.columns if c.primary_key]

    def column(self, name: str) -> ColumnRule:
        for rule in self.columns:
            if rule.name == name:
                return rule
        raise KeyError(name)

    def as_frame(self, spark: SparkSession) -> DataFrame:
        """One row per column, so that a comparison is a join."""
        rows = [
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c.name).alias("column"),
                F.lit(c.type).alias("expected_type"),
                F.lit(c.nullable_in_comparison).alias("expected_nullable"),
                F.lit(None if c.default is None else str(c.default)).cast("string").alias("default_text"),
                F.lit(isinstance(c.default, str)).alias("default_is_text"),
            )
            for i, c in enumerate(self.columns)
        ]
        return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))

    def spark_types(self) -> dict:
        return {c.name: spark_type(c.type) for c in self.columns}
