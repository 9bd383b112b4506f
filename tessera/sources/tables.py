"""Definitions of tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import ExecError, LimitError
from ..functions.types import Column, kind_of

# The size limits of the dialect's storage format.
MAX_TABLES = 17
MAX_TABLE_NAME = 32
MAX_COLUMN_NAME = 16
MAX_COLUMNS = 8
MAX_RECORD = 4072


@dataclass
class Table:
    """Column 0 is the unique key; external tables may have none."""

    name: str
    columns: list[Column]
    frame: Callable[[SparkSession], DataFrame]
    key: str | None
    rows: int | None = None
    indexed: set[str] = field(default_factory=set)


def external(name: str, frame: Callable[[SparkSession], DataFrame], schema: T.StructType, key: str | None, partial: bool = False) -> Table:
    """A table over any DataFrame; columns of types the dialect lacks are refused, or left out if `partial`."""
    lacking = [f"{f.name} ({f.dataType.simpleString()})" for f in schema.fields if kind_of(f.dataType) is None]
    if lacking and not partial:
        raise ExecError(f"table {name} has columns of types the dialect lacks: {', '.join(lacking)}")
    columns = [Column(f.name, kind, f.nullable) for f in schema.fields if (kind := kind_of(f.dataType))]
    same = {f.name for f in schema.fields if (kind := kind_of(f.dataType)) and kind.spark == f.dataType}

    def shown(spark: SparkSession) -> DataFrame:
        df = frame(spark)
        return df.select(*(df[f"`{c.name}`"] if c.name in same else df[f"`{c.name}`"].cast(c.kind.spark).alias(c.name) for c in columns))

    return Table(name, columns, shown, key)


def check_limits(name: str, columns: list[Column], tables: int) -> None:
    if tables >= MAX_TABLES:
        raise LimitError("catalog page is full (one page limits table count)")
    if len(name.encode()) > MAX_TABLE_NAME:
        raise LimitError("table name too long")
    if len(columns) > MAX_COLUMNS:
        raise LimitError("too many columns for the catalog")
    if any(len(c.name.encode()) > MAX_COLUMN_NAME for c in columns):
        raise LimitError("column name too long")
