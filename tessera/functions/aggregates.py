"""COUNT, SUM, AVG, MIN and MAX with the dialect's exact results."""

from __future__ import annotations

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from .types import Kind

NAMES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


def result_kind(name: str, argument: Kind | None) -> Kind:
    if name in ("COUNT", "SUM"):
        return Kind.INT64
    return Kind.DOUBLE if name == "AVG" else argument


def aggregate(name: str, argument: SparkColumn | None) -> SparkColumn:
    """argument None is COUNT(*). SUM and AVG add exact 64-bit integers (ANSI: overflow raises)."""
    if name == "COUNT":
        return F.count(F.lit(1) if argument is None else argument)
    if name == "SUM":
        return F.sum(argument.cast("bigint"))
    if name == "AVG":
        # Not avg(): that adds doubles, and loses bits beyond 2^53.
        return F.sum(argument.cast("bigint")).cast("double") / F.count(argument)
    return F.min(argument) if name == "MIN" else F.max(argument)
