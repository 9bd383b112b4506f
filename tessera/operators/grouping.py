"""Grouping and the whole-table aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import aggregate
from ..plans.binder import Aggregate, Bound

#: Hidden column of the first input key of each group, for first-appearance order.
FIRST = "first_key"


def group(df: DataFrame, groups: list[Bound], aggregates: list[Aggregate], first: list[str] | None = None) -> DataFrame:
    """One row per group, or one row in all without groups. Partial sums run before the shuffle.

    first: columns whose smallest tuple tells where a group first appears.
    """
    made = [aggregate(a.func, F.col(a.argument.name) if a.argument else None).alias(a.name) for a in aggregates]
    if groups and first:
        made.append(F.min(F.struct(*first)).alias(FIRST))
    if not groups:
        return df.agg(*made) if made else df.agg(F.count(F.lit(1)).alias("a0"))
    return df.groupBy(*(g.name for g in groups)).agg(*made) if made else df.select(*(g.name for g in groups)).distinct()
